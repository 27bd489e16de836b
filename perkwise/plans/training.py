"""Train, stop early, evaluate and keep the offer-redemption model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from perkwise.operators.propensity import (
    DECISION_THRESHOLD, as_results, feature_matrix, label, ranking_metrics, stratified_split,
    threshold_metrics,
)
from perkwise.operators.store import newest_version
from perkwise.session import drop_path, scratch_path, stage

EPOCHS = 20
PATIENCE = 3


@dataclass(frozen=True)
class Trained:
    """The boosted trees, how many of them to use, and the metrics log."""

    model: GBTClassificationModel
    best_epoch: int
    metrics: DataFrame
    threshold: float = DECISION_THRESHOLD
    version: str = "1"

    def score(self, features: DataFrame) -> DataFrame:
        """Scores by the trees up to the best epoch."""
        rows = with_staged_scores(self.model, feature_matrix(features))
        scored = rows.withColumn("propensity_score", F.col("_staged")[self.best_epoch])
        return as_results(scored, self.threshold, self.version)


def training_rows(stored: DataFrame) -> DataFrame:
    """The newest stored version with label, vector and split. Training is strict about channels."""
    labelled = newest_version(stored).withColumn("label", label(F.col("offer_redemption_rate")))
    # Fitting passes over the rows many times.
    return stage(stratified_split(feature_matrix(labelled, strict=True)), "training")


def with_staged_scores(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    """Add ``_staged``: the score after each boosting round, all rounds in one pass."""
    names = []
    for i, tree in enumerate(model.trees):
        names.append(f"_tree_{i}")
        rows = tree.setFeaturesCol("features").setPredictionCol(names[-1]).transform(rows)
    margin: Column = F.lit(0.0)
    staged = []
    for name, weight in zip(names, model.treeWeights):
        margin = margin + F.col(name) * F.lit(float(weight))
        # The boosted log-loss of Spark models the log-odds as twice the margin.
        staged.append(F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin)))
    return rows.withColumn("_staged", F.array(*staged)).drop(*names)


def epoch_metrics(staged: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """Loss, AUC, precision and recall of every epoch on the given rows."""
    long = staged.select(*groups, "label", F.posexplode("_staged").alias("epoch", "score"))
    keys = (*groups, "epoch")
    return ranking_metrics(long, groups=keys).join(threshold_metrics(long, groups=keys), list(keys))


def best_epoch(aucs: list[float], patience: int = PATIENCE) -> tuple[int, int]:
    """The best epoch and the last one looked at, given the validation AUC of every epoch."""
    best, best_auc, waited = 0, 0.0, 0
    for epoch, auc in enumerate(aucs):
        if auc > best_auc:
            best, best_auc, waited = epoch, auc, 0
        else:
            waited += 1
            if waited >= patience:
                return best, epoch
    return best, len(aucs) - 1


def train(stored: DataFrame, epochs: int = EPOCHS, depth: int = 4, seed: int = 42, version: str = "1",
          patience: int = PATIENCE) -> Trained:
    """Boosting rounds are the epochs; the round with the best validation AUC is kept.

    Rounds are fitted in growing steps until the best AUC has not been beaten for ``patience`` rounds, so no more
    than about twice the rounds looked at are ever fitted. The seed of a round depends on its number alone, so an
    ensemble is a prefix of a longer one: all its epochs are evaluated in one pass, and the best state is restored
    by using the trees up to that round.
    """
    rows = training_rows(stored)
    fit_on = rows.filter("split = 'train'").select("features", "label")
    held = rows.filter("split <> 'train'")
    for rounds in growing_steps(epochs, patience):
        model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, stepSize=0.1).fit(fit_on)
        metrics = stage(epoch_metrics(with_staged_scores(model, held), ("split",)).withColumn("run", F.lit(version)), "epochs")
        # A row per epoch.
        validation = metrics.filter("split = 'validation'").select("epoch", "roc_auc").orderBy("epoch").collect()
        best, last = best_epoch([r["roc_auc"] or 0.0 for r in validation], patience)
        if last - best >= patience:
            break
    return Trained(model, best, metrics.filter(F.col("epoch") <= last), version=version)


def growing_steps(epochs: int, patience: int = PATIENCE) -> Iterator[int]:
    """Numbers of rounds to try, each twice the one before, up to ``epochs``. Fewer than ``patience`` + 1 cannot end a run."""
    rounds = patience + 1
    while rounds < epochs:
        yield rounds
        rounds *= 2
    yield epochs


def train_light(stored: DataFrame, max_iter: int = 50) -> PipelineModel:
    """A logistic model on the same inputs.

    A model just fitted holds its training summary, whose frame cannot be sent to the tasks that score; read back
    from a file it is coefficients only.
    """
    spark = stored.sparkSession
    fit_on = training_rows(stored).filter("split = 'train'").select("features", "label")
    path = scratch_path(spark, "light-model")
    LogisticRegression(maxIter=max_iter).fit(fit_on).write().save(path)
    try:
        return PipelineModel([LogisticRegressionModel.load(path)])
    finally:
        drop_path(spark, path)


def metrics_log(trained: Trained) -> DataFrame:
    """Metrics as rows (run, metric, step, value), ready to append to a log table."""
    columns = ["loss", "roc_auc", "precision", "recall"]
    return trained.metrics.unpivot(["run", "split", "epoch"], columns, "metric", "value").select(
        "run", F.concat_ws("_", "split", "metric").alias("metric"), F.col("epoch").alias("step"), "value"
    )
