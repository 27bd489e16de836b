import numpy as np
import pytest
from pyspark.sql import functions as F

from perkwise import schemas
from perkwise.operators import propensity as mo
from perkwise.plans import training


def test_channel_codes(spark):
    names = ["in-store", "MOBILE", "web", "fax", None]
    frame = spark.createDataFrame([(n,) for n in names], "c string")
    assert [r[0] for r in frame.select(mo.channel_code(F.col("c"))).collect()] == [0.0, 1.0, 2.0, 2.0, 2.0]
    known = frame.filter("c is null or c <> 'fax'")
    assert [r[0] for r in known.select(mo.channel_code(F.col("c"), strict=True)).collect()] == [0.0, 1.0, 2.0, 2.0]
    with pytest.raises(Exception, match="unseen channel: fax"):
        frame.select(mo.channel_code(F.col("c"), strict=True)).collect()


def test_label_is_strict(spark):
    frame = spark.createDataFrame([(0.3,), (0.31,)], "r double")
    assert [r[0] for r in frame.select(mo.label(F.col("r"))).collect()] == [0, 1]


def test_split_has_exact_shares_of_each_class(spark):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("customer_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    got = mo.stratified_split(rows, digits=1).groupBy("label", "split").count().collect()
    counts = {(r["label"], r["split"]): r["count"] for r in got}
    assert counts == {(0, "train"): 630, (0, "validation"): 135, (0, "test"): 135, (1, "train"): 70, (1, "validation"): 15, (1, "test"): 15}
    a = mo.stratified_split(rows, digits=1).orderBy("customer_id").collect()
    b = mo.stratified_split(rows.repartition(7), digits=2).orderBy("customer_id").collect()
    assert a == b


def slow_metrics(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    for t in sorted({s for s, _ in pairs}, reverse=True):
        shown = [y for s, y in pairs if s >= t]
        recall = sum(shown) / len(pos)
        ap += (recall - last) * sum(shown) / len(shown)
        last = recall
    return auc, ap


@pytest.mark.parametrize("values", [5, 1000])
def test_ranking_metrics_against_brute_force(spark, values):
    rng = np.random.default_rng(4)
    pairs = [(float(s) / values, int(y)) for s, y in zip(rng.integers(0, values, 300), rng.integers(0, 2, 300))]
    frame = spark.createDataFrame(pairs, "score double, label int")
    got = mo.ranking_metrics(frame).first()
    auc, ap = slow_metrics(pairs)
    assert got["roc_auc"] == pytest.approx(auc, abs=1e-12)
    assert got["avg_precision"] == pytest.approx(ap, abs=1e-12)


def test_average_precision_is_stepwise(spark):
    frame = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1)], "score double, label int")
    assert mo.ranking_metrics(frame).first()["avg_precision"] == pytest.approx(0.8333, abs=1e-4)


def test_one_class_has_no_auc(spark):
    got = mo.ranking_metrics(spark.createDataFrame([(0.9, 1)], "score double, label int")).first()
    assert got["roc_auc"] is None and got["avg_precision"] == 1.0


def test_threshold_metrics(spark):
    frame = spark.createDataFrame([(0.5, 1), (0.4, 1), (1.0, 0), (0.0, 0)], "score double, label int")
    got = mo.threshold_metrics(frame).first()
    assert (got["precision"], got["recall"], got["mean_score"]) == (0.5, 0.5, 0.475)
    assert got["loss"] == pytest.approx((-np.log(0.5) - np.log(0.4) + 100.0) / 4)
    none = mo.threshold_metrics(frame, threshold=2.0).first()
    assert (none["precision"], none["recall"]) == (0.0, 0.0)


def test_gate(spark):
    frame = spark.createDataFrame([(0.75,), (0.7499,)], "roc_auc double")
    assert [r["passed"] for r in mo.auc_gate(frame).collect()] == [True, False]


def test_rows_without_an_id_are_numbered(spark):
    got = mo.as_results(spark.createDataFrame([(0.5,), (0.4,)], "s double").coalesce(1), 0.5, "7", "s").collect()
    assert [(r["customer_id"], r["label"], r["model_version"]) for r in got] == [("0", 1, "7"), ("1", 0, "7")]


@pytest.mark.parametrize("aucs, want", [
    ([0.6, 0.7, 0.7, 0.69, 0.7, 0.9], (1, 4)), ([0.5, 0.6, 0.7], (2, 2)), ([1.0] * 10, (0, 3)), ([0.0, 0.0, 0.0], (0, 2)),
])
def test_early_stopping(aucs, want):
    assert training.best_epoch(aucs) == want


@pytest.fixture(scope="module")
def stored(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        rate = float(rng.random())
        rows.append((f"c{i}", int(rng.integers(0, 30)), int(rng.integers(0, 50)), float(rng.random() * 100), rate,
                     ["web", "mobile", "in-store", None][i % 4], min(1.0, rate * 0.8 + 0.1), "v2"))
    names = [f.name for f in schemas.FEATURES] + ["version"]
    frame = spark.createDataFrame(rows, "customer_id string, recency_days int, frequency_30d int, monetary_90d double, offer_redemption_rate double, channel_preference string, engagement_score double, version string")
    assert frame.columns == names
    old = frame.limit(5).withColumn("version", F.lit("v1"))
    at = F.when(F.col("version") == "v2", "2024-01-02").otherwise("2024-01-01").cast("timestamp")
    return frame.unionByName(old).withColumn("written_at", at)


def test_training_and_scoring(spark, stored):
    trained = training.train(stored, epochs=4, depth=3)
    metrics = trained.metrics.filter("split = 'validation'").orderBy("epoch").collect()
    assert metrics[trained.best_epoch]["roc_auc"] == max(m["roc_auc"] for m in metrics) > 0.95
    features = stored.filter("version = 'v2'").drop("version", "written_at")
    scored = trained.score(features).collect()
    assert len(scored) == 600 and all(0.0 <= r["propensity_score"] <= 1.0 for r in scored)
    assert all(r["label"] == int(r["propensity_score"] >= 0.5) for r in scored)
    single = trained.score(features.filter("customer_id = 'c7'")).first()
    assert single in scored
    log = training.metrics_log(trained).collect()
    assert {r["metric"] for r in log} >= {"validation_roc_auc", "test_roc_auc", "validation_loss"}


def test_staged_scores_end_at_the_model_score(spark, stored):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    rows = training.training_rows(stored)
    model = GBTClassifier(maxIter=3, maxDepth=2, seed=1).fit(rows.filter("split = 'train'"))
    both = training.with_staged_scores(model, model.transform(rows)).select(
        F.col("_staged")[2].alias("a"), vector_to_array("probability")[1].alias("b")).collect()
    assert all(r["a"] == pytest.approx(r["b"], abs=1e-12) for r in both)


def test_light_model(spark, stored):
    scored = mo.score(training.train_light(stored), stored.filter("version = 'v2'").drop("version", "written_at"))
    auc = mo.ranking_metrics(scored.join(stored.filter("version = 'v2'").select("customer_id", mo.label(F.col("offer_redemption_rate")).alias("y")), "customer_id").select(F.col("propensity_score").alias("score"), F.col("y").alias("label")))
    assert auc.first()["roc_auc"] > 0.95


def test_light_model_can_be_sent_to_tasks(spark, stored):
    model = training.train_light(stored, max_iter=5)
    assert not model.stages[0].hasSummary
    rows = mo.score(model, stored.filter("version = 'v2'").drop("version", "written_at")).toPandas()
    assert len(rows) == 600 and rows["propensity_score"].between(0.0, 1.0).all()


def test_rounds_are_fitted_in_steps_until_the_score_stops_rising(spark, stored):
    assert list(training.growing_steps(20, 3)) == [4, 8, 16, 20] and list(training.growing_steps(3, 3)) == [3]
    short = training.train(stored, epochs=40, depth=3, patience=2)
    fitted = short.model.getNumTrees
    assert fitted < 40
    steps = sorted(r["epoch"] for r in short.metrics.filter("split = 'validation'").collect())
    aucs = {r["epoch"]: r["roc_auc"] for r in short.metrics.filter("split = 'validation'").collect()}
    assert steps == list(range(short.best_epoch + 3)) and aucs[short.best_epoch] == max(aucs.values())
    # The rounds of a longer run are the same, so stopping early loses nothing.
    whole = training.train(stored, epochs=fitted + 3, depth=3, patience=50)
    assert whole.model.getNumTrees == fitted + 3
    same = {r["epoch"]: r["roc_auc"] for r in whole.metrics.filter("split = 'validation'").collect()}
    assert all(abs(same[e] - aucs[e]) < 1e-9 for e in aucs)
