"""Preparation, scoring and evaluation of the offer-redemption model."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from perkwise.functions.draws import digest
from perkwise.functions.numbers import ratio
from perkwise.operators.ordering import running_totals
from perkwise.schemas import FEATURE_COLUMNS
from perkwise.session import stage

# Channel codes, thresholds and split shares.
CHANNEL_CODES = {"in-store": 0, "mobile": 1, "web": 2}
LABEL_THRESHOLD = 0.3
DECISION_THRESHOLD = 0.5
AUC_GATE = 0.75
VALIDATION_SHARE = 0.15
TEST_SHARE = 0.15


def channel_code(channel: Column, strict: bool = False) -> Column:
    """Channel as a number; null means web. Unknown values mean web too, or an error when strict."""
    name = F.lower(F.coalesce(channel, F.lit("web")))
    code = F.when(name == "in-store", 0.0).when(name == "mobile", 1.0).when(name == "web", 2.0)
    if strict:
        return code.otherwise(F.raise_error(F.concat(F.lit("unseen channel: "), name)))
    return code.otherwise(float(CHANNEL_CODES["web"]))


def label(rate: Column, threshold: float = LABEL_THRESHOLD) -> Column:
    return (rate > threshold).cast("int")


def encoded(features: DataFrame, strict: bool = False) -> DataFrame:
    """The six model inputs as numbers of single precision, in their fixed order."""
    others = [c for c in features.columns if c not in FEATURE_COLUMNS]
    values = {c: F.col(c) for c in FEATURE_COLUMNS}
    values["channel_preference"] = channel_code(F.col("channel_preference"), strict)
    return features.select(*others, *[v.cast("float").alias(c) for c, v in values.items()])


def feature_matrix(features: DataFrame, strict: bool = False) -> DataFrame:
    """Encoded features with the assembled vector; rows lacking a value are kept as NaN."""
    rows = encoded(features, strict).na.fill(float("nan"), FEATURE_COLUMNS)
    return VectorAssembler(
        inputCols=FEATURE_COLUMNS, outputCol="features", handleInvalid="keep"
    ).transform(rows)


def stratified_split(
    rows: DataFrame, id_column: str = "customer_id", label_column: str = "label",
    validation: float = VALIDATION_SHARE, test: float = TEST_SHARE, seed: int = 42, digits: int = 3,
) -> DataFrame:
    """Add ``split`` (train, validation, test) with exact shares of every class.

    Rows are ordered by a seeded digest of their id. The leading hex digits cut that order into
    16**digits even pieces, so no task ranks more than a piece; one row per piece carries the
    offsets.
    """
    keyed = rows.withColumn("_digest", digest(F.col(id_column), seed, "split")).withColumn(
        "_piece", F.substring("_digest", 1, digits)
    )
    pieces = keyed.groupBy(label_column, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(label_column)
    earlier = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        label_column, "_piece",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_n").over(whole).alias("_total"),
    )
    inside = Window.partitionBy(label_column, "_piece").orderBy("_digest", id_column)
    ranked = keyed.join(offsets, [label_column, "_piece"]).withColumn(
        "_rank", F.col("_offset") + F.row_number().over(inside)
    )
    n_test = F.floor(F.col("_total") * F.lit(test) + F.lit(0.5))
    n_validation = F.floor(F.col("_total") * F.lit(validation) + F.lit(0.5))
    split = (
        F.when(F.col("_rank") <= n_test, "test")
        .when(F.col("_rank") <= n_test + n_validation, "validation")
        .otherwise("train")
    )
    return ranked.select(*rows.columns, split.alias("split"))


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with ``customer_id``, their number from 0 in the order in which they come.

    The rows are written first, so that their order is settled; each part then starts after the earlier ones.
    """
    settled = stage(rows.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = settled.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    number = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return settled.join(starts, part == F.col("_part")).withColumn("customer_id", number.cast("string"))


def as_results(scored: DataFrame, threshold: float, version: str, score: str = "propensity_score") -> DataFrame:
    """Scores as result rows; without a customer_id it is the number of the row, from 0."""
    if "customer_id" not in scored.columns:
        scored = _numbered(scored)
    who = F.col("customer_id").cast("string")
    return scored.select(
        who.alias("customer_id"),
        F.col(score).cast("double").alias("propensity_score"),
        (F.col(score) >= threshold).cast("int").alias("label"),
        F.lit(threshold).alias("threshold"),
        F.lit(version).alias("model_version"),
    )


def score(model, features: DataFrame, threshold: float = DECISION_THRESHOLD, version: str = "1") -> DataFrame:
    """Batch scoring with a fitted classifier over the assembled vector."""
    scored = model.transform(feature_matrix(features)).withColumn(
        "propensity_score", vector_to_array("probability")[1]
    )
    return as_results(scored, threshold, version)


def ranking_metrics(
    scored: DataFrame, score: str = "score", label: str = "label", groups: tuple[str, ...] = ()
) -> DataFrame:
    """ROC-AUC (ties count half) and average precision (a step per distinct threshold)."""
    by_score = (
        scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
        # Highest score first: negated scores ascend.
        .groupBy(*groups, (-F.col(score).cast("double")).alias("_order"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
        )
    )
    placed = running_totals(by_score, "_order", ["pos", "neg"], groups)
    hits = F.col("pos_before") + F.col("pos")
    shown = hits + F.col("neg_before") + F.col("neg")
    # Negatives ranked above a positive, ties half.
    inverted = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    n_pos, n_neg = F.sum("pos"), F.sum("neg")
    return placed.groupBy(*groups).agg(
        F.when((n_pos > 0) & (n_neg > 0), F.lit(1.0) - inverted / (n_pos.cast("double") * n_neg)).alias("roc_auc"),
        F.when(n_pos > 0, F.sum(F.col("pos") * (hits / shown)) / n_pos).alias("avg_precision"),
        n_pos.alias("n_pos"), n_neg.alias("n_neg"),
    )


def threshold_metrics(
    scored: DataFrame, threshold: float = DECISION_THRESHOLD, score: str = "score",
    label: str = "label", groups: tuple[str, ...] = (),
) -> DataFrame:
    """Precision and recall at a threshold, mean score and binary cross-entropy, in one pass."""
    p, y = F.col(score).cast("double"), F.col(label).cast("double")
    predicted = p >= threshold
    floor = F.lit(-100.0)

    def safe_log(x: Column) -> Column:
        return F.when(x > 0, F.greatest(F.log(x), floor)).otherwise(floor)

    loss = -(y * safe_log(p) + (F.lit(1.0) - y) * safe_log(F.lit(1.0) - p))
    counts = scored.groupBy(*groups).agg(
        F.count_if(predicted & (y == 1)).alias("_tp"), F.count_if(predicted).alias("_shown"),
        F.count_if(y == 1).alias("_pos"), F.avg(p).alias("mean_score"), F.avg(loss).alias("loss"),
    )
    return counts.select(
        *groups,
        ratio(F.col("_tp"), F.col("_shown")).alias("precision"),
        ratio(F.col("_tp"), F.col("_pos")).alias("recall"),
        "mean_score", "loss",
    )


def auc_gate(metrics: DataFrame, minimum: float = AUC_GATE) -> DataFrame:
    return metrics.select(
        "roc_auc", F.lit(minimum).alias("threshold"), (F.col("roc_auc") >= minimum).alias("passed")
    )
