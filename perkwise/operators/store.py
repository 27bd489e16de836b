"""Versioned feature store kept as Parquet partitioned by version and slot, with a log of what is published.

A write goes into a slot of its own while its quality gates are counted on the way. Only if they pass does one small
file in the log name the slot; readers see the last published slot of each version and nothing else, so a failed or
broken write leaves the store as it was. Versions are listed from the log alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from perkwise.functions.times import before
from perkwise.operators.keyed import keep_last, upsert
from perkwise.schemas import FEATURE_COLUMNS, NUMERIC_FEATURES, STORED_FEATURES
from perkwise.session import path_exists

# Quality limits and the age at which a hot row expires.
NULL_LIMIT = 0.05
HOT_SECONDS = 86_400
_LOG = "number bigint, version string, slot string, written_at timestamp, n_rows bigint"


class FeatureValidationError(ValueError):
    """Raised when features fail a quality check."""


def require_columns(features: DataFrame) -> DataFrame:
    """The frame unchanged, or an error naming the missing columns. Reads only the schema."""
    missing = sorted({"customer_id", *FEATURE_COLUMNS} - set(features.columns))
    if missing:
        raise FeatureValidationError(f"missing columns: {missing}")
    return features


def _is_missing(features: DataFrame, column: str):
    col = F.col(column)
    numeric = dict(features.dtypes)[column] in ("double", "float")
    return (col.isNull() | F.isnan(col)) if numeric else col.isNull()


def _gates(features: DataFrame) -> list[Column]:
    score = F.col("engagement_score")
    outside = ((score < 0.0) | (score > 1.0)) & ~F.isnan(score)
    return [
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(_is_missing(features, c)).alias(c) for c in FEATURE_COLUMNS],
        F.count_if(outside).alias("n_out_of_range"),
    ]


def _gate_counts(features: DataFrame) -> DataFrame:
    return features.agg(*_gates(features))


def null_fractions(features: DataFrame, limit: float = NULL_LIMIT) -> DataFrame:
    """Share of missing values per feature column and whether it is within the limit."""
    counts = _gate_counts(features)
    share = F.when(F.col("n_rows") == 0, F.lit(0.0)).otherwise(F.col("n_missing") / F.col("n_rows"))
    return (
        counts.unpivot(["n_rows"], FEATURE_COLUMNS, "column_name", "n_missing")
        .select("column_name", "n_rows", "n_missing", share.alias("null_fraction"))
        .withColumn("passed", F.col("null_fraction") <= limit)
    )


def range_check(features: DataFrame) -> DataFrame:
    """Number of engagement scores outside [0, 1]."""
    return _gate_counts(features).select(
        "n_rows", "n_out_of_range", (F.col("n_out_of_range") == 0).alias("passed")
    )


def _refuse(counts: dict[str, int], limit: float) -> None:
    for column in FEATURE_COLUMNS:
        share = counts[column] / counts["n_rows"] if counts["n_rows"] else 0.0
        if share > limit:
            raise FeatureValidationError(f"column {column!r} has {share:.1%} nulls (limit {limit:.0%})")
    if counts["n_out_of_range"]:
        raise FeatureValidationError("engagement_score contains values outside [0, 1]")


def validate(features: DataFrame, limit: float = NULL_LIMIT) -> DataFrame:
    """All quality gates in one aggregation; raises on the first that fails."""
    require_columns(features)
    _refuse(_gate_counts(features).first().asDict(), limit)
    return features


def write_version(features: DataFrame, path: str, version: str, written_at: str, limit: float = NULL_LIMIT) -> None:
    """Store one version and publish it if its gates pass; writing it again replaces just that version.

    The features are computed and written once; the gates are counted by the tasks that write. One writer at a time.
    """
    require_columns(features)
    spark, slot, gates = features.sparkSession, uuid.uuid4().hex, Observation()
    rows = features.select("customer_id", *FEATURE_COLUMNS)
    (
        rows.observe(gates, *_gates(rows))
        .withColumns({"written_at": F.lit(written_at).cast("timestamp"), "version": F.lit(version), "slot": F.lit(slot)})
        .write.mode("append").partitionBy("version", "slot").parquet(f"{path}/rows")
    )
    # A failed write stays unnamed, so that nobody reads it.
    _refuse(gates.get, limit)
    number = (publish_log(spark, path).agg(F.max("number")).first()[0] or 0) + 1
    entry = spark.range(1).select(
        F.lit(number).cast("bigint").alias("number"), F.lit(version).alias("version"), F.lit(slot).alias("slot"),
        F.lit(written_at).cast("timestamp").alias("written_at"), F.lit(gates.get["n_rows"]).cast("bigint").alias("n_rows"))
    entry.coalesce(1).write.mode("append").parquet(f"{path}/log")


def publish_log(spark, path: str) -> DataFrame:
    """(number, version, slot, written_at, n_rows) of every published write."""
    if not path_exists(spark, f"{path}/log"):
        return spark.createDataFrame([], _LOG)
    return spark.read.schema(_LOG).parquet(f"{path}/log")


def published(spark, path: str) -> DataFrame:
    """The last published write of every version. Reads the log only."""
    return keep_last(publish_log(spark, path), ["version"], ["number"])


def read_store(spark, path: str, version: str | None = None) -> DataFrame:
    """The published rows, of all versions or of one; other slots are pruned before any file is opened."""
    entries = published(spark, path)
    if version is not None:
        entries = entries.filter(F.col("version") == version)
    slots = [r["slot"] for r in entries.select("slot").collect()]
    if not slots:
        return spark.createDataFrame([], STORED_FEATURES)
    whole = T.StructType([*STORED_FEATURES.fields, T.StructField("slot", T.StringType())])
    return spark.read.schema(whole).parquet(f"{path}/rows").filter(F.col("slot").isin(slots)).drop("slot")


def read_newest(spark, path: str) -> DataFrame:
    """All rows of the version written last: the log tells which, only its files are read."""
    newest = published(spark, path).orderBy(F.desc("written_at"), F.desc("version")).select("version").head(1)
    return read_store(spark, path, newest[0]["version"] if newest else "")


def latest_features(stored: DataFrame) -> DataFrame:
    """The most recently written row of every customer."""
    return keep_last(stored, ["customer_id"], ["written_at", "version"]).drop("written_at")


def list_versions(stored: DataFrame) -> DataFrame:
    """Versions with their last write, newest first."""
    return (
        stored.groupBy("version")
        .agg(F.max("written_at").alias("written_at"))
        .orderBy(F.desc("written_at"), F.desc("version"))
    )


def newest_version(stored: DataFrame) -> DataFrame:
    """All rows of the version written last. The version arrives as a scalar subquery, so with
    Parquet partitioned by version only that partition is read."""
    newest = stored.agg(
        F.max_by("version", F.struct("written_at", "version")).alias("version")
    ).scalar()
    return stored.filter(F.col("version") == newest)


def feature_stats(stored: DataFrame, version: str) -> DataFrame:
    """Profile of the numeric columns of one version, one row per column."""
    rows = stored.filter(F.col("version") == version)

    def profile(column: str):
        value = F.col(column).cast("double")
        return F.struct(
            F.lit(column).alias("column_name"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.approx_count_distinct(value).alias("approx_unique"),
            F.avg(value).alias("avg"),
            F.stddev_samp(value).alias("std"),
            F.percentile_approx(value, [0.25, 0.5, 0.75]).alias("quartiles"),
            F.count(F.lit(1)).alias("count"),
            F.avg(F.when(value.isNull(), 100.0).otherwise(0.0)).alias("null_percentage"),
        )

    return (
        rows.agg(F.array(*[profile(c) for c in NUMERIC_FEATURES]).alias("profiles"))
        .select(F.inline("profiles"))
        .select(
            "column_name", "min", "max", "approx_unique", "avg", "std",
            F.col("quartiles")[0].alias("q25"),
            F.col("quartiles")[1].alias("q50"),
            F.col("quartiles")[2].alias("q75"),
            "count", "null_percentage",
        )
    )


def to_vectors(features: DataFrame, computed_at) -> DataFrame:
    """Wide features to the long form: parallel arrays of names and values."""
    return features.select(
        "customer_id",
        F.array(*[F.lit(c) for c in NUMERIC_FEATURES]).alias("feature_names"),
        F.array(*[F.col(c).cast("double") for c in NUMERIC_FEATURES]).alias("values"),
        computed_at.alias("computed_at"),
    )


def upsert_vectors(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Feature vectors by customer; the last of a batch wins, of equal times the largest values."""
    rest = [c for c in existing.columns if c not in ("customer_id", "computed_at")]
    return upsert(existing, batch, ["customer_id"], ["computed_at", *rest])


def lookup(
    ids: DataFrame, hot: DataFrame, cold: DataFrame, now: str, max_age: int = HOT_SECONDS
) -> DataFrame:
    """Vectors for a list of ids: the hot row while it is fresh, else the cold one; others dropped."""
    fresh = hot.filter(F.col("computed_at") > before(now, max_age / 86_400))
    wanted = ids.select("customer_id").distinct()

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            "customer_id", F.struct("feature_names", "values", "computed_at").alias(name)
        )

    return (
        wanted.join(packed(fresh, "_hot"), "customer_id", "left")
        .join(packed(cold, "_cold"), "customer_id", "left")
        .withColumn("_row", F.coalesce("_hot", "_cold"))
        .filter(F.col("_row").isNotNull())
        .select("customer_id", "_row.*", F.col("_hot").isNotNull().alias("from_hot"))
    )


def vectors_to_json(vectors: DataFrame) -> DataFrame:
    return vectors.select(
        "customer_id",
        F.to_json("feature_names").alias("feature_names"),
        F.to_json("values").alias("values"),
        "computed_at",
    )


def vectors_from_json(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "customer_id",
        F.from_json("feature_names", "array<string>").alias("feature_names"),
        F.from_json("values", "array<double>").alias("values"),
        "computed_at",
    )


def as_map(vectors: DataFrame) -> DataFrame:
    """Vectors as a name-to-value map."""
    return vectors.select(
        "customer_id", F.map_from_arrays("feature_names", "values").alias("features"), "computed_at"
    )
