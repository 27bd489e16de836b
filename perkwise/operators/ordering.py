"""Running totals and exact percentiles over values too numerous for one task.

A window without partitions would sort everything in one task. Here rows are first grouped by
value, cut into buckets of near-equal size, and only one row per bucket meets in a single window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F


def _bucket_count(df: DataFrame) -> int:
    """As many buckets as the session has shuffle partitions, within limits: the per-bucket rows
    that meet in one window stay few."""
    return min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 32), 4096)


def _bucketed(df: DataFrame, value: str, buckets: int | None) -> DataFrame:
    buckets = buckets or _bucket_count(df)
    shares = [i / buckets for i in range(1, buckets)]
    cuts = df.stat.approxQuantile(value, shares, 1.0 / (4 * buckets)) if shares else []
    if not cuts:
        return df.withColumn("_bucket", F.lit(0.0))
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    return Bucketizer(splits=splits, inputCol=value, outputCol="_bucket").transform(df)


def running_totals(
    df: DataFrame,
    value: str,
    totals: Sequence[str],
    groups: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Add ``<t>_before`` (sum over smaller values) and ``<t>_total`` for each column in ``totals``.

    ``df`` has one row per (groups, value); values are doubles without null.
    """
    keys = [*groups, "_bucket"]
    rows = _bucketed(df, value, buckets)
    per_bucket = rows.groupBy(*keys).agg(*[F.sum(t).alias(f"_{t}") for t in totals])
    earlier = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy(*groups)
    offsets = per_bucket.select(
        *keys,
        *[F.coalesce(F.sum(f"_{t}").over(earlier), F.lit(0)).alias(f"_{t}_offset") for t in totals],
        *[F.sum(f"_{t}").over(whole).alias(f"{t}_total") for t in totals],
    )
    inside = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(offsets, keys)
    return joined.select(
        *df.columns,
        *[
            (F.col(f"_{t}_offset") + F.coalesce(F.sum(t).over(inside), F.lit(0))).alias(f"{t}_before")
            for t in totals
        ],
        *[f"{t}_total" for t in totals],
    )


def exact_percentiles(
    df: DataFrame,
    value: str,
    percentiles: dict[str, float],
    groups: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Percentiles with linear interpolation, one output column per entry of ``percentiles``."""
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, F.col(value).cast("double").alias(value))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    placed = running_totals(counted, value, ["n"], groups, buckets)
    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1
    picks = []
    for name, share in percentiles.items():
        place = (F.col("n_total") - 1) * F.lit(float(share))
        for side, index in (("low", F.floor(place)), ("high", F.ceil(place))):
            picks.append(
                F.max(F.when((first <= index) & (index <= last), F.col(value))).alias(f"_{name}_{side}")
            )
        picks.append(F.max(place - F.floor(place)).alias(f"_{name}_part"))
    picked = placed.groupBy(*groups).agg(*picks)
    return picked.select(
        *groups,
        *[
            (
                F.col(f"_{name}_low")
                + (F.col(f"_{name}_high") - F.col(f"_{name}_low")) * F.col(f"_{name}_part")
            ).alias(name)
            for name in percentiles
        ],
    )
