"""Shared primitives on keyed tables: keep-first, keep-last, insert-ignore, upsert, top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], picker) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    # A grouped min_by/max_by combines on the map side, so a key holding a large share
    # of the rows shrinks to one row per task before the shuffle.
    picked = df.groupBy(*keys).agg(
        picker(F.struct(*rest), F.struct(*order)).alias("_row")
    )
    return picked.select(*keys, "_row.*").select(*df.columns)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first by the given columns, ascending."""
    return _pick(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last by the given columns, ascending."""
    return _pick(df, keys, order, F.max_by)


def new_rows(
    existing: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Rows of ``batch`` that an insert-ignore would write: first per key, unknown to ``existing``."""
    return keep_first(batch, keys, order).join(existing.select(*keys), list(keys), "left_anti")


def insert_ignore(
    existing: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Snapshot after an insert that ignores known keys; rows already present win."""
    added = new_rows(existing, batch, keys, order).select(*existing.columns)
    return existing.unionByName(added)


def upsert(
    existing: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    preserve: Sequence[str] = (),
) -> DataFrame:
    """Snapshot after an insert-or-update by key.

    The last row per key of ``batch`` wins. Columns in ``preserve`` keep the value of the first
    write: the existing row's, else that of the first row of the batch.
    """
    keys = list(keys)
    columns = existing.columns
    changed = [c for c in columns if c not in keys and c not in preserve]
    latest = [F.max_by(F.struct(*changed), F.struct(*order)).alias("_new")]
    if preserve:
        latest.append(F.min_by(F.struct(*preserve), F.struct(*order)).alias("_first"))
    incoming = batch.groupBy(*keys).agg(*latest)
    current = existing.select(
        *keys, F.struct(*[c for c in columns if c not in keys]).alias("_old")
    )
    merged = current.join(incoming, keys, "full_outer")

    def value(column: str) -> Column:
        if column in keys:
            return F.col(column)
        if column in preserve:
            return F.when(F.col("_old").isNull(), F.col(f"_first.{column}")).otherwise(
                F.col(f"_old.{column}")
            ).alias(column)
        return F.when(F.col("_new").isNull(), F.col(f"_old.{column}")).otherwise(
            F.col(f"_new.{column}")
        ).alias(column)

    return merged.select(*[value(c) for c in columns])


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank: str = "rank",
    hot_keys: bool = False,
    stripes: int = 256,
) -> DataFrame:
    """The first ``k`` rows per key with their position.

    Spark cuts each task's input to ``k`` rows per key before the shuffle (for ``k`` up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``). With ``hot_keys`` a key
    is first cut per stripe of input tasks; the best ``k`` of the stripes' best rows are the best
    overall, however the rows fall into stripes.
    """
    if hot_keys:
        stripe = F.spark_partition_id() % stripes
        first = Window.partitionBy(*keys, "_stripe").orderBy(*order)
        df = (
            df.withColumn("_stripe", stripe)
            .withColumn("_position", F.row_number().over(first))
            .filter(F.col("_position") <= k)
            .drop("_stripe", "_position")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
