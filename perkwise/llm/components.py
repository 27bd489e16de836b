"""Connected components of a graph of bigints, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkwise.session import stage


def _with_minimum(pairs: DataFrame) -> DataFrame:
    """Every (a, b) with the smallest of a and all its b."""
    low = pairs.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    return pairs.join(low, "a")


def _links(rows: DataFrame) -> DataFrame:
    return rows.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(a, b): each vertex with the smallest vertex of its component, for all but the smallest ones.

    Each round hangs the larger neighbours of a vertex, then the smaller ones, on their minimum; the number
    of rounds grows with the logarithm of the vertices. Rounds are written tables, so a lost executor costs
    one round at most. Components may be of any size: minima are combined before the shuffle and the join
    back to a vertex of many links is one that can be split.
    """
    now, mark = stage(_links(edges), "stars"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _links(_with_minimum(both).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")))
        small = _with_minimum(large)
        small = small.select("b", "low").unionByName(small.select(F.col("a").alias("b"), "low"))
        now = stage(_links(small.select(F.col("b").alias("a"), F.col("low").alias("b"))), "stars")
        last, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if last == mark:
            return now
