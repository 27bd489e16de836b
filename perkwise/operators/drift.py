"""Population stability of score distributions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from perkwise.functions.numbers import round_exact
from perkwise.functions.times import before, instant

# Bins, floor of an empty bin and status limits.
BINS = 10
FLOOR = 1e-6
WARNING = 0.10
CRITICAL = 0.20


def bin_number(score: Column, bins: int = BINS) -> Column:
    """Index of the equal-width bin on [0, 1]: half-open, the last one closed, null outside.

    Compares with the same inexact edges that ``linspace`` produces.
    """
    edges = [float(e) for e in np.linspace(0.0, 1.0, bins + 1)]
    index = F.lit(0)
    for edge in edges[1:-1]:
        index = index + (score >= F.lit(edge)).cast("int")
    return F.when((score >= F.lit(edges[0])) & (score <= F.lit(edges[-1])), index)


def _floored(share: Column, clip_floor: bool) -> Column:
    if clip_floor:
        return F.greatest(share, F.lit(FLOOR))
    return F.when(share == 0, F.lit(FLOOR)).otherwise(share)


def histogram_shares(
    scores: DataFrame, score: str = "score", period: str = "period",
    groups: Sequence[str] = (), bins: int = BINS,
) -> DataFrame:
    """Share of each bin per group for the baseline and the current period.

    Every bin is present. Scores outside [0, 1] are in no bin but stay in the denominator.
    """
    is_base = F.col(period) == "baseline"
    counts = (
        scores.filter(F.col(score).isNotNull())
        .groupBy(*groups, bin_number(F.col(score), bins).alias("bin"))
        .agg(
            F.count_if(is_base).alias("base"), F.count_if(~is_base).alias("current"),
            F.sum(F.when(is_base, F.col(score))).alias("base_sum"),
            F.sum(F.when(~is_base, F.col(score))).alias("current_sum"),
        )
    )
    # At most bins+1 rows per group are left; one more grouping spreads them over all bins.
    def in_bin(column: str, b: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("bin") == b, F.col(column))), F.lit(0))

    spread = counts.groupBy(*groups).agg(
        F.sum("base").alias("n_baseline"), F.sum("current").alias("n_current"),
        F.sum("base_sum").alias("_base_sum"), F.sum("current_sum").alias("_current_sum"),
        F.array(*[
            F.struct(F.lit(b).alias("bin"), in_bin("base", b).alias("base"), in_bin("current", b).alias("current"))
            for b in range(bins)
        ]).alias("_bins"),
    )
    return (
        spread.select(
            *groups, "n_baseline", "n_current",
            (F.col("_base_sum") / F.col("n_baseline")).alias("baseline_mean"),
            (F.col("_current_sum") / F.col("n_current")).alias("current_mean"),
            F.inline("_bins"),
        )
        .withColumn("baseline_share", F.col("base") / F.col("n_baseline"))
        .withColumn("current_share", F.col("current") / F.col("n_current"))
        .drop("base", "current")
    )


def psi(
    scores: DataFrame, score: str = "score", period: str = "period",
    groups: Sequence[str] = (), bins: int = BINS, clip_floor: bool = True,
) -> DataFrame:
    """Population stability index per group.

    ``clip_floor`` lifts every share below the floor; otherwise only empty bins get the floor.
    """
    shares = histogram_shares(scores, score, period, groups, bins)
    base = _floored(F.col("baseline_share"), clip_floor)
    current = _floored(F.col("current_share"), clip_floor)
    return shares.groupBy(*groups).agg(
        F.sum((current - base) * F.log(current / base)).alias("psi"),
        F.max("n_baseline").alias("n_baseline"),
        F.max("n_current").alias("n_current"),
        F.max("baseline_mean").alias("baseline_mean"),
        F.max("current_mean").alias("current_mean"),
    )


def simple_check(scores: DataFrame, threshold: float = CRITICAL, **columns) -> DataFrame:
    """Drift yes or no, with the means of both periods."""
    return psi(scores, clip_floor=False, **columns).select(
        round_exact(F.col("psi"), 4).alias("psi"),
        F.lit(threshold).alias("threshold"),
        (F.col("psi") > threshold).alias("drifted"),
        round_exact(F.col("baseline_mean"), 4).alias("ref_mean"),
        round_exact(F.col("current_mean"), 4).alias("cur_mean"),
    )


def status(value: Column, warning: float = WARNING, critical: float = CRITICAL) -> Column:
    return F.when(value > critical, "critical").when(value > warning, "warning").otherwise("ok")


def check_drift(
    scores: DataFrame, baseline_date: str, current_date: str,
    warning: float = WARNING, critical: float = CRITICAL, **columns,
) -> DataFrame:
    """One report row; the status is judged on the unrounded index."""
    return psi(scores, **columns).select(
        round_exact(F.col("psi"), 4).alias("psi"),
        status(F.col("psi"), warning, critical).alias("status"),
        F.lit(baseline_date).alias("baseline_date"),
        F.lit(current_date).alias("current_date"),
        "n_baseline", "n_current",
    )


def feature_breakdown(
    scores: DataFrame, features: Sequence[str], period: str = "period", bins: int = BINS
) -> DataFrame:
    """Index per feature, largest first; all features share the bins on [0, 1]."""
    long = scores.select(period, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(
        [period], list(features), "feature", "score"
    )
    return (
        psi(long, groups=["feature"], period=period, bins=bins)
        .select("feature", round_exact(F.col("psi"), 4).alias("psi"))
        .orderBy(F.desc("psi"), "feature")
    )


def tag_periods(
    scored: DataFrame, at: str, now: str, baseline_days: int = 30, current_days: int = 7
) -> DataFrame:
    """Rows of the current window (last ``current_days``) and of the baseline window before it."""
    scored_at = F.col(at)
    inside = (scored_at > before(now, baseline_days)) & (scored_at <= instant(now))
    return scored.filter(inside).withColumn(
        "period", F.when(scored_at > before(now, current_days), "current").otherwise("baseline")
    )
