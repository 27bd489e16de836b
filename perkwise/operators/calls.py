"""Counters and histograms over the model-call log."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Upper bounds of the latency histogram in milliseconds.
LATENCY_BOUNDS = [50, 100, 250, 500, 1000, 2500, 5000]


def calls_per_model(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model").agg(F.count(F.lit(1)).alias("calls"))


def latency_histogram(calls: DataFrame) -> DataFrame:
    """Cumulative counts per model and bound, the last bound being infinity."""
    latency = F.col("latency_ms")
    names = [str(b) for b in LATENCY_BOUNDS] + ["+Inf"]
    counts = [F.count_if(latency <= b) for b in LATENCY_BOUNDS] + [F.count(F.lit(1))]
    wide = calls.groupBy("model").agg(
        F.sum("latency_ms").alias("latency_sum"),
        *[c.alias(name) for name, c in zip(names, counts)],
    )
    return wide.unpivot(["model", "latency_sum"], [F.col(f"`{n}`") for n in names], "le", "calls")


def token_totals(calls: DataFrame) -> DataFrame:
    """Tokens per model and kind."""
    wide = calls.groupBy("model").agg(
        F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion")
    )
    return wide.unpivot(["model"], ["prompt", "completion"], "type", "tokens")


def latest_score(calls: DataFrame) -> DataFrame:
    """The most recent score that is not missing."""
    return calls.filter(F.col("score").isNotNull()).agg(
        F.max_by("score", F.struct("created_at", "request_id")).alias("score")
    )
