"""Check feedback quality and log a retraining trigger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from perkwise.operators.feedback import retrain_decision, windowed_stats
from perkwise.sources.tables import append_history, read_history

TRIGGER_LOG = (
    "triggered_at timestamp, reason string, avg_rating double, thumbs_down_rate double, "
    "record_count bigint, action string"
)


def trigger_entries(decision: DataFrame, now: str) -> DataFrame:
    """One log entry where the decision is to retrain, none otherwise."""
    return decision.filter("retrain").select(
        F.lit(now).cast("timestamp").alias("triggered_at"), "reason", "avg_rating",
        "thumbs_down_rate", "record_count", F.lit("retrain_propensity_model").alias("action"),
    )


def check_and_log(feedback: DataFrame, now: str, log_path: str, days: int = 7) -> DataFrame:
    """Run the check, append an entry when it fires, and return the log."""
    decision = retrain_decision(windowed_stats(feedback, now, days))
    append_history(trigger_entries(decision, now).coalesce(1), log_path)
    return read_log(feedback.sparkSession, log_path)


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    return read_history(spark, log_path, TRIGGER_LOG)
