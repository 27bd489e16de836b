"""Events to features to a stored version."""

from __future__ import annotations

from pyspark.sql import DataFrame

from perkwise.operators.features import compute_features
from perkwise.operators.store import read_store, write_version


def seed(events: DataFrame, store_path: str, version: str, reference_ts: str, written_at: str) -> DataFrame:
    """Compute and store one version; returns the store.

    The features are computed, checked and written in one pass over the events.
    """
    spark = events.sparkSession
    write_version(compute_features(events, reference_ts), store_path, version, written_at)
    return read_store(spark, store_path)
