"""Prompt versions: activation state and template lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from perkwise.operators.keyed import keep_last


def registry_state(log: DataFrame) -> DataFrame:
    """Per prompt: the active version, the version a rollback returns to and whether one is possible."""
    latest = F.max_by(F.struct("version", "previous"), F.struct("activated_at", "entry"))
    return (
        log.groupBy("name")
        .agg(latest.alias("_last"), F.count(F.lit(1)).alias("entries"))
        .select(
            "name",
            F.col("_last.version").alias("active"),
            F.col("_last.previous").alias("rollback_to"),
            "entries",
            ((F.col("entries") >= 2) & F.col("_last.previous").isNotNull()).alias("can_roll_back"),
        )
    )


def version_list(versions: DataFrame, log: DataFrame) -> DataFrame:
    """Known versions with their last activation and status."""
    activated = log.groupBy("name", "version").agg(F.max("activated_at").alias("activated_at"))
    active = registry_state(log).select("name", F.col("active").alias("_active"))
    return (
        versions.select("name", "version").distinct()
        .join(activated, ["name", "version"], "left")
        .join(active, "name", "left")
        .select(
            "name", "version", "activated_at",
            F.when(F.col("version") == F.col("_active"), "active").otherwise("archived").alias("status"),
        )
    )


def register(entries: DataFrame) -> DataFrame:
    """The template table: the last registration per name and version."""
    return keep_last(entries, ["name", "version"], ["entry"])


def get_templates(registered: DataFrame, wanted: DataFrame) -> DataFrame:
    """Templates for (name, version) requests; null where unknown."""
    return wanted.select("name", "version").join(
        registered.select("name", "version", "template"), ["name", "version"], "left"
    )


def list_versions(registered: DataFrame, name: str) -> DataFrame:
    return registered.filter(F.col("name") == name).select("version").distinct()
