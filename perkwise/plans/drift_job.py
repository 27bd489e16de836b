"""Compare the current score window with the baseline and write the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from perkwise.operators.drift import CRITICAL, WARNING, check_drift, feature_breakdown, tag_periods
from perkwise.sources.tables import write_json_lines


def run(
    scored: DataFrame, at: str, now: str, features: list[str], path: str,
    warning: float = WARNING, critical: float = CRITICAL,
) -> bool:
    """Write the report as JSON; true when the status is not critical."""
    tagged = tag_periods(scored, at, now)
    moment = F.lit(now).cast("date")
    report = check_drift(tagged, "", "", warning, critical).withColumns({
        "baseline_date": F.date_format(F.date_sub(moment, 30), "yyyy-MM-dd"),
        "current_date": F.date_format(moment, "yyyy-MM-dd"),
    })
    # One entry per feature name given: a handful.
    breakdown = feature_breakdown(tagged, features).agg(
        F.map_from_entries(F.collect_list(F.struct("feature", "psi"))).alias("feature_breakdown")
    ).scalar()
    full = report.withColumn("feature_breakdown", breakdown).withColumn(
        "thresholds", F.struct(F.lit(warning).alias("warning"), F.lit(critical).alias("critical"))
    )
    write_json_lines(full.coalesce(1), path)
    return full.sparkSession.read.json(path).filter("status = 'critical'").isEmpty()
