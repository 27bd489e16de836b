"""Drift queries."""

import numpy as np
from pyspark.sql import functions as F

from checks import query, sql
from perkwise.operators import drift
from perkwise.sources import sample_tables as st

EDGES = [repr(float(e)) for e in np.linspace(0.0, 1.0, 11)]


def shares_sql(rows: str = sql.SCORES, score: str = "score", period: str = "period") -> str:
    binned = " + ".join(f"({score} >= {e}::DOUBLE)::INT" for e in EDGES[1:-1])
    return f"""(SELECT bin, n_baseline, n_current, baseline_mean, current_mean,
  count(s.b) FILTER (WHERE s.base) / n_baseline AS baseline_share,
  count(s.b) FILTER (WHERE NOT s.base) / n_current AS current_share
  FROM (SELECT unnest(range(10))::INT AS bin) g
  CROSS JOIN (SELECT count(*) FILTER (WHERE {period} = 'baseline') AS n_baseline,
    count(*) FILTER (WHERE {period} <> 'baseline') AS n_current,
    avg({score}) FILTER (WHERE {period} = 'baseline') AS baseline_mean,
    avg({score}) FILTER (WHERE {period} <> 'baseline') AS current_mean FROM {rows}) t
  LEFT JOIN (SELECT {binned} AS b, {period} = 'baseline' AS base FROM {rows}
    WHERE {score} >= 0 AND {score} <= 1) s ON s.b = g.bin
  GROUP BY bin, n_baseline, n_current, baseline_mean, current_mean)"""


def psi_sql(shares: str, clip: bool = True) -> str:
    def lifted(c: str) -> str:
        return f"greatest({c}, 1e-6)" if clip else f"(CASE WHEN {c} = 0 THEN 1e-6 ELSE {c} END)"

    a, e = lifted("current_share"), lifted("baseline_share")
    return f"""(SELECT sum(({a} - {e}) * ln({a} / {e})) AS psi, max(n_baseline) AS n_baseline, max(n_current) AS n_current,
  max(baseline_mean) AS ref_mean, max(current_mean) AS cur_mean FROM {shares})"""


# The bin edges 0.1 .. 0.9 themselves occur in this column.
EDGE_SHARES = shares_sql(score="frequency_share")


@query("drf1_histogram_shares", f"""SELECT bin, n_baseline, n_current, round(baseline_mean, 6) AS baseline_mean,
  round(current_mean, 6) AS current_mean, baseline_share, current_share FROM {shares_sql()}""")
def histogram_shares(spark, d):
    return drift.histogram_shares(st.drift_scores(spark, d)).withColumns({
        "baseline_mean": F.round("baseline_mean", 6), "current_mean": F.round("current_mean", 6)})


@query("drf1_histogram_edges", f"SELECT bin, baseline_share, current_share FROM {EDGE_SHARES}")
def histogram_edges(spark, d):
    out = drift.histogram_shares(st.drift_scores(spark, d), "frequency_share")
    return out.select("bin", "baseline_share", "current_share")


@query("drf2_psi", f"SELECT round(psi, 8) AS psi, n_baseline, n_current FROM {psi_sql(shares_sql())}")
def psi(spark, d):
    return drift.psi(st.drift_scores(spark, d)).select(F.round("psi", 8).alias("psi"), "n_baseline", "n_current")


# Dividing by three empties the upper bins.
_LOW = f"(SELECT * REPLACE (CASE WHEN period = 'baseline' THEN score / 3 ELSE score END AS score) FROM {sql.SCORES})"


@query("drf3_zero_floors", f"""SELECT 'replace' AS variant, round(psi, 8) AS psi FROM {psi_sql(shares_sql(_LOW), False)}
  UNION ALL SELECT 'clip', round(psi, 8) FROM {psi_sql(shares_sql(_LOW), True)}""")
def zero_floors(spark, d):
    low = st.drift_scores(spark, d).withColumn(
        "score", F.when(F.col("period") == "baseline", F.col("score") / 3).otherwise(F.col("score"))
    )
    parts = [
        drift.psi(low, clip_floor=clip).select(F.lit(name).alias("variant"), F.round("psi", 8).alias("psi"))
        for name, clip in (("replace", False), ("clip", True))
    ]
    return parts[0].unionByName(parts[1])


@query("drf4_simple_check", f"""SELECT {sql.fixed('psi', 4)} AS psi, 0.2::DOUBLE AS threshold, psi > 0.2 AS drifted,
  {sql.fixed('ref_mean', 4)} AS ref_mean, {sql.fixed('cur_mean', 4)} AS cur_mean FROM {psi_sql(shares_sql(), False)}""")
def simple_check(spark, d):
    return drift.simple_check(st.drift_scores(spark, d))


@query("drf5_drift_status", f"""SELECT {sql.fixed('psi', 4)} AS psi,
  CASE WHEN psi > 0.2 THEN 'critical' WHEN psi > 0.1 THEN 'warning' ELSE 'ok' END AS status,
  '2024-01-01' AS baseline_date, '2024-01-31' AS current_date, n_baseline, n_current FROM {psi_sql(shares_sql(_LOW))}""")
def drift_status(spark, d):
    low = st.drift_scores(spark, d).withColumn(
        "score", F.when(F.col("period") == "baseline", F.col("score") / 3).otherwise(F.col("score"))
    )
    return drift.check_drift(low, "2024-01-01", "2024-01-31")


@query("drf6_feature_breakdown", f"""SELECT 'score' AS feature, {sql.fixed('psi', 4)} AS psi FROM {psi_sql(shares_sql())}
  UNION ALL SELECT 'frequency_share', {sql.fixed('psi', 4)} FROM {psi_sql(EDGE_SHARES)}""")
def feature_breakdown(spark, d):
    return drift.feature_breakdown(st.drift_scores(spark, d), ["score", "frequency_share"])


_TAGGED = f"""(SELECT * REPLACE (CASE WHEN ts > TIMESTAMP '2024-01-30' - INTERVAL 7 DAY THEN 'current' ELSE 'baseline' END AS period)
  FROM {sql.SCORES} WHERE ts <= TIMESTAMP '2024-01-30' AND ts > TIMESTAMP '2024-01-30' - INTERVAL 30 DAY)"""


@query("drf7_window_drift", f"""SELECT {sql.fixed('psi', 4)} AS psi,
  CASE WHEN psi > 0.2 THEN 'critical' WHEN psi > 0.1 THEN 'warning' ELSE 'ok' END AS status,
  '2023-12-31' AS baseline_date, '2024-01-30' AS current_date, n_baseline, n_current FROM {psi_sql(shares_sql(_TAGGED))}""")
def window_drift(spark, d):
    tagged = drift.tag_periods(st.drift_scores(spark, d), "scored_at", "2024-01-30 00:00:00")
    return drift.check_drift(tagged, "2023-12-31", "2024-01-30")
