import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from perkwise.operators import drift
from perkwise.plans import drift_job


def frame(spark, base, current):
    rows = [(float(x), "baseline") for x in base] + [(float(x), "current") for x in current]
    return spark.createDataFrame(rows, "score double, period string")




def test_bins_agree_with_numpy_on_the_edges(spark):
    edges = np.linspace(0, 1, 11)
    values = np.r_[edges, np.nextafter(edges, -1), np.nextafter(edges, 2), 0.3, 0.6, 0.7, 0.9, -0.1, 1.1]
    got = spark.createDataFrame([(float(v),) for v in values], "v double").select(drift.bin_number(F.col("v")).alias("b")).collect()
    for v, r in zip(values, got):
        counts = np.histogram([v], edges)[0]
        assert r["b"] == (int(counts.argmax()) if counts.sum() else None), v


def test_psi_of_known_bins(spark):
    # Half and half against a quarter and three quarters: 1/4 ln 2 + 1/4 ln 1.5.
    got = drift.psi(frame(spark, [0.15] * 4 + [0.85] * 4, [0.15] + [0.85] * 3)).first()
    assert got["psi"] == pytest.approx(0.25 * 0.6931471805599453 + 0.25 * 0.4054651081081644, abs=1e-12)
    assert (got["n_baseline"], got["n_current"]) == (8, 4)


def test_identical_is_ok_and_shift_is_critical(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0.4, 0.1, 600).clip(0, 1)
    same = drift.check_drift(frame(spark, base, base), "2031-05-06", "2031-06-07").first()
    assert same["psi"] < 0.01 and same["status"] == "ok" and same["baseline_date"] == "2031-05-06"
    moved = drift.check_drift(frame(spark, base, base + 0.4), "", "").first()
    assert moved["status"] == "critical"


def test_status_limits_are_strict(spark):
    got = spark.createDataFrame([(0.1,), (0.11,), (0.2,), (0.21,)], "p double").select(drift.status(F.col("p"))).collect()
    assert [r[0] for r in got] == ["ok", "warning", "warning", "critical"]


def test_job_writes_a_report(spark, tmp_path):
    rows = [(0.1 + 0.001 * (i % 100), 0.5, f"2024-01-{1 + i % 30:02d}") for i in range(600)]
    scored = spark.createDataFrame(rows, "score double, f double, at string").withColumn("at", F.col("at").cast("timestamp"))
    path = str(tmp_path / "report")
    assert drift_job.run(scored, "at", "2024-01-30 00:00:00", ["score", "f"], path)
    (part,) = Path(path).glob("part-*.json")
    report = json.loads(part.read_text())
    assert report["status"] == "ok" and set(report["feature_breakdown"]) == {"score", "f"}
    assert report["thresholds"] == {"warning": 0.1, "critical": 0.2}
    # Every day is less than 30 days old; the last seven of them are current.
    assert (report["n_baseline"], report["n_current"]) == (460, 140)
