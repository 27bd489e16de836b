import numpy as np
import pytest
from pyspark.sql import functions as F

from perkwise.operators.ordering import exact_percentiles, running_totals


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_running_totals(spark, buckets):
    rows = spark.range(400).select((F.col("id") * 1.0).alias("v"), (F.col("id") % 7).alias("n"))
    got = running_totals(rows, "v", ["n"], buckets=buckets).orderBy("v").toPandas()
    assert got.n_before.tolist() == (got.n.cumsum() - got.n).tolist()
    assert set(got.n_total) == {int(got.n.sum())}


def test_percentiles_with_a_hot_value(spark):
    rng = np.random.default_rng(0)
    data = {"a": np.r_[rng.normal(size=300), np.full(200, 0.25)], "b": rng.integers(0, 3, 101).astype(float), "c": np.array([4.0])}
    rows = [(g, float(x)) for g, xs in data.items() for x in xs] + [("a", None)]
    frame = spark.createDataFrame(rows, "g string, x double")
    got = exact_percentiles(frame, "x", {"p10": 0.1, "p50": 0.5, "p95": 0.95}, ("g",), buckets=8).toPandas().set_index("g")
    for g, xs in data.items():
        for name, q in (("p10", 10), ("p50", 50), ("p95", 95)):
            assert got.loc[g, name] == pytest.approx(np.percentile(xs, q), abs=1e-12)
