import pytest
from pyspark.sql import functions as F

from perkwise import schemas
from perkwise.operators import store

ROW = ("c1", 1, 2, 3.0, 0.5, "web", 0.5)


def features(spark, rows):
    return spark.createDataFrame(rows, schemas.FEATURES)


def test_missing_column_is_refused(spark):
    with pytest.raises(store.FeatureValidationError, match="engagement_score"):
        store.validate(features(spark, [ROW]).drop("engagement_score"))


def test_null_limit_is_strict_and_nan_counts(spark):
    rows = [ROW] * 19 + [("c2", 1, 2, float("nan"), 0.5, "web", 0.5)]
    store.validate(features(spark, rows))  # exactly 5 %
    with pytest.raises(store.FeatureValidationError, match="monetary_90d"):
        store.validate(features(spark, rows[1:]))
    got = {r["column_name"]: r["null_fraction"] for r in store.null_fractions(features(spark, rows)).collect()}
    assert got["monetary_90d"] == 0.05 and got["recency_days"] == 0.0


def test_empty_frame_passes(spark):
    store.validate(features(spark, []))


@pytest.mark.parametrize("score", [1.5, -0.1])
def test_score_out_of_range_is_refused(spark, score):
    with pytest.raises(store.FeatureValidationError, match="outside"):
        store.validate(features(spark, [(*ROW[:-1], score)]))


def test_score_limits_and_missing_scores_pass(spark):
    rows = [(*ROW[:-1], s) for s in (0.0, 1.0)] + [ROW] * 40 + [(*ROW[:-1], None)]
    store.validate(features(spark, rows))


def test_versions_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write_version(features(spark, [ROW, ("c2", *ROW[1:])]), path, "v1", "2024-01-01 00:00:00")
    store.write_version(features(spark, [("c1", 9, *ROW[2:])]), path, "v2", "2024-01-02 00:00:00")
    store.write_version(features(spark, [ROW, ("c3", *ROW[1:])]), path, "v1", "2024-01-01 12:00:00")
    stored = store.read_store(spark, path)
    assert stored.count() == 3
    assert [r["version"] for r in store.list_versions(stored).collect()] == ["v2", "v1"]
    latest = {r["customer_id"]: (r["version"], r["recency_days"]) for r in store.latest_features(stored).collect()}
    assert latest == {"c1": ("v2", 9), "c3": ("v1", 1)}
    assert [r["customer_id"] for r in store.newest_version(stored).collect()] == ["c1"]
    stats = {r["column_name"]: r for r in store.feature_stats(stored, "v1").collect()}
    assert set(stats) == set(schemas.NUMERIC_FEATURES) and stats["monetary_90d"]["count"] == 2


def test_newest_version_reads_one_partition(spark, tmp_path):
    path = str(tmp_path / "store")
    for i in (1, 2, 3):
        store.write_version(features(spark, [ROW]), path, f"v{i}", f"2024-01-0{i} 00:00:00")
    out = store.newest_version(store.read_store(spark, path))
    assert "PartitionFilters: [isnotnull(version" in out._jdf.queryExecution().executedPlan().toString()


def test_hot_row_expires_after_a_day(spark):
    def vectors(rows):
        return spark.createDataFrame(rows, "customer_id string, feature_names array<string>, `values` array<double>, at string").select(
            "customer_id", "feature_names", "values", F.col("at").cast("timestamp").alias("computed_at"))

    hot = vectors([("a", ["x"], [1.0], "2024-01-02 00:00:01"), ("b", ["x"], [1.0], "2024-01-02 00:00:00")])
    cold = vectors([("a", ["x"], [2.0], "2020-01-01"), ("b", ["x"], [2.0], "2020-01-01"), ("z", ["x"], [2.0], "2020-01-01")])
    ids = spark.createDataFrame([("a",), ("b",), ("missing",), ("a",)], "customer_id string")
    got = {r["customer_id"]: (r["values"][0], r["from_hot"]) for r in store.lookup(ids, hot, cold, "2024-01-03 00:00:00").collect()}
    assert got == {"a": (1.0, True), "b": (2.0, False)}


def test_failed_gates_publish_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.read_store(spark, path).count() == 0 and store.read_newest(spark, path).count() == 0
    store.write_version(features(spark, [ROW]), path, "v1", "2024-01-01 00:00:00")
    with pytest.raises(store.FeatureValidationError, match="outside"):
        store.write_version(features(spark, [(*ROW[:-1], 1.5)]), path, "v2", "2024-01-02 00:00:00")
    with pytest.raises(store.FeatureValidationError, match="monetary_90d"):
        store.write_version(features(spark, [("c9", 1, 2, None, 0.5, "web", 0.5)]), path, "v1", "2024-01-03 00:00:00")
    assert [tuple(r) for r in store.read_store(spark, path).select("customer_id", "version").collect()] == [("c1", "v1")]
    assert [r["version"] for r in store.list_versions(store.published(spark, path)).collect()] == ["v1"]
    log = store.publish_log(spark, path).collect()
    assert [(r["number"], r["version"], r["n_rows"]) for r in log] == [(1, "v1", 1)]


def test_features_are_computed_once_per_write(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            runs.add(len(batch))
            yield batch

    rows = features(spark, [ROW, ("c2", *ROW[1:])]).mapInPandas(seen, schemas.FEATURES)
    store.write_version(rows, str(tmp_path / "store"), "a/b=c", "2024-01-01 00:00:00")
    assert runs.value == 2 and store.read_newest(spark, str(tmp_path / "store")).select("version").distinct().first()[0] == "a/b=c"


def test_versions_come_from_the_log(spark, tmp_path):
    path = str(tmp_path / "store")
    for i in (1, 2, 1):
        store.write_version(features(spark, [ROW]), path, f"v{i}", f"2024-01-0{i} 00:00:00")
    assert all("/log/" in f for f in store.list_versions(store.published(spark, path)).inputFiles())
    assert {f.split("version=")[1][:2] for f in [r[0] for r in store.read_newest(spark, path).select(F.input_file_name()).collect()]} == {"v2"}
    assert store.read_store(spark, path).count() == 2
