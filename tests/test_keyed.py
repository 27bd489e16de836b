from pyspark.sql import functions as F

from perkwise.operators import keyed


def test_insert_ignore_keeps_what_is_there_and_the_first_of_a_batch(spark):
    old = spark.createDataFrame([(1, "old")], "id int, v string")
    batch = spark.createDataFrame([(1, "new", 1), (2, "late", 2), (2, "early", 1)], "id int, v string, arrival int")
    got = {tuple(r) for r in keyed.insert_ignore(old, batch, ["id"], ["arrival"]).collect()}
    assert got == {(1, "old"), (2, "early")}


def test_upsert_preserves_the_first_creation(spark):
    old = spark.createDataFrame([(1, "old", 10), (3, "same", 30)], "id int, v string, created int")
    batch = spark.createDataFrame(
        [(1, "a", 11, 1), (1, None, 12, 2), (2, "x", 21, 1), (2, "y", 22, 2)], "id int, v string, created int, arrival int")
    got = {tuple(r) for r in keyed.upsert(old, batch, ["id"], ["arrival"], preserve=["created"]).collect()}
    assert got == {(1, None, 10), (2, "y", 21), (3, "same", 30)}


def test_top_k_with_hot_keys_is_exact(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"),
        F.pmod(F.xxhash64("id"), F.lit(10_000)).alias("v"), "id",
    ).repartition(16)
    order = [F.asc("v"), F.asc("id")]
    plain = keyed.top_k(rows, ["k"], order, 7).toPandas()
    hot = keyed.top_k(rows, ["k"], order, 7, hot_keys=True, stripes=5).toPandas()
    by = ["k", "rank"]
    assert plain.sort_values(by).values.tolist() == hot[plain.columns].sort_values(by).values.tolist()
    assert plain.groupby("k").size().max() == 7
