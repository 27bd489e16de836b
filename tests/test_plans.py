from pyspark.sql import functions as F

from perkwise import schemas
from perkwise.plans import etl
from perkwise.plans.recommend import recommend

NOW = "2024-01-01 00:00:00"


def test_etl_counts_and_snapshots(spark):
    tx = spark.createDataFrame([("t1", "c", 1.0, "USD", "s", "[]", None)], schemas.TRANSACTIONS)
    raw = spark.createDataFrame([("t1", "c", "9", None, "s", None, None, 1), ("t2", "c", "2", None, "s", None, None, 2),
                                 ("t2", "c", "3", None, "s", None, None, 3), ("t3", None, "2", None, "s", None, None, 4)],
        "transaction_id string, customer_id string, amount string, currency string, store_id string, items string, created_at string, arrival int")
    customers = spark.createDataFrame([], schemas.CUSTOMERS)
    raw_customers = spark.createDataFrame([("1", "a@x", None, None, None, None, None, 1)],
        "customer_id string, email string, tier string, total_spend string, visit_count string, created_at string, updated_at string, arrival int")
    new_tx, new_customers, counts = etl.run(tx, raw, customers, raw_customers, NOW)
    assert {r["transaction_id"]: r["amount"] for r in new_tx.collect()} == {"t1": 1.0, "t2": 2.0}
    assert new_customers.first()["tier"] == "standard"
    assert {r["table_name"]: r["written"] for r in counts.collect()} == {"transactions": 1, "customers": 1}


def test_recommendations(spark):
    features = spark.createDataFrame([("a", 1, 2, 3.0, 0.5, None, 0.9), ("b", 1, 2, 3.0, 0.5, "web", 0.1)], schemas.FEATURES)
    customers = spark.createDataFrame([("a",), ("b",), ("nobody",)], "customer_id string")
    scores = features.select("customer_id", F.col("engagement_score").alias("propensity_score"), F.lit(1).alias("label"))
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "customer_id string, embedding array<float>")
    offers = spark.createDataFrame([("x", "X", "Dx", "food", 0.5, [1.0, 0.0]), ("y", "Y", "Dy", "food", 0.0, [0.9, 0.1])],
        "id string, title string, description string, category string, min_propensity_threshold double, embedding array<float>")
    result, missing = recommend(customers, features, scores, vectors, offers)
    got = {r["customer_id"]: (r["tier"], r["channel"], r["offer_id"], r["offer_copy"]["headline"]) for r in result.collect()}
    assert got == {"a": ("Gold", "mobile", "x", "Special offer: X"), "b": ("Gold", "web", "y", "Special offer: Y")}
    assert [r[0] for r in missing.collect()] == ["nobody"]
    none, _ = recommend(customers, features, scores, vectors, offers.filter("false"))
    assert {r["offer_id"] for r in none.collect()} == {"fallback"}
