"""Features, score, offers and copy for all customers at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from perkwise.operators.nearest import nearest
from perkwise.operators.prompts import fallback_copy
from perkwise.operators.retrieval import TOP_K, retrieve_or_all, with_fallback

# Used where a customer row has no tier or channel.
DEFAULT_TIER = "Gold"
DEFAULT_CHANNEL = "mobile"


def recommend(
    customers: DataFrame, features: DataFrame, scores: DataFrame, vectors: DataFrame,
    offers: DataFrame, k: int = 5, neighbours=nearest,
) -> tuple[DataFrame, DataFrame]:
    """Best offer and copy per customer, and the customers without features.

    customers: customer_id (and tier); features: latest feature rows; scores: customer_id,
    propensity_score, label; vectors: customer_id, embedding of the customer's context.
    """
    missing = customers.select("customer_id").join(features.select("customer_id"), "customer_id", "left_anti")
    known = customers.join(features, "customer_id").join(
        scores.select("customer_id", "propensity_score", F.col("label").alias("propensity_label")), "customer_id"
    )
    queries = known.select("customer_id", "propensity_score").join(vectors, "customer_id").select(
        F.col("customer_id").alias("query_id"), F.col("propensity_score").alias("propensity"), "embedding"
    )
    retrieved = retrieve_or_all(queries, offers, k, neighbours, breadth=max(k, TOP_K))
    best = with_fallback(known.select(F.col("customer_id").alias("query_id")), retrieved)
    tier = F.coalesce("tier", F.lit(DEFAULT_TIER)) if "tier" in customers.columns else F.lit(DEFAULT_TIER)
    result = known.join(best.withColumnRenamed("query_id", "customer_id"), "customer_id").select(
        "customer_id", "propensity_score", "propensity_label",
        tier.alias("tier"),
        F.coalesce("channel_preference", F.lit(DEFAULT_CHANNEL)).alias("channel"),
        "engagement_score",
        "offer_id", "title", "description", "category", F.col("score").alias("offer_score"),
        fallback_copy(F.col("title"), F.col("description")).alias("offer_copy"),
    )
    return result, missing
