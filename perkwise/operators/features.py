"""Per-customer recency, frequency, monetary, redemption and engagement features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from perkwise.functions.numbers import minmax, ratio, round_scaled
from perkwise.functions.times import before, elapsed_days

# Weights of the engagement score.
ENGAGEMENT_WEIGHTS = {
    "frequency_30d": 0.30,
    "monetary_90d": 0.40,
    "offer_redemption_rate": 0.30,
}

def rfm(events: DataFrame, reference_ts: str) -> DataFrame:
    """One row per customer from a single pass over the events (null customers are dropped).

    Counting per customer and channel first makes the modal channel a comparison of a few counts,
    and keeps both aggregations free of per-customer value maps.
    """
    ts, kind = F.col("timestamp"), F.col("event_type")
    is_recent_purchase = (kind == "purchase") & (ts >= before(reference_ts, 90))
    amount = F.when(is_recent_purchase, F.nanvl(F.col("amount"), F.lit(None).cast("double")))
    per_channel = (
        events.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id", "channel")
        .agg(
            F.max(ts).alias("_last"),
            F.count_if(ts >= before(reference_ts, 30)).alias("_recent"),
            F.sum(amount).alias("_spend"),
            F.count_if(kind == "offer_view").alias("_views"),
            F.count_if(kind == "redeem").alias("_redeems"),
            F.count(F.lit(1)).alias("_events"),
        )
    )
    # Most frequent first, ties by name; a missing channel comes after every known one.
    preference = F.struct(F.col("channel").isNull(), -F.col("_events"), F.col("channel"))
    grouped = per_channel.groupBy("customer_id").agg(
        F.max("_last").alias("_last"),
        *[F.sum(c).alias(c) for c in ("_recent", "_spend", "_views", "_redeems")],
        F.min_by("channel", preference).alias("channel_preference"),
    )
    return grouped.select(
        "customer_id",
        F.coalesce(elapsed_days(F.col("_last"), reference_ts), F.lit(0)).alias("recency_days"),
        F.col("_recent").cast("int").alias("frequency_30d"),
        F.coalesce("_spend", F.lit(0.0)).alias("monetary_90d"),
        F.least(ratio(F.col("_redeems"), F.col("_views")), F.lit(1.0)).alias("offer_redemption_rate"),
        "channel_preference",
    )


def _scaled(features: DataFrame) -> dict[str, Column]:
    """Min-max columns; the global limits come from one scalar subquery over the same features."""
    limits = features.agg(
        F.struct(
            *[F.min(c).cast("double").alias(f"{c}_low") for c in ENGAGEMENT_WEIGHTS],
            *[F.max(c).cast("double").alias(f"{c}_high") for c in ENGAGEMENT_WEIGHTS],
            # Touching the remaining columns keeps both aggregations identical,
            # so the exchange below them is computed once and reused.
            F.max("recency_days").alias("recency_high"),
            F.count("channel_preference").alias("with_channel"),
        ).alias("limits")
    ).scalar()
    return {
        c: minmax(F.col(c).cast("double"), limits[f"{c}_low"], limits[f"{c}_high"])
        for c in ENGAGEMENT_WEIGHTS
    }


def normalised(features: DataFrame) -> DataFrame:
    """The three score inputs scaled to [0, 1] over all customers."""
    return features.select(
        "customer_id", *[col.alias(f"{name}_scaled") for name, col in _scaled(features).items()]
    )


def with_engagement(features: DataFrame) -> DataFrame:
    """Add the weighted engagement score in [0, 1], rounded to six digits."""
    score = None
    for name, col in _scaled(features).items():
        term = col * F.lit(ENGAGEMENT_WEIGHTS[name])
        score = term if score is None else score + term
    return features.withColumn("engagement_score", round_scaled(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)), 6))


def compute_features(events: DataFrame, reference_ts: str) -> DataFrame:
    """Events to one feature row per customer, as of ``reference_ts``."""
    return with_engagement(rfm(events, reference_ts))
