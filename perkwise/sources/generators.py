"""Seeded synthetic events, offers and scores, one row per id of the given frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from perkwise.functions.draws import (
    choice, digest, integer, normal, uniform, uuid_text, weighted_choice,
)
from perkwise.functions.numbers import clip, round_exact

# Event mix, channels and offer attributes.
EVENT_TYPES = ["purchase", "app_open", "offer_view", "redeem"]
EVENT_WEIGHTS = [0.35, 0.40, 0.15, 0.10]
CHANNELS = ["mobile", "web", "in-store"]
CHANNEL_WEIGHTS = [0.55, 0.25, 0.20]
OFFER_POOL = 200
OFFER_CATEGORIES = ["food", "beverage", "merchandise", "bonus_stars", "seasonal"]
OFFER_CHANNELS = ["mobile", "all", "in-store"]
EXPIRY_DAYS = [7, 14, 30, 60, 90]


def generate_events(
    ids: DataFrame, now: str, n_customers: int = 5000, horizon_days: int = 180, seed: int = 42
) -> DataFrame:
    """One event per ``id``: uniform customer and time, weighted type and channel, log-normal spend."""
    first = digest(F.col("id"), seed, "event")
    second = digest(F.col("id"), seed, "detail")
    kind = weighted_choice(uniform(first, 1), EVENT_TYPES, EVENT_WEIGHTS)
    customer = integer(uniform(first, 0), 0, n_customers)
    offer = integer(uniform(second, 2), 0, OFFER_POOL)
    offset = F.floor(uniform(first, 3) * F.lit(float(horizon_days * 86_400)))
    spend = round_exact(F.exp(F.lit(3.2) + F.lit(0.8) * normal(second, 0)), 2)
    drawn = ids.select("id", first.alias("_a"), second.alias("_b"), kind.alias("event_type"),
                       customer.alias("_c"), offer.alias("_o"), offset.alias("_s"), spend.alias("_spend"))
    return drawn.select(
        "id",
        uuid_text(digest(F.col("_c"), seed, "customer")).alias("customer_id"),
        "event_type",
        F.timestamp_micros(
            F.unix_micros(F.lit(now).cast("timestamp")) - F.col("_s") * F.lit(1_000_000)
        ).alias("timestamp"),
        F.when(F.col("event_type") == "purchase", F.col("_spend")).alias("amount"),
        F.when(
            F.col("event_type").isin("offer_view", "redeem"),
            uuid_text(digest(F.col("_o"), seed, "offer")),
        ).alias("offer_id"),
        weighted_choice(uniform(F.col("_b"), 3), CHANNELS, CHANNEL_WEIGHTS).alias("channel"),
    )


def generate_offers(ids: DataFrame, titles: list[str], descriptions: list[str], seed: int = 42) -> DataFrame:
    """One offer per ``id``; texts are drawn from the given pools."""
    a = digest(F.col("id"), seed, "offer-kind")
    b = digest(F.col("id"), seed, "offer-terms")
    return ids.select(
        F.concat(F.lit("offer_"), F.lpad((F.col("id") + 1).cast("string"), 4, "0")).alias("id"),
        choice(uniform(a, 0), titles).alias("title"),
        choice(uniform(a, 1), descriptions).alias("description"),
        choice(uniform(a, 2), OFFER_CATEGORIES).alias("category"),
        choice(uniform(a, 3), OFFER_CHANNELS).alias("channel"),
        round_exact(uniform(b, 0) * F.lit(0.7), 2).alias("min_propensity_threshold"),
        integer(uniform(b, 1), 5, 41).alias("discount_pct"),
        choice(uniform(b, 2), EXPIRY_DAYS).alias("expiry_days"),
    )


def generate_scores(ids: DataFrame, mean: float, std: float, seed: int = 42) -> DataFrame:
    """One normal score per ``id``, limited to [0, 1]."""
    z = normal(digest(F.col("id"), seed, "score"), 0)
    return ids.select("id", clip(F.lit(mean) + F.lit(std) * z, 0.0, 1.0).alias("score"))
