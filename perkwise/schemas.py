"""Explicit schemas of every domain table; readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()), "array<double>": T.ArrayType(T.DoubleType()),
}


def _struct(*fields: tuple[str, str]) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


EVENTS = _struct(
    ("customer_id", "string"), ("event_type", "string"), ("timestamp", "timestamp"),
    ("amount", "double"), ("offer_id", "string"), ("channel", "string"),
)

FEATURES = _struct(
    ("customer_id", "string"), ("recency_days", "int"), ("frequency_30d", "int"),
    ("monetary_90d", "double"), ("offer_redemption_rate", "double"),
    ("channel_preference", "string"), ("engagement_score", "double"),
)

STORED_FEATURES = _struct(
    ("customer_id", "string"), ("recency_days", "int"), ("frequency_30d", "int"),
    ("monetary_90d", "double"), ("offer_redemption_rate", "double"),
    ("channel_preference", "string"), ("engagement_score", "double"),
    ("written_at", "timestamp"), ("version", "string"),
)

TRANSACTIONS = _struct(
    ("transaction_id", "string"), ("customer_id", "string"), ("amount", "double"),
    ("currency", "string"), ("store_id", "string"), ("items", "string"),
    ("created_at", "timestamp"),
)

CUSTOMERS = _struct(
    ("customer_id", "string"), ("email", "string"), ("tier", "string"),
    ("total_spend", "double"), ("visit_count", "int"),
    ("created_at", "timestamp"), ("updated_at", "timestamp"),
)

FEATURE_VECTORS = _struct(
    ("customer_id", "string"), ("feature_names", "array<string>"),
    ("values", "array<double>"), ("computed_at", "timestamp"),
)

FEEDBACK = _struct(
    ("id", "bigint"), ("offer_id", "string"), ("customer_id", "string"),
    ("generated_copy", "string"), ("rating", "int"), ("thumbs", "string"),
    ("prompt_version", "string"), ("model_version", "string"), ("created_at", "timestamp"),
)

FEEDBACK_EVENTS = _struct(
    ("customer_id", "string"), ("request_id", "string"), ("event_type", "string"),
    ("metadata", "string"), ("created_at", "timestamp"),
)

LLM_CALLS = _struct(
    ("request_id", "string"), ("model", "string"), ("prompt_tokens", "int"),
    ("completion_tokens", "int"), ("latency_ms", "double"), ("score", "double"),
    ("created_at", "timestamp"),
)

OFFERS = _struct(
    ("id", "string"), ("title", "string"), ("description", "string"), ("category", "string"),
    ("channel", "string"), ("min_propensity_threshold", "double"),
    ("discount_pct", "int"), ("expiry_days", "int"),
)

EVAL_RUN = _struct(
    ("timestamp", "string"), ("n", "bigint"), ("mean_aggregate_score", "double"),
    ("mean_score", "double"), ("passed", "boolean"),
)

FEATURE_COLUMNS = [
    "recency_days", "frequency_30d", "monetary_90d",
    "offer_redemption_rate", "channel_preference", "engagement_score",
]
NUMERIC_FEATURES = [c for c in FEATURE_COLUMNS if c != "channel_preference"]
