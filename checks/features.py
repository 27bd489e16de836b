"""Feature queries."""

from pyspark.sql import DataFrame, functions as F

from checks import query, sql
from perkwise.operators import features as fe
from perkwise.sources import sample_tables as st


def _rfm(spark, d) -> DataFrame:
    return fe.rfm(st.loyalty_events(spark, d), st.REFERENCE_TS)


def compared(features: DataFrame) -> DataFrame:
    """Money rounded: a sum of doubles depends on the order of additions."""
    return features.withColumn("monetary_90d", F.round("monetary_90d", 4))


@query("fea1_recency_days", f"SELECT customer_id, recency_days FROM {sql.rfm()}")
def recency(spark, d):
    return _rfm(spark, d).select("customer_id", "recency_days")


@query("fea2_frequency_30d", f"SELECT customer_id, frequency_30d FROM {sql.rfm()}")
def frequency(spark, d):
    return _rfm(spark, d).select("customer_id", "frequency_30d")


@query("fea3_monetary_90d", f"SELECT customer_id, round(monetary_90d, 4) AS monetary_90d FROM {sql.rfm()}")
def monetary(spark, d):
    return compared(_rfm(spark, d)).select("customer_id", "monetary_90d")


@query("fea4_offer_redemption_rate", f"SELECT customer_id, offer_redemption_rate FROM {sql.rfm()}")
def redemption(spark, d):
    return _rfm(spark, d).select("customer_id", "offer_redemption_rate")


@query("fea5_channel_preference", f"SELECT customer_id, channel_preference FROM {sql.rfm()}")
def channel(spark, d):
    return _rfm(spark, d).select("customer_id", "channel_preference")


@query("fea6_base_features", f"""SELECT customer_id, recency_days, frequency_30d,
  round(monetary_90d, 4) AS monetary_90d, offer_redemption_rate, channel_preference FROM {sql.rfm()}""")
def base(spark, d):
    return compared(_rfm(spark, d))


@query("fea7_minmax_scaled", f"""SELECT customer_id, round(frequency_30d_scaled, 9) AS frequency_30d_scaled,
  round(monetary_90d_scaled, 9) AS monetary_90d_scaled,
  round(offer_redemption_rate_scaled, 9) AS offer_redemption_rate_scaled FROM {sql.scaled()}""")
def scaled(spark, d):
    out = fe.normalised(_rfm(spark, d))
    return out.select("customer_id", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@query("fea8_customer_features", f"SELECT {sql.FEATURE_SELECT} FROM {sql.features()}")
def customer_features(spark, d):
    return compared(fe.compute_features(st.loyalty_events(spark, d), st.REFERENCE_TS))
