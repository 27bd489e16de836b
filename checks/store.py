"""Feature-store queries."""

from pyspark.sql import functions as F

from checks import query, sql
from checks.features import compared
from perkwise.operators import store
from perkwise.operators.features import compute_features
from perkwise.plans.seed_store import seed
from perkwise.sources import sample_tables as st
from perkwise.session import scratch_path


def _features(spark, d):
    return compute_features(st.loyalty_events(spark, d), st.REFERENCE_TS)


@query("fst1_required_columns", f"SELECT {sql.FEATURE_SELECT} FROM {sql.features()}")
def required_columns(spark, d):
    return compared(store.require_columns(_features(spark, d)))


_HOLES = f"""(SELECT * REPLACE (CASE WHEN recency_days % 2 = 0 THEN channel_preference END AS channel_preference,
  CASE WHEN frequency_30d > 0 THEN offer_redemption_rate ELSE NULL END AS offer_redemption_rate)
  FROM {sql.features()})"""


@query("fst2_null_gate", f"""SELECT column_name, n_rows, n_missing, n_missing / n_rows AS null_fraction,
  n_missing / n_rows <= 0.05 AS passed FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_missing FROM {_HOLES}"
    for c in store.FEATURE_COLUMNS) + ")")
def null_gate(spark, d):
    holes = _features(spark, d).withColumns({
        "channel_preference": F.when(F.col("recency_days") % 2 == 0, F.col("channel_preference")),
        "offer_redemption_rate": F.when(F.col("frequency_30d") > 0, F.col("offer_redemption_rate"))
        .otherwise(F.lit(float("nan"))),
    })
    return store.null_fractions(holes)


@query("fst3_range_gate", f"""SELECT count(*) AS n_rows, count(*) FILTER (WHERE engagement_score * 2 > 1) AS n_out_of_range,
  count(*) FILTER (WHERE engagement_score * 2 > 1) = 0 AS passed FROM {sql.features()}""")
def range_gate(spark, d):
    return store.range_check(_features(spark, d).withColumn("engagement_score", F.col("engagement_score") * 2))


@query("fst4_write_version", f"""SELECT version, {sql.FEATURE_SELECT}, written_at FROM (
  SELECT 'a' AS version, *, TIMESTAMP '2024-02-16' AS written_at FROM {sql.features()}
  UNION ALL SELECT 'b', *, TIMESTAMP '2024-02-15' FROM {sql.features('2024-02-08 00:00:00')})""")
def write_version(spark, d):
    events, path = st.loyalty_events(spark, d), scratch_path(spark, "store")
    seed(events, path, "a", "2024-02-01 00:00:00", "2024-02-14 00:00:00")
    seed(events, path, "b", "2024-02-08 00:00:00", "2024-02-15 00:00:00")
    return compared(seed(events, path, "a", st.REFERENCE_TS, "2024-02-16 00:00:00"))


@query("fst5_latest_features", f"SELECT {sql.FEATURE_SELECT}, 'v3' AS version FROM {sql.features()}")
def latest_features(spark, d):
    return compared(store.latest_features(st.stored_features(spark, d)))


@query("fst6_list_versions", f"SELECT version, max(written_at) AS written_at FROM {sql.STORED} GROUP BY version")
def list_versions(spark, d):
    return store.list_versions(store.published(spark, st.feature_store(spark, d)))


@query("fst7_feature_stats", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, round(min({c}), 4)::DOUBLE AS min, round(max({c}), 4)::DOUBLE AS max,
    round(avg({c}), 6) AS avg, round(stddev_samp({c}), 6) AS std, count(*) AS count,
    0.0::DOUBLE AS null_percentage FROM {sql.features()}""" for c in store.NUMERIC_FEATURES))
def feature_stats(spark, d):
    stats = store.feature_stats(st.stored_features(spark, d), "v3")
    return stats.select(
        "column_name", F.round("min", 4).alias("min"), F.round("max", 4).alias("max"),
        F.round("avg", 6).alias("avg"), F.round("std", 6).alias("std"), "count", "null_percentage",
    )


@query("fst7_feature_quantiles")
def feature_quantiles(spark, d):
    return store.feature_stats(st.stored_features(spark, d), "v3").select(
        "column_name", "approx_unique", "q25", "q50", "q75"
    )


@query("fst8_newest_version", f"SELECT {sql.FEATURE_SELECT}, TIMESTAMP '2024-02-15' AS written_at, 'v3' AS version FROM {sql.features()}")
def newest_version(spark, d):
    return compared(store.read_newest(spark, st.feature_store(spark, d)))


def _vectors(spark, d, version):
    rows = st.stored_features(spark, d).filter(F.col("version") == version)
    return store.to_vectors(rows, F.col("written_at"))


def _flat(vectors):
    return vectors.withColumns({
        "feature_names": F.array_join("feature_names", ","),
        "values": F.round(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 7),
    })


_NAMES = ",".join(store.NUMERIC_FEATURES)
_TOTAL = " + ".join(f"{c}::DOUBLE" for c in store.NUMERIC_FEATURES)
_VECTOR = f"""customer_id, '{_NAMES}' AS feature_names, round({_TOTAL}, 7) AS "values", written_at AS computed_at"""
# Each customer is in the old rows, the new ones or both.
_OLD = f"SELECT * FROM {sql.STORED} WHERE version = 'v1' AND CAST(customer_id AS BIGINT) % 3 <> 2"
_NEW = f"SELECT * FROM {sql.STORED} WHERE version = 'v3' AND CAST(customer_id AS BIGINT) % 3 <> 0"


@query("fst9_upsert_vectors", f"""SELECT {_VECTOR} FROM ({_NEW}) UNION ALL
  SELECT {_VECTOR} FROM ({_OLD}) WHERE customer_id NOT IN (SELECT customer_id FROM ({_NEW}))""")
def upsert_vectors(spark, d):
    rows = st.stored_features(spark, d)
    old = store.to_vectors(rows.filter("version = 'v1' and cast(customer_id as bigint) % 3 <> 2"), F.col("written_at"))
    new = store.to_vectors(rows.filter("version = 'v3' and cast(customer_id as bigint) % 3 <> 0"), F.col("written_at"))
    return _flat(store.upsert_vectors(old, new))


_HOT = f"SELECT * FROM {sql.STORED} WHERE version = 'v3' AND CAST(customer_id AS BIGINT) % 3 <> 2"
_COLD = f"SELECT * FROM {sql.STORED} WHERE version = 'v2'"
_IDS = "(SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS customer_id FROM orders)"


@query("fst10_hot_cold_lookup", f"""SELECT {_VECTOR}, true AS from_hot FROM ({_HOT}) WHERE customer_id IN {_IDS}
  UNION ALL SELECT {_VECTOR}, false FROM ({_COLD}) WHERE customer_id IN {_IDS}
  AND customer_id NOT IN (SELECT customer_id FROM ({_HOT}))""")
def hot_cold_lookup(spark, d):
    rows = st.stored_features(spark, d)
    fresh = rows.filter("version = 'v3' and cast(customer_id as bigint) % 3 <> 2")
    stale = rows.filter("version = 'v1'")  # past its day, so never served
    hot = store.to_vectors(fresh.unionByName(stale), F.col("written_at"))
    cold = store.to_vectors(rows.filter("version = 'v2'"), F.col("written_at"))
    ids = st.transactions(spark, d).select("customer_id")
    # The cache holds one row per customer, the last one written.
    hot = store.keep_last(hot, ["customer_id"], ["computed_at"])
    return _flat(store.lookup(ids, hot, cold, "2024-02-15 12:00:00"))


@query("fst11_vector_json", f"""SELECT {_VECTOR}, '["' || replace('{_NAMES}', ',', '","') || '"]' AS names_json,
  frequency_30d::DOUBLE AS frequency FROM {sql.STORED} WHERE version = 'v3'""")
def vector_json(spark, d):
    encoded = store.vectors_to_json(_vectors(spark, d, "v3"))
    back = store.vectors_from_json(encoded)
    named = store.as_map(back).select("customer_id", F.col("features")["frequency_30d"].alias("frequency"))
    return (
        _flat(back).join(encoded.select("customer_id", F.col("feature_names").alias("names_json")), "customer_id")
        .join(named, "customer_id")
    )
