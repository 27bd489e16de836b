"""Ingestion queries."""

from pyspark.sql import functions as F

from checks import SQL, query, sql
from perkwise.operators import ingest as ing
from perkwise.plans import etl
from perkwise.sources import sample_tables as st

NOW = "2024-02-15 00:00:00"


_FAILED = """concat_ws(',', CASE WHEN o_orderkey % 19 = 0 THEN 'customer_id' END,
  CASE WHEN o_orderkey % 13 = 0 THEN 'amount' END, CASE WHEN o_orderkey % 11 = 0 THEN 'store_id' END)"""


@query("ing1_validate_transactions", f"""SELECT
  CASE WHEN o_orderkey % 17 <> 0 THEN CAST(o_orderkey AS VARCHAR) ELSE {sql.uuid_text(
    "md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_custkey AS VARCHAR) END, "
    "CASE WHEN o_orderkey % 11 <> 0 THEN 'store-' || (o_custkey % 10) END))")} END AS transaction_id,
  CASE WHEN o_orderkey % 19 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS customer_id,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS amount,
  CASE WHEN o_orderstatus = 'F' THEN 'EUR' ELSE 'USD' END AS currency,
  CASE WHEN o_orderkey % 11 <> 0 THEN 'store-' || (o_custkey % 10) END AS store_id,
  '[]' AS items, o_orderdate AS created_at, {_FAILED} AS reasons FROM orders""")
def validate_transactions(spark, d):
    checked = ing.check_transactions(st.raw_transactions(spark, d), NOW)
    return checked.rows.drop("arrival").withColumn("reasons", F.array_join("reasons", ","))


@query("ing2_insert_ignore", f"""SELECT transaction_id, customer_id, amount, store_id, created_at FROM {sql.TRANSACTION_SNAPSHOT}
  UNION ALL SELECT transaction_id, customer_id, amount, store_id, created_at FROM {sql.TRANSACTION_BATCH}
  WHERE arrival = 1 AND transaction_id NOT IN (SELECT transaction_id FROM {sql.TRANSACTION_SNAPSHOT})""")
def insert_ignore(spark, d):
    out = ing.insert_transactions(st.transaction_snapshot(spark, d), st.transaction_batch(spark, d))
    return out.drop("items", "currency")


@query("ing2_bucketed_insert", SQL["ing2_insert_ignore"])
def bucketed_insert(spark, d):
    table = st.bucketed(st.transaction_snapshot(spark, d), ["transaction_id"])
    batch = st.transaction_batch(spark, d)
    table.insert_ignore(batch, ["arrival"], "late")
    # The same delivery again changes nothing.
    table.insert_ignore(batch, ["arrival"], "late")
    return table.read().drop("items", "currency")


@query("ing3_items_json", """SELECT CAST(l_orderkey AS VARCHAR) AS transaction_id,
  to_json(list({'line': l_linenumber, 'part': l_partkey, 'quantity': l_quantity, 'price': l_extendedprice}
    ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice))::VARCHAR AS items,
  count(*) AS n_items, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey""")
def items_json(spark, d):
    encoded = st.order_items(spark, d).withColumn("items", ing.encode_items(F.col("items")))
    back = ing.decode_items(F.col("items"), "struct<line:int,part:bigint,quantity:double,price:double>")
    return encoded.withColumn("_back", back).select(
        "transaction_id", "items", F.size("_back").cast("bigint").alias("n_items"),
        F.aggregate("_back", F.lit(0.0), lambda total, item: total + item["quantity"]).alias("quantity"),
    )


@query("ing4_upsert_customers", f"""SELECT coalesce(n.customer_id, o.customer_id) AS customer_id,
  coalesce(n.email, o.email) AS email, coalesce(n.tier, o.tier) AS tier,
  coalesce(n.total_spend, o.total_spend) AS total_spend,
  CAST(coalesce(n.visit_count + 1, o.visit_count) AS INT) AS visit_count,
  coalesce(o.created_at, n.created_at) AS created_at, coalesce(n.updated_at, o.updated_at) AS updated_at
  FROM {sql.CUSTOMER_SNAPSHOT} o FULL JOIN {sql.CUSTOMER_RECENT} n ON o.customer_id = n.customer_id""")
def upsert_customers(spark, d):
    return ing.upsert_customers(st.customer_snapshot(spark, d), st.customer_batch(spark, d))


@query("ing4_bucketed_upsert", SQL["ing4_upsert_customers"])
def bucketed_upsert(spark, d):
    table = st.bucketed(st.customer_snapshot(spark, d), ["customer_id"])
    batch = st.customer_batch(spark, d)
    for name in ("recent", "recent"):
        table.upsert(batch, ["arrival"], ["created_at"], name)
    return table.read()


@query("ing5_etl_counts", f"""SELECT 'transactions' AS table_name, count(*) AS written FROM (SELECT *, CASE WHEN o_orderkey % 17 <> 0
    THEN CAST(o_orderkey AS VARCHAR) END AS tid FROM orders) WHERE {_FAILED} = ''
    AND (tid IS NULL OR tid NOT IN (SELECT transaction_id FROM {sql.TRANSACTION_SNAPSHOT}))
  UNION ALL SELECT 'customers', 2 * count(*) FROM {sql.CUSTOMER_RECENT}""")
def etl_counts(spark, d):
    _, _, counts = etl.run(
        st.transaction_snapshot(spark, d), st.raw_transactions(spark, d),
        st.customer_snapshot(spark, d), st.customer_batch(spark, d), NOW,
    )
    return counts


@query("ing6_validate_feedback_events", f"""SELECT *, CASE WHEN event_type IN ('click', 'redeem', 'ignore', 'unsubscribe')
  THEN '' ELSE 'event_type' END AS reasons FROM {sql.FEEDBACK_EVENTS}""")
def validate_feedback_events(spark, d):
    checked = ing.check_feedback_events(st.feedback_events(spark, d), NOW)
    return checked.rows.withColumn("reasons", F.array_join("reasons", ","))


@query("ing7_validate_ratings", f"""SELECT id, offer_id, customer_id, generated_copy, rating + id % 2 AS rating,
  CASE WHEN id % 9 = 0 THEN 'sideways' ELSE thumbs END AS thumbs, prompt_version, '' AS model_version, created_at,
  concat_ws(',', CASE WHEN rating + id % 2 > 5 THEN 'rating' END, CASE WHEN id % 9 = 0 THEN 'thumbs' END) AS reasons
  FROM (SELECT * REPLACE (CAST(rating AS BIGINT) AS rating) FROM {sql.FEEDBACK})""")
def validate_ratings(spark, d):
    raw = st.feedback(spark, d).withColumns({
        "rating": F.col("rating") + F.col("id") % 2,
        "thumbs": F.when(F.col("id") % 9 == 0, "sideways").otherwise(F.col("thumbs")),
        "model_version": F.lit(None).cast("string"),
    })
    checked = ing.check_ratings(raw, NOW)
    return checked.rows.withColumn("reasons", F.array_join("reasons", ",")).withColumn(
        "rating", F.col("rating").cast("bigint")
    )


@query("ing8_insert_calls", f"""SELECT request_id, model, prompt_tokens, latency_ms, created_at FROM {sql.CALLS}
  WHERE created_at < TIMESTAMP '2024-01-20'
  UNION ALL SELECT request_id, model, prompt_tokens + 1, latency_ms, created_at FROM {sql.CALLS}
  WHERE created_at >= TIMESTAMP '2024-01-20'""")
def insert_calls(spark, d):
    calls = st.llm_calls(spark, d)
    existing = calls.filter("created_at < timestamp'2024-01-20'")
    batch = calls.filter("created_at >= timestamp'2024-01-10'").withColumn(
        "prompt_tokens", F.col("prompt_tokens") + 1
    )
    return ing.insert_calls(existing, batch).select(
        "request_id", "model", "prompt_tokens", "latency_ms", "created_at"
    )
