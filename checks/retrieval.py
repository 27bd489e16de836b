"""Vector retrieval queries."""

from pyspark.sql import functions as F

from checks import query, sql
from perkwise.operators import nearest as nn, retrieval as rt
from perkwise.sources import sample_tables as st


def _vector_sum(frame):
    return frame.withColumn(
        "total", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6)
    ).drop("embedding")


_TOTAL = "round(list_sum(embedding::DOUBLE[]), 6) AS total"


@query("ret1_embed_texts", f"""SELECT id, 384 AS dimensions, 1.0::DOUBLE AS norm FROM {sql.OFFERS}""")
def embed_texts(spark, d):
    rows = rt.embed_hashed(st.offers(spark, d).drop("embedding"), "description")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return rows.select("id", F.size("embedding").alias("dimensions"), F.round(norm, 5).alias("norm"))


@query("ret1_embed_with_encoder", f"""SELECT id, len(description)::DOUBLE AS first, 1.0::DOUBLE AS second FROM {sql.OFFERS}""")
def embed_with_encoder(spark, d):
    def make():
        return lambda texts: [[len(t), 1.0] for t in texts]

    rows = rt.embed_with(st.offers(spark, d).drop("embedding"), make, "description")
    return rows.select("id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(("first", "second"))])


def _stored(spark, d):
    return st.offers(spark, d).select("id", "title", "embedding")


def _batch(spark, d):
    """All vectors under shifted ids, so some are new and most are known; each arrives twice."""
    return st.table(spark, d, "embeddings").select(
        F.concat(F.lit("offer_"), F.lpad((F.col("vec_id") + 100).cast("string"), 7, "0")).alias("id"),
        F.concat(F.lit("New "), F.col("vec_id").cast("string")).alias("title"),
        F.reverse("embedding").alias("embedding"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("arrival"),
    ).withColumn("title", F.concat_ws("-", "title", "arrival"))


_NEW = """(SELECT 'offer_' || lpad(CAST(vec_id + 100 AS VARCHAR), 7, '0') AS id, 'New ' || vec_id || '-2' AS title, embedding
  FROM embeddings)"""


@query("ret2_upsert_embeddings", f"""SELECT id, title, {_TOTAL} FROM {_NEW} UNION ALL SELECT id, title, {_TOTAL} FROM {sql.OFFERS}
  WHERE id NOT IN (SELECT id FROM {_NEW})""")
def upsert_embeddings(spark, d):
    return _vector_sum(rt.upsert_embeddings(_stored(spark, d), _batch(spark, d)))


@query("ret3_reembed", f"""SELECT id, title, CASE WHEN category = '3' THEN len(description)::DOUBLE + 1
  ELSE round(list_sum(embedding::DOUBLE[]), 6) END AS total FROM {sql.OFFERS}""")
def reembed(spark, d):
    offers = st.offers(spark, d)

    def make():
        return lambda texts: [[len(t), 1.0] for t in texts]

    chosen = offers.filter("category = '3'").select("id")
    return _vector_sum(rt.reembed(
        _stored(spark, d), offers.drop("embedding"), chosen, lambda rows: rt.embed_with(rows, make, "description")
    ))


@query("ret4_delete_offers", f"SELECT id, title, {_TOTAL} FROM {sql.OFFERS} WHERE category <> '3'")
def delete_offers(spark, d):
    chosen = st.offers(spark, d).filter("category = '3'").select("id")
    return _vector_sum(rt.delete_offers(_stored(spark, d), chosen))


@query("ret5_count_indexed", f"SELECT count(*) AS indexed FROM {sql.OFFERS}")
def count_indexed(spark, d):
    return rt.count_indexed(_stored(spark, d))


_FOUND = "SELECT query_id, id, score, rank FROM"


def _shown(found):
    return found.withColumn("rank", F.col("rank").cast("bigint"))


@query("ret6_nearest_cosine", f"{_FOUND} {sql.neighbours()} WHERE rank <= 5")
def nearest_cosine(spark, d):
    return _shown(nn.nearest(st.retrieval_queries(spark, d), st.offers(spark, d), 5))


@query("ret6_nearest_cosine_blocks", f"{_FOUND} {sql.neighbours()} WHERE rank <= 5")
def nearest_cosine_blocks(spark, d):
    """The way taken when the catalogue is too large to broadcast."""
    return _shown(nn.nearest(
        st.retrieval_queries(spark, d), st.offers(spark, d), 5, broadcast_numbers=64, block_rows=150
    ))


@query("ret7_nearest_dot", f"{_FOUND} {sql.neighbours('list_inner_product')} WHERE rank <= 10")
def nearest_dot(spark, d):
    return _shown(nn.nearest(st.retrieval_queries(spark, d), st.offers(spark, d), 10, metric="dot"))


@query("ret8_nearest_approximate")
def nearest_approximate(spark, d):
    found = nn.nearest_approximate(st.retrieval_queries(spark, d), st.offers(spark, d), 5)
    return _shown(found)


@query("ret8_recall", f"SELECT 5 * count(*) AS n_exact, true AS most_found FROM {sql.SEARCHES}")
def recall(spark, d):
    queries, offers = st.retrieval_queries(spark, d), st.offers(spark, d)
    found = nn.recall(nn.nearest_approximate(queries, offers, 5), nn.nearest(queries, offers, 5))
    return found.select("n_exact", (F.col("recall") > 0.5).alias("most_found"))


_KEPT = f"""(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM {sql.neighbours()}
  WHERE rank <= 20 AND propensity >= min_propensity_threshold)"""
_RETRIEVED = f"""(SELECT query_id, position, id AS offer_id, title, description, category, score
  FROM {_KEPT} WHERE position <= 5)"""


def _retrieved(spark, d):
    out = rt.retrieve(st.retrieval_queries(spark, d), st.offers(spark, d))
    return out.withColumn("position", F.col("position").cast("bigint"))


@query("ret9_retrieve_eligible", f"SELECT * FROM {_RETRIEVED}")
def retrieve_eligible(spark, d):
    return _retrieved(spark, d)


@query("ret10_distance_order", f"""SELECT query_id, id, round(1.0::DOUBLE - score, 9) AS score, rank
  FROM {sql.neighbours()} WHERE rank <= 5""")
def distance_order(spark, d):
    return _shown(nn.nearest(st.retrieval_queries(spark, d), st.offers(spark, d), 5, metric="distance"))


_OR_ALL = f"""(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM (
  SELECT *, propensity >= min_propensity_threshold AS ok,
    bool_or(propensity >= min_propensity_threshold) OVER (PARTITION BY query_id) AS any_ok
  FROM {sql.neighbours()} WHERE rank <= 5) WHERE ok OR NOT any_ok)"""


@query("ret11_retrieve_or_all", f"""SELECT query_id, position, id AS offer_id, title, description, category,
  1.0::DOUBLE / rank AS score FROM {_OR_ALL}""")
def retrieve_or_all(spark, d):
    out = rt.retrieve_or_all(st.retrieval_queries(spark, d), st.offers(spark, d))
    return out.withColumn("position", F.col("position").cast("bigint"))


@query("ret12_fallback_offer", f"""SELECT q.query_id, coalesce(r.offer_id, 'fallback') AS offer_id,
  coalesce(r.title, 'Loyalty Reward') AS title,
  coalesce(r.description, 'Earn bonus points on your next visit.') AS description,
  coalesce(r.category, 'general') AS category, coalesce(r.score, 0.0) AS score
  FROM {sql.SEARCHES} q LEFT JOIN {_RETRIEVED} r ON r.query_id = q.query_id AND r.position = 1""")
def fallback_offer(spark, d):
    return rt.with_fallback(st.retrieval_queries(spark, d), _retrieved(spark, d))


@query("ret13_display_defaults", """SELECT CAST(doc_id AS VARCHAR) AS query_id,
  CASE WHEN doc_id % 3 = 0 THEN 'offer_' || doc_id ELSE 'doc_' || (doc_id % 5) END AS offer_id,
  CASE WHEN doc_id % 2 = 0 THEN source ELSE substr(text, 1, 60) END AS title, text AS description, '' AS category FROM documents""")
def display_defaults(spark, d):
    doc = F.col("doc_id")
    return rt.display_defaults(st.table(spark, d, "documents").select(
        doc.cast("string").alias("query_id"), (doc % 5 + 1).alias("rank"), "text",
        F.when(doc % 3 == 0, F.concat(F.lit("offer_"), doc.cast("string"))).alias("offer_id"),
        F.when(doc % 2 == 0, F.col("source")).alias("title"),
        F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("category"),
    ))


@query("ret14_answer_summary", f"""SELECT q.query_id, 'Retrieved ' || count(r.offer_id) || ' offers for context.' AS answer,
  coalesce(string_agg(r.description, '|' ORDER BY r.position), '') AS offers
  FROM {sql.SEARCHES} q LEFT JOIN {_RETRIEVED} r ON r.query_id = q.query_id GROUP BY q.query_id""")
def answer_summary(spark, d):
    out = rt.answer_summary(st.retrieval_queries(spark, d), _retrieved(spark, d))
    return out.select("query_id", "answer", F.array_join("filtered_offers", "|").alias("offers"))


@query("ret15_precision_at_k", f"""SELECT q.query_id, coalesce(avg((r.category = q.expected_category)::INT), 0.0) AS precision
  FROM {sql.SEARCHES} q LEFT JOIN {_RETRIEVED} r ON r.query_id = q.query_id GROUP BY q.query_id""")
def precision_at_k(spark, d):
    return rt.precision_at_k(st.retrieval_queries(spark, d), _retrieved(spark, d))


def _runs(spark, d):
    return st.llm_calls(spark, d).select(
        F.col("model").alias("retriever"), "latency_ms", F.col("request_id").cast("bigint").alias("run")
    )


_SUMMARY = f"""(SELECT model AS retriever, round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50_ms,
  round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95_ms, round(avg(latency_ms), 6) AS latency_mean_ms,
  count(*) AS runs FROM {sql.CALLS} WHERE CAST(request_id AS BIGINT) >= 2 GROUP BY model)"""


def _summary(spark, d):
    out = rt.latency_summary(_runs(spark, d), warmup=2)
    cuts = ["latency_p50_ms", "latency_p95_ms", "latency_mean_ms"]
    return out.withColumns({c: F.round(c, 6) for c in cuts})


@query("ret16_latency_summary", f"SELECT * FROM {_SUMMARY}")
def latency_summary(spark, d):
    return _summary(spark, d)


@query("ret17_winners", f"""SELECT (SELECT retriever FROM {_SUMMARY} ORDER BY latency_p50_ms, retriever DESC LIMIT 1) AS winner_latency,
  (SELECT retriever FROM {_SUMMARY} ORDER BY runs DESC, retriever LIMIT 1) AS winner_precision""")
def winners(spark, d):
    # The number of runs stands in for precision: it is known for every model.
    summary = _summary(spark, d).select(
        "retriever", "latency_p50_ms", F.col("runs").alias("precision_at_k"),
        F.substring("retriever", 2, 9).cast("int").alias("place"),
    )
    return rt.winners(summary)
