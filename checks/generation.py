"""Prompt, response and end-to-end queries."""

from pyspark.sql import functions as F

from checks import query, sql
from checks.features import compared
from perkwise.operators import prompts as pr
from perkwise.operators.features import compute_features
from perkwise.operators.retrieval import embed_hashed
from perkwise.plans.recommend import recommend
from perkwise.plans.training import train
from perkwise.session import stage
from perkwise.sources import sample_tables as st


def _features(spark, d):
    return compute_features(st.loyalty_events(spark, d), st.REFERENCE_TS)


def _customers(spark, d):
    """Features with money rounded: a sum of doubles depends on the order of additions."""
    return compared(_features(spark, d))


_CUSTOMERS = f"(SELECT {sql.FEATURE_SELECT} FROM {sql.features()})"


@query("gen1_context_string", f"""SELECT customer_id, 'customer_id=' || customer_id || ' recency_days=' || recency_days
  || ' frequency_30d=' || frequency_30d || ' engagement_score=' || engagement_score AS context FROM {sql.features()}""")
def context_string(spark, d):
    rows = _features(spark, d).drop("monetary_90d")
    # Small doubles print differently in the two engines, so the score is passed as text.
    rows = rows.withColumn("engagement_score", F.expr("format_number(engagement_score, '0.0#####')"))
    return rows.select("customer_id", pr.context_string(rows).alias("context"))


TEMPLATE = (
    "\n Tier {tier}, score {engagement_score:.2f}, spend {monetary_90d:,.1f}, rate {rate:.1%}.\n"
    'Offer: {offer_title} - {unknown} {{"headline": "..."}} {frequency_30d:d} {channel}{channel:s}. \n'
)


def _rendered(rows):
    customer = {c: F.col(c) for c in ("monetary_90d", "frequency_30d", "engagement_score")}
    customer |= {"tier": F.lit("Gold"), "channel": F.lit("none"), "rate": F.col("offer_redemption_rate")}
    offer = {"offer_title": F.concat(F.lit("Offer "), F.col("customer_id")), "channel": F.col("channel_preference")}
    return pr.render_template(TEMPLATE, pr.merged_context(customer, offer))


_RENDERED = """'Tier Gold, score ' || format('{:.2f}', engagement_score) || ', spend ' || format('{:,.1f}', monetary_90d)
  || ', rate ' || format('{:.1f}', offer_redemption_rate * 100) || '%.' || chr(10) || 'Offer: Offer ' || customer_id
  || ' - {unknown} {{"headline": "..."}} ' || frequency_30d || ' ' || channel_preference || channel_preference || '.'"""


@query("gen2_render_template", f"SELECT customer_id, {_RENDERED} AS prompt FROM {_CUSTOMERS}")
def render_template(spark, d):
    rows = _customers(spark, d)
    return rows.select("customer_id", pr.strip(_rendered(rows)).alias("prompt"))


@query("gen3_message_list", f"""SELECT customer_id, 0 AS position, 'system' AS role, 'Be brief.' AS content FROM {_CUSTOMERS}
  UNION ALL SELECT customer_id, 1, 'user', {_RENDERED} FROM {_CUSTOMERS}""")
def message_list(spark, d):
    rows = _customers(spark, d)
    return rows.select("customer_id", F.posexplode(pr.message_list(" Be brief.\n", _rendered(rows)))).select(
        "customer_id", F.col("pos").alias("position"), "col.role", "col.content"
    )


_PROFILE = f"""SELECT customer_id, 'Customer tier: ' || tier || chr(10) || 'Total spend: $' || format('{{:.2f}}', total_spend)
  || chr(10) || 'Visit count: ' || visit_count || chr(10) || 'Churn score: '
  || CASE WHEN visit_count % 3 = 0 THEN 'unknown' ELSE '0.5' END || chr(10) || 'Feature snapshot: '
  || CASE WHEN visit_count % 2 = 0 THEN 'none' ELSE 'spend=' || format('{{:.3f}}', total_spend / 1000.0) || ', visits='
    || format('{{:.3f}}', visit_count::DOUBLE) END || chr(10) || chr(10)
  || 'Relevant loyalty programme context:' || chr(10) || coalesce(docs, 'No context available.') || chr(10) || chr(10)
  || 'Generate a personalised retention offer.' AS prompt
  FROM {sql.customer_profiles('true')} LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS customer_id,
    string_agg('order ' || o_orderkey, chr(10) || chr(10) ORDER BY o_orderkey) AS docs
    FROM orders GROUP BY 1) USING (customer_id)"""


@query("gen4_profile_prompt", _PROFILE)
def profile_prompt(spark, d):
    customers = st.customer_profiles(spark, d, st.table(spark, d, "orders"))
    docs = st.table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("customer_id"), "o_orderkey",
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("text"),
    )
    rows = customers.join(pr.ordered_documents(docs, "customer_id", "o_orderkey"), "customer_id", "left")
    odd = F.col("visit_count") % 2 != 0
    messages = pr.profile_prompt(
        F.col("tier"), F.col("total_spend"), F.col("visit_count"),
        F.when(F.col("visit_count") % 3 == 0, F.when(F.col("visit_count") % 2 == 0, 0.0)).otherwise(0.5),
        F.when(odd, F.array(F.lit("spend"), F.lit("visits"))),
        F.when(odd, F.array(F.col("total_spend") / 1000.0, F.col("visit_count").cast("double"))),
        F.col("documents"),
    )
    return rows.select("customer_id", messages[1]["content"].alias("prompt"))


@query("gen5_instruct_prompts", f"""SELECT conv_id, string_agg(CASE role
    WHEN 'user' THEN '<s>[INST] ' || coalesce((SELECT s.content || chr(10) FROM {sql.CHAT} s WHERE s.conv_id = c.conv_id
      AND s.role = 'system' AND s.turn < c.turn AND NOT EXISTS (SELECT 1 FROM {sql.CHAT} u WHERE u.conv_id = c.conv_id
        AND u.role = 'user' AND u.turn > s.turn AND u.turn < c.turn) ORDER BY s.turn DESC LIMIT 1), '') || content || ' [/INST]'
    WHEN 'assistant' THEN ' ' || content || ' </s>' ELSE '' END, '' ORDER BY turn) AS prompt
  FROM {sql.CHAT} c GROUP BY conv_id""")
def instruct_prompts(spark, d):
    return pr.instruct_prompts(st.chat(spark, d))


def _parsed_sql(required: list[str]) -> str:
    body = "regexp_extract(raw, '(?s)\\{.*\\}')"
    fields = ", ".join(
        f"CASE WHEN reason IS NULL THEN json_extract_string(body, '$.{c}') END AS {c}" for c in required)
    absent = ", ".join(
        f"CASE WHEN NOT json_exists(body, '$.{c}') THEN '{c}' END" for c in required)
    return f"""(SELECT request_id, source, lang, raw, {fields}, reason FROM (SELECT *, CASE WHEN body = '' THEN 'no_json'
      WHEN NOT json_valid(body) THEN 'bad_json' WHEN concat_ws(',', {absent}) <> '' THEN 'missing: ' || concat_ws(',', {absent})
      END AS reason FROM (SELECT *, {body} AS body FROM {sql.RESPONSES})))"""


@query("gen6_parse_copy", f"SELECT * EXCLUDE (raw, source, lang) FROM {_parsed_sql(pr.COPY_FIELDS)}")
def parse_copy(spark, d):
    return pr.parse_responses(st.raw_responses(spark, d), pr.COPY_FIELDS).drop("raw")


@query("gen7_parse_offer", f"SELECT * EXCLUDE (raw, source, lang) FROM {_parsed_sql(pr.OFFER_FIELDS)}")
def parse_offer(spark, d):
    return pr.parse_responses(st.raw_responses(spark, d), pr.OFFER_FIELDS).drop("raw")


@query("gen8_first_valid_attempt", f"""SELECT * EXCLUDE (rn, raw, reason, source, lang, request_id), request_id AS attempt FROM (
  SELECT *, source || '/' || lang AS request, row_number() OVER (PARTITION BY source, lang ORDER BY request_id) AS rn
  FROM {_parsed_sql(pr.COPY_FIELDS)} WHERE reason IS NULL) WHERE rn = 1""")
def first_valid_attempt(spark, d):
    good, _ = pr.first_valid_attempt(st.response_attempts(spark, d), pr.COPY_FIELDS)
    return good


@query("gen8_failed_requests", f"""SELECT request_id AS request, 1::BIGINT AS attempts, reason AS last_reason
  FROM {_parsed_sql(pr.COPY_FIELDS)} WHERE reason IS NOT NULL""")
def failed_requests(spark, d):
    single = st.raw_responses(spark, d).select(
        F.col("request_id").alias("request"), F.lit(1).alias("attempt"), "raw"
    )
    _, failed = pr.first_valid_attempt(single, pr.COPY_FIELDS)
    return failed


@query("gen9_token_count", """SELECT doc_id, len(list_filter(string_split_regex(text, '[\\s\\x{0085}\\x{00A0}]+'), lambda t: t <> '')) AS tokens
  FROM documents""")
def token_count(spark, d):
    return st.table(spark, d, "documents").select(
        "doc_id", pr.token_count(F.col("text")).cast("bigint").alias("tokens")
    )


@query("gen10_fallback_copy", f"""SELECT id, 'Special offer: ' || title AS headline, description AS body, 'Redeem now' AS cta,
  'friendly' AS tone FROM {sql.OFFERS}""")
def fallback_copy(spark, d):
    return st.offers(spark, d).select(
        "id", pr.fallback_copy(F.col("title"), F.col("description")).alias("c")
    ).select("id", "c.headline", "c.body", "c.cta", "c.tone")


class EchoBackend:
    """A backend without a model: repeats the user's text as the body, in prose around JSON."""

    model_name = "echo"

    def generate(self, messages):
        import json

        body = messages[-1]["content"]
        return "Here it is: " + json.dumps(
            {"headline": "Hello", "body": body, "cta": "Redeem now", "tone": "friendly"}) + " Enjoy!"


@query("gen11_backend_copy", f"""SELECT customer_id, 'Hello' AS headline, {_RENDERED} AS body, 'Redeem now' AS cta,
  'friendly' AS tone, 1 AS attempts, 'echo' AS model_version, 1 AS prompt_version FROM {_CUSTOMERS}""")
def backend_copy(spark, d):
    rows = _customers(spark, d)
    asked = rows.select("customer_id", pr.message_list("Be brief.", _rendered(rows)).alias("messages"))
    return pr.generate_copy(asked, EchoBackend).select(
        "customer_id", *pr.COPY_FIELDS, "attempts", "model_version", "prompt_version"
    )


_WANTED = "(SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS customer_id FROM orders)"
_CUSTOMER_QUERIES = f"""(SELECT customer_id AS query_id, engagement_score AS propensity, embedding
  FROM {sql.features()} JOIN embeddings ON CAST(vec_id AS VARCHAR) = customer_id WHERE customer_id IN {_WANTED})"""


@query("gen12_recommendations", f"""SELECT f.customer_id, f.engagement_score AS propensity_score,
  CAST(f.engagement_score >= 0.5 AS INT) AS propensity_label, 'Gold' AS tier, f.channel_preference AS channel,
  coalesce(b.id, 'fallback') AS offer_id, coalesce(b.category, 'general') AS category,
  coalesce(1.0::DOUBLE / b.rank, 0.0) AS offer_score,
  'Special offer: ' || coalesce(b.title, 'Loyalty Reward') AS headline,
  coalesce(b.description, 'Earn bonus points on your next visit.') AS body
  FROM {sql.features()} f LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ok DESC, rank) AS place
    FROM (SELECT *, propensity >= min_propensity_threshold AS ok FROM {sql.neighbours(queries=_CUSTOMER_QUERIES)} WHERE rank <= 5)
  ) b ON b.query_id = f.customer_id AND b.place = 1 WHERE f.customer_id IN {_WANTED}""")
def recommendations(spark, d):
    features = stage(_features(spark, d), "features")
    scores = features.select(
        "customer_id", F.col("engagement_score").alias("propensity_score"),
        (F.col("engagement_score") >= 0.5).cast("int").alias("label"),
    )
    vectors = st.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("customer_id"), "embedding")
    customers = st.transactions(spark, d).select("customer_id").distinct()
    out, _ = recommend(customers, features, scores, vectors, st.offers(spark, d))
    return out.select(
        "customer_id", "propensity_score", "propensity_label", "tier", "channel", "offer_id", "category",
        "offer_score", "offer_copy.headline", "offer_copy.body",
    )


@query("gen12_customers_without_features", f"""SELECT customer_id FROM {_WANTED} WHERE customer_id NOT IN (SELECT customer_id FROM {sql.features()})""")
def customers_without_features(spark, d):
    features = _features(spark, d)
    scores = features.select("customer_id", F.col("engagement_score").alias("propensity_score"), F.lit(1).alias("label"))
    vectors = st.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("customer_id"), "embedding")
    customers = st.transactions(spark, d).select("customer_id").distinct()
    _, missing = recommend(customers, features, scores, vectors, st.offers(spark, d))
    return missing


@query("gen12_recommendations_with_model")
def recommendations_with_model(spark, d):
    features = stage(_features(spark, d), "features")
    scores = train(st.stored_features(spark, d), epochs=5).score(features)
    contexts = features.select("customer_id", pr.context_string(features).alias("text"))
    vectors = embed_hashed(contexts).select("customer_id", "embedding")
    offers = embed_hashed(st.offers(spark, d).drop("embedding"), "description")
    out, _ = recommend(features.select("customer_id"), features, scores, vectors, offers)
    return out.drop("offer_copy")
