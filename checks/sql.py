"""SQL for the sample tables seen through the domain schemas, as parenthesised subqueries."""

from __future__ import annotations

REF = "2024-02-15 00:00:00"

EV = "(SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"

LOYALTY = f"""(SELECT CAST(user_id AS VARCHAR) AS customer_id,
  CASE event_type WHEN 'purchase' THEN 'purchase' WHEN 'view' THEN 'offer_view'
    WHEN 'click' THEN 'redeem' ELSE 'app_open' END AS event_type,
  ts, CASE WHEN event_type = 'purchase' THEN value END AS amount,
  CASE WHEN event_type IN ('view', 'click') THEN CAST(k AS VARCHAR) END AS offer_id,
  CASE k % 3 WHEN 0 THEN 'mobile' WHEN 1 THEN 'web' ELSE 'in-store' END AS channel
  FROM {EV})"""


def rfm(ref: str = REF) -> str:
    return f"""(SELECT b.*, c.channel AS channel_preference FROM (
  SELECT customer_id,
    CAST(greatest(floor((epoch_us(TIMESTAMP '{ref}') - epoch_us(max(ts))) / 86400000000), 0) AS INT) AS recency_days,
    CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '{ref}' - INTERVAL 30 DAY) AS INT) AS frequency_30d,
    coalesce(sum(amount) FILTER (WHERE event_type = 'purchase'
      AND ts >= TIMESTAMP '{ref}' - INTERVAL 90 DAY), 0.0)::DOUBLE AS monetary_90d,
    CASE WHEN count(*) FILTER (WHERE event_type = 'offer_view') = 0 THEN 0.0::DOUBLE ELSE least(
      count(*) FILTER (WHERE event_type = 'redeem')::DOUBLE
      / count(*) FILTER (WHERE event_type = 'offer_view'), 1.0::DOUBLE) END AS offer_redemption_rate
  FROM {LOYALTY} GROUP BY customer_id) b
  JOIN (SELECT customer_id, channel FROM (
    SELECT customer_id, channel, row_number() OVER (
      PARTITION BY customer_id ORDER BY count(*) DESC, channel) AS rn
    FROM {LOYALTY} GROUP BY customer_id, channel) WHERE rn = 1) c USING (customer_id))"""


def scaled(ref: str = REF) -> str:
    def mm(c: str) -> str:
        return (
            f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.0::DOUBLE ELSE "
            f"({c}::DOUBLE - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())::DOUBLE END AS {c}_scaled"
        )

    names = ("frequency_30d", "monetary_90d", "offer_redemption_rate")
    return f"(SELECT *, {', '.join(mm(c) for c in names)} FROM {rfm(ref)})"


def features(ref: str = REF) -> str:
    return f"""(SELECT customer_id, recency_days, frequency_30d, monetary_90d, offer_redemption_rate,
  channel_preference,
  round_even(least(greatest(frequency_30d_scaled * 0.3::DOUBLE + monetary_90d_scaled * 0.4::DOUBLE
    + offer_redemption_rate_scaled * 0.3::DOUBLE, 0.0), 1.0)::DOUBLE * 1000000.0::DOUBLE, 0)
    / 1000000.0::DOUBLE AS engagement_score
  FROM {scaled(ref)})"""


VERSIONS = {"v1": "2024-02-01 00:00:00", "v2": "2024-02-08 00:00:00", "v3": "2024-02-15 00:00:00"}

STORED = "(" + " UNION ALL ".join(
    f"SELECT *, TIMESTAMP '{ref}' AS written_at, '{v}' AS version FROM {features(ref)}"
    for v, ref in VERSIONS.items()
) + ")"

# Features as they are compared: the sum of money depends on the order of additions.
FEATURE_SELECT = """customer_id, recency_days, frequency_30d, round(monetary_90d, 4) AS monetary_90d,
  offer_redemption_rate, channel_preference, engagement_score"""

TRANSACTIONS = """(SELECT CAST(o_orderkey AS VARCHAR) AS transaction_id, CAST(o_custkey AS VARCHAR) AS customer_id,
  o_totalprice AS amount, 'store-' || CAST(o_custkey % 10 AS VARCHAR) AS store_id, o_orderdate AS created_at
  FROM orders)"""

TRANSACTION_SNAPSHOT = f"(SELECT * FROM {TRANSACTIONS} WHERE created_at < TIMESTAMP '1999-01-01')"
TRANSACTION_BATCH = f"""(SELECT transaction_id, customer_id, amount + arrival::DOUBLE AS amount, store_id, created_at, arrival
  FROM {TRANSACTIONS}, (VALUES (1), (2)) a(arrival) WHERE created_at >= TIMESTAMP '1998-01-01')"""


def customer_profiles(condition: str) -> str:
    return f"""(SELECT CAST(c_custkey AS VARCHAR) AS customer_id, lower(c_name) || '@example.com' AS email,
  c_mktsegment AS tier, round(a.total_spend, 2) AS total_spend, CAST(a.visit_count AS INT) AS visit_count,
  a.created_at, a.updated_at
  FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS total_spend, count(*) AS visit_count,
    min(o_orderdate) AS created_at, max(o_orderdate) AS updated_at
    FROM orders WHERE {condition} GROUP BY o_custkey) a ON c_custkey = a.o_custkey)"""


CUSTOMER_SNAPSHOT = customer_profiles("o_custkey % 3 = 0 OR (o_custkey % 3 = 1 AND o_orderkey % 3 <> 2)")
CUSTOMER_RECENT = customer_profiles("o_custkey % 3 = 2 OR (o_custkey % 3 = 1 AND o_orderkey % 3 <> 0)")

FEEDBACK = f"""(SELECT event_id AS id, CAST(k * 10 + user_id % 10 AS VARCHAR) AS offer_id,
  CAST(user_id AS VARCHAR) AS customer_id,
  CASE WHEN k % 10 = 0 THEN 'plain copy ' || event_id ELSE '{{"headline":"Deal ' || k || '","body":"Body of '
    || event_id || '","cta":"Redeem"}}' END AS generated_copy,
  CAST(1 + event_id * 7 % 5 AS INT) AS rating,
  CASE WHEN event_type = 'error' THEN 'down' ELSE 'up' END AS thumbs,
  CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'v1' ELSE 'v2' END AS prompt_version,
  CASE event_id % 2 WHEN 0 THEN 'm0' ELSE 'm1' END AS model_version, ts AS created_at, k
  FROM {EV})"""

FEEDBACK_EVENTS = f"""(SELECT CAST(user_id AS VARCHAR) AS customer_id, CAST(event_id AS VARCHAR) AS request_id,
  CASE event_type WHEN 'purchase' THEN 'redeem' WHEN 'error' THEN 'ignore'
    WHEN 'signup' THEN 'unsubscribe' ELSE event_type END AS event_type,
  CASE WHEN k % 2 = 0 THEN '{{"k": ' || k || '}}' ELSE '{{}}' END AS metadata, ts AS created_at
  FROM {EV})"""

CALLS = f"""(SELECT CAST(event_id AS VARCHAR) AS request_id, 'm' || (k % 3) AS model, k AS prompt_tokens,
  2 * k AS completion_tokens, value * 10.0 AS latency_ms,
  CASE WHEN event_id % 4 <> 0 THEN value / 500.0 END AS score, ts AS created_at FROM {EV})"""

SCORES = f"""(SELECT event_id AS id, value / 200.0 AS score, k / 100.0 AS frequency_share, ts,
  CASE WHEN ts < TIMESTAMP '2024-01-23' THEN 'baseline' ELSE 'current' END AS period FROM {EV})"""

OFFERS = """(SELECT 'offer_' || lpad(CAST(vec_id AS VARCHAR), 7, '0') AS id, 'Offer ' || vec_id AS title,
  'Reward number ' || vec_id || ' of group ' || label AS description, CAST(label AS VARCHAR) AS category,
  'all' AS channel, vec_id * 37 % 71 / 100.0 AS min_propensity_threshold,
  CAST(vec_id % 36 + 5 AS INT) AS discount_pct, 30 AS expiry_days, embedding
  FROM embeddings)"""

SEARCHES = """(SELECT CAST(vec_id AS VARCHAR) AS query_id, embedding, CAST(label AS VARCHAR) AS expected_category,
  vec_id * 53 % 101 / 100.0 AS propensity FROM embeddings)"""


def neighbours(measure: str = "list_cosine_similarity", queries: str = SEARCHES) -> str:
    """All similarities, ranked per query; ties by id."""
    return f"""(SELECT query_id, propensity, id, title, description, category, min_propensity_threshold, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM (SELECT q.query_id, q.propensity, o.id, o.title, o.description, o.category, o.min_propensity_threshold,
    round({measure}(q.embedding::DOUBLE[], o.embedding::DOUBLE[]), 9) AS score
    FROM {queries} q, {OFFERS} o))"""


SCORED = """(SELECT doc_id, quality AS label, least(n_chars / 10000.0, 1.0)::DOUBLE AS score
  FROM labels JOIN documents USING (doc_id))"""

CHAT = "(SELECT conv_id, turn, role, text AS content FROM conversations)"

PAIRS = """(SELECT concat_ws('-', t.conv_id, t.turn) AS pair_id, t.text AS generated, p.text AS reference
  FROM conversations t JOIN conversations p ON p.conv_id = t.conv_id AND p.turn = t.turn - 1
  WHERE t.role = 'assistant')"""

RESPONSES = """(SELECT doc_id AS request_id, source, lang, CASE
  WHEN doc_id % 5 = 0 THEN safe
  WHEN doc_id % 7 = 0 THEN safe || chr(10) || '{"body":"' || source || '","tone":"friendly"} done'
  ELSE safe || chr(10) || '{"headline":"Headline ' || doc_id || '","body":"' || source
    || '","cta":"Redeem now","tone":"friendly","subject":"' || lang || '","offer_code":"CODE' || doc_id || '"} done'
  END AS raw FROM (SELECT *, regexp_replace(text, '[{}]', ' ', 'g') AS safe FROM documents))"""

ACTIVATIONS = f"""(SELECT *, lag(version) OVER (PARTITION BY name ORDER BY activated_at, entry) AS previous FROM (
  SELECT 'prompt_' || user_id AS name, 'v' || (k % 5) AS version, ts AS activated_at, event_id AS entry
  FROM {EV} WHERE event_type = 'signup'))"""


def uniform(hex_digest: str, part: int) -> str:
    return f"(('0x' || substr({hex_digest}, {8 * part + 1}, 8))::BIGINT / 4294967296.0::DOUBLE)"


def digest(row_id: str, seed: int, stream: str) -> str:
    return f"md5('{seed}:{stream}:' || {row_id})"


def uuid_text(h: str) -> str:
    return (
        f"(substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || substr({h},17,4)"
        f" || '-' || substr({h},21,12))"
    )


def fixed(x: str, digits: int) -> str:
    """Rounded as Python rounds: through the decimal text of the exact value."""
    return f"CAST(format('{{:.{digits}f}}', ({x})::DOUBLE) AS DOUBLE)"
