"""Queries on call metrics, prompt registry and copy quality."""

from pyspark.sql import functions as F

from checks import query, sql
from perkwise.operators import calls, evaluation as ev, registry
from perkwise.sources import sample_tables as st

KEYWORDS = ["the", "Offer", "REDEEM"]
_HITS = " + ".join(f"contains(lower(text), '{w.lower()}')::INT" for w in KEYWORDS)


@query("evl1_keyword_relevance", f"SELECT doc_id, ({_HITS}) / 3 AS score FROM documents")
def keyword_relevance(spark, d):
    docs = st.table(spark, d, "documents")
    return docs.select("doc_id", ev.keyword_relevance(F.col("text"), KEYWORDS).alias("score"))


@query("evl2_batch_gate", f"""SELECT round(avg(({_HITS}) / 3), 9) AS mean_score, 0.75::DOUBLE AS threshold,
  avg(({_HITS}) / 3) >= 0.75 AS passed, count(*) AS n FROM documents""")
def batch_gate(spark, d):
    out = ev.gate(keyword_relevance(spark, d))
    return out.withColumn("mean_score", F.round("mean_score", 9))


def tokens_sql(text: str) -> str:
    out = text
    for pattern, replacement in (("<skipped>", ""), ("-\\n", ""), ("\\n", " ")):
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    for entity, sign in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = f"replace({out}, '{entity}', '{sign}')"
    out = f"(' ' || {out} || ' ')"
    for pattern, replacement in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return f"list_filter(string_split_regex({out}, '\\s+'), lambda t: t <> '')"


_GRAMS = " UNION ALL ".join(
    f"""SELECT pair_id, {n} AS ord, {side} AS side, array_to_string(list_slice(tokens, i, i + {n - 1}), ' ') AS gram
    FROM (SELECT pair_id, {column} AS tokens, unnest(range(1, greatest(len({column}) - {n - 2}, 1))) AS i FROM tok)"""
    for n in (1, 2, 3, 4) for side, column in ((1, "g"), (0, "r")))


def bleu_sql(pairs: str = sql.PAIRS) -> str:
    p = {n: f"(CASE WHEN c{n} = 0 THEN 1.0::DOUBLE / (pow(2, z{n}) * t{n}) ELSE c{n}::DOUBLE / t{n} END)" for n in range(1, 5)}
    logs = " + ".join(f"(CASE WHEN a{n} THEN ln({p[n]}) ELSE 0 END)" for n in range(1, 5))
    used = " + ".join(f"a{n}::INT" for n in range(1, 5))
    return f"""(WITH tok AS (SELECT pair_id, {tokens_sql('generated')} AS g, {tokens_sql('reference')} AS r FROM {pairs}),
  grams AS ({_GRAMS}),
  counted AS (SELECT pair_id, ord, gram, sum(side) AS cg, count(*) - sum(side) AS cr FROM grams GROUP BY ALL),
  stats AS (SELECT tok.pair_id, len(any_value(tok.r)) AS rl,
    {', '.join(f"coalesce(sum(least(cg, cr)) FILTER (WHERE ord = {n}), 0) AS c{n}, coalesce(sum(cg) FILTER (WHERE ord = {n}), 0) AS t{n}" for n in range(1, 5))}
    FROM tok LEFT JOIN counted USING (pair_id) GROUP BY tok.pair_id),
  alive AS (SELECT *, t1 > 0 AS a1, t1 > 0 AND t2 > 0 AS a2, t1 > 0 AND t2 > 0 AND t3 > 0 AS a3,
    t1 > 0 AND t2 > 0 AND t3 > 0 AND t4 > 0 AS a4 FROM stats),
  halved AS (SELECT *, (a1 AND c1 = 0)::INT AS z1, (a1 AND c1 = 0)::INT + (a2 AND c2 = 0)::INT AS z2,
    (a1 AND c1 = 0)::INT + (a2 AND c2 = 0)::INT + (a3 AND c3 = 0)::INT AS z3,
    (a1 AND c1 = 0)::INT + (a2 AND c2 = 0)::INT + (a3 AND c3 = 0)::INT + (a4 AND c4 = 0)::INT AS z4 FROM alive)
  SELECT pair_id, CASE WHEN c1 + c2 + c3 + c4 = 0 THEN 0.0::DOUBLE ELSE
    (CASE WHEN t1 >= rl THEN 1.0::DOUBLE ELSE exp(1 - rl / t1) END) * exp(({logs}) / ({used})) END AS bleu FROM halved)"""


@query("evl3_sentence_bleu", f"SELECT pair_id, round(bleu, 8) AS bleu FROM {bleu_sql()}")
def sentence_bleu(spark, d):
    out = ev.sentence_bleu(st.copy_pairs(spark, d))
    return out.withColumn("bleu", F.round("bleu", 8))


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda t: t <> '')"


# The textbook table of common subsequence lengths, one row of it per step.
ROUGE = f"""WITH RECURSIVE tok AS MATERIALIZED (SELECT pair_id, {_words('generated')} AS g, {_words('reference')} AS r FROM {sql.PAIRS}),
  cells AS MATERIALIZED (SELECT pair_id, unnest(r) AS b, unnest(range(1, len(r) + 1)) AS j FROM tok),
  dp AS (SELECT pair_id, 0 AS i, j, b, 0 AS v FROM cells
    UNION ALL SELECT pair_id, i + 1, j, b, max(c) OVER (PARTITION BY pair_id ORDER BY j) FROM (
      SELECT d.pair_id, d.i, d.j, d.b, greatest(d.v, (t.g[d.i + 1] = d.b)::INT
        + coalesce(lag(d.v) OVER (PARTITION BY d.pair_id ORDER BY d.j), 0)) AS c
      FROM dp d JOIN tok t ON t.pair_id = d.pair_id AND d.i < len(t.g))),
  lcs AS (SELECT pair_id, max(v) AS n FROM dp GROUP BY pair_id)
  SELECT pair_id, CASE WHEN coalesce(n, 0) = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * n / (len(g) + len(r)), 9) END AS rouge_l
  FROM tok LEFT JOIN lcs USING (pair_id)"""


@query("evl4_rouge_l_unstemmed", ROUGE)
def rouge_l_unstemmed(spark, d):
    out = ev.rouge_l(st.copy_pairs(spark, d), stem=False)
    return out.withColumn("rouge_l", F.round("rouge_l", 9))


@query("evl4_rouge_l")
def rouge_l(spark, d):
    return ev.rouge_l(st.copy_pairs(spark, d))


_JUDGE = """(SELECT doc_id, n_chars, CASE WHEN doc_id % 4 = 0 THEN 'no json' WHEN doc_id % 4 = 1 THEN '{"coherence": 4}'
  ELSE '{"coherence": ' || (1 + doc_id % 5) || ', "brand_alignment": ' || (1 + n_chars % 5)
    || ', "cta_strength": 3.5}' END AS raw FROM documents)"""


def _judged(docs, key="doc_id", other="n_chars"):
    return (
        F.when(F.col(key) % 4 == 0, "no json").when(F.col(key) % 4 == 1, '{"coherence": 4}')
        .otherwise(F.concat(
            F.lit('{"coherence": '), (1 + F.col(key) % 5).cast("string"),
            F.lit(', "brand_alignment": '), (1 + F.col(other) % 5).cast("string"), F.lit(', "cta_strength": 3.5}')))
    )


@query("evl5_judge_scores", f"""SELECT doc_id,
  CASE WHEN doc_id % 4 < 2 THEN 0.75 ELSE (1 + doc_id % 5) / 5 END::DOUBLE AS coherence,
  CASE WHEN doc_id % 4 < 2 THEN 0.75 ELSE (1 + n_chars % 5) / 5 END::DOUBLE AS brand_alignment,
  CASE WHEN doc_id % 4 < 2 THEN 0.75 ELSE 3.5 / 5 END::DOUBLE AS cta_strength FROM {_JUDGE}""")
def judge_scores(spark, d):
    docs = st.table(spark, d, "documents")
    return docs.select("doc_id", ev.judge_scores(_judged(docs)).alias("j")).select("doc_id", "j.*")


@query("evl6_aggregate_score", f"""SELECT pair_id, {sql.fixed('0.2::DOUBLE * bleu + 0.2::DOUBLE * 0.5::DOUBLE + 0.6::DOUBLE * 0.75::DOUBLE', 4)} AS aggregate
  FROM {bleu_sql()}""")
def aggregate_score(spark, d):
    judge = [F.lit(ev.JUDGE_DEFAULT)] * 3
    return ev.sentence_bleu(st.copy_pairs(spark, d)).select(
        "pair_id", ev.aggregate_score(F.col("bleu"), F.lit(0.5), judge).alias("aggregate")
    )


@query("evl6_copies_unstemmed", f"""SELECT pair_id, {sql.fixed('bleu', 4)} AS bleu, {sql.fixed('rouge_l', 4)} AS rouge_l, coherence, brand_alignment, cta_strength,
  {sql.fixed('0.2::DOUBLE * bleu + 0.2::DOUBLE * rouge_l + 0.6::DOUBLE * ((coherence + brand_alignment + cta_strength) / 3.0::DOUBLE)', 4)} AS aggregate
  FROM (SELECT b.pair_id, bleu, rouge_l, CASE WHEN m < 2 THEN 0.75 ELSE (1 + t) / 5 END::DOUBLE AS coherence,
    CASE WHEN m < 2 THEN 0.75 ELSE (1 + (t + 2) % 5) / 5 END::DOUBLE AS brand_alignment, CASE WHEN m < 2 THEN 0.75 ELSE 3.5 / 5 END::DOUBLE AS cta_strength
    FROM (SELECT *, length(generated) % 4 AS m, length(generated) % 5 AS t FROM {sql.PAIRS}) p
    JOIN {bleu_sql()} b USING (pair_id) JOIN ({ROUGE}) r USING (pair_id))""")
def copies_unstemmed(spark, d):
    size = F.length("generated")
    answer = F.when(size % 4 == 0, "no json").when(size % 4 == 1, '{"coherence": 4}').otherwise(F.concat(
        F.lit('{"coherence": '), (1 + size % 5).cast("string"), F.lit(', "brand_alignment": '), (1 + (size + 2) % 5).cast("string"),
        F.lit(', "cta_strength": 3.5}')))
    return ev.evaluate_copies(st.copy_pairs(spark, d).select("pair_id", F.col("generated").alias("body"), "reference", answer.alias("judge_raw")), stem=False)


@query("evl6_evaluate_copies")
def evaluate_copies(spark, d):
    pairs = st.copy_pairs(spark, d).select(
        "pair_id", F.col("generated").alias("body"), "reference",
        F.lit('{"coherence": 4, "brand_alignment": 5, "cta_strength": 3}').alias("judge_raw"),
    )
    return ev.evaluate_copies(pairs)


@query("evl7_run_report", f"""SELECT strftime(date_trunc('day', created_at), '%Y%m%dT%H%M%SZ') AS run, '20240131T000000Z' AS timestamp,
  count(*) AS n, 0.25::DOUBLE AS threshold, {sql.fixed('avg(score)', 4)} AS mean_aggregate_score,
  avg(score) >= 0.25 AS passed FROM {sql.CALLS} WHERE score IS NOT NULL GROUP BY 1""")
def run_report(spark, d):
    scores = st.llm_calls(spark, d).filter("score is not null").select(
        F.date_format(F.date_trunc("day", "created_at"), "yyyyMMdd'T'HHmmss'Z'").alias("run"),
        F.col("score").alias("aggregate"),
    )
    return ev.run_report(scores, "20240131T000000Z", 0.25, ["run"])


@query("cal1_calls_per_model", f"SELECT model, count(*) AS calls FROM {sql.CALLS} GROUP BY model")
def calls_per_model(spark, d):
    return calls.calls_per_model(st.llm_calls(spark, d))


@query("cal2_latency_histogram", " UNION ALL ".join(
    f"""SELECT model, round(sum(latency_ms), 2) AS latency_sum, '{b}' AS le,
    count(*) FILTER (WHERE latency_ms <= {b if b != '+Inf' else "'inf'::DOUBLE"}) AS calls FROM {sql.CALLS} GROUP BY model"""
    for b in [*map(str, calls.LATENCY_BOUNDS), "+Inf"]))
def latency_histogram(spark, d):
    out = calls.latency_histogram(st.llm_calls(spark, d))
    return out.withColumn("latency_sum", F.round("latency_sum", 2))


@query("cal3_token_totals", f"""SELECT model, 'prompt' AS type, CAST(sum(prompt_tokens) AS BIGINT) AS tokens FROM {sql.CALLS} GROUP BY model
  UNION ALL SELECT model, 'completion', CAST(sum(completion_tokens) AS BIGINT) FROM {sql.CALLS} GROUP BY model""")
def token_totals(spark, d):
    return calls.token_totals(st.llm_calls(spark, d))


@query("cal4_latest_score", f"""SELECT score FROM {sql.CALLS} WHERE score IS NOT NULL
  ORDER BY created_at DESC, request_id DESC LIMIT 1""")
def latest_score(spark, d):
    return calls.latest_score(st.llm_calls(spark, d))


_LAST = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY activated_at DESC, entry DESC) AS rn,
  count(*) OVER (PARTITION BY name) AS entries FROM {sql.ACTIVATIONS}) WHERE rn = 1)"""


@query("reg1_version_status", f"""SELECT v.name, v.version, a.activated_at,
  CASE WHEN v.version = l.version THEN 'active' ELSE 'archived' END AS status
  FROM (SELECT DISTINCT 'prompt_' || user_id AS name, 'v' || (k % 5) AS version FROM {sql.EV}) v
  LEFT JOIN (SELECT name, version, max(activated_at) AS activated_at FROM {sql.ACTIVATIONS} GROUP BY ALL) a
    ON a.name = v.name AND a.version = v.version
  LEFT JOIN {_LAST} l ON l.name = v.name""")
def version_status(spark, d):
    versions = st.raw_events(spark, d).select(
        F.concat(F.lit("prompt_"), F.col("user_id").cast("string")).alias("name"),
        F.concat(F.lit("v"), (F.col("k") % 5).cast("string")).alias("version"),
    )
    return registry.version_list(versions, st.activation_log(spark, d))


@query("reg2_registry_state", f"""SELECT name, version AS active, previous AS rollback_to, entries,
  entries >= 2 AND previous IS NOT NULL AS can_roll_back FROM {_LAST}""")
def registry_state(spark, d):
    return registry.registry_state(st.activation_log(spark, d))


@query("reg3_template_lookup", """SELECT name, version, template FROM (SELECT lang AS name, source AS version, text AS template,
  row_number() OVER (PARTITION BY lang, source ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn = 1""")
def template_lookup(spark, d):
    registered = registry.register(st.templates(spark, d))
    return registry.get_templates(registered, registered)


@query("reg3_template_versions", "SELECT DISTINCT source AS version FROM documents WHERE lang = 'en'")
def template_versions(spark, d):
    return registry.list_versions(registry.register(st.templates(spark, d)), "en")
