"""The operators of this folder over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perkwise.llm import (
    ann, collocations, extraction, langid, lexical, linededup, mixing, packing, secrets, simhash, tokencounts, topk, toxicity,
)
from perkwise.llm.common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "raw")


@query
def op2_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def piece_digests(packed: DataFrame) -> DataFrame:
    """The pieces of ``pack_bytes`` with the length and the checksum of their ids in place of the ids."""
    return packed.select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset")


def packed_digests(docs: DataFrame, path: str) -> DataFrame:
    """The same rows, length and checksum taken where the ids are made, so that no ids are written or shuffled."""
    carry = {"length": F.col("n").cast("long"), "ids_crc32": F.crc32("ids")}
    return packing.pack_bytes(docs, path, carry=carry).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op4_differencing_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op5_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "rejected")


@query
def op10_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.drop_repeated_lines(docs, min_words=1).select(
        "doc_id", "n_lines", F.size("removed").alias("n_removed"), F.array_sort("removed").alias("removed"), "text")


@query
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extraction.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


@query
def op8_blob_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Two scans of a growing history: the second gets all rows, and the ledger spares it the blobs of the first.
    ledger, earlier = secrets.scan(docs.filter("doc_id % 2 = 0"))
    _, later = secrets.scan(docs, ledger)
    spans = secrets.span_text(F.col("found"))
    return secrets.by_path(docs, earlier.unionByName(later)).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_SECRET_PATTERNS = {
    "assign": f"""({_KEYWORDS})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": "(AKIA[A-Z0-9]+)()",
    "hex": "([0-9a-f]+)()",
}
_SECRET_LEAST = {"assign": "length(regexp_extract(m, p, 2)) >= 8", "access": "length(m) >= 16", "hex": "length(m) >= 32"}

SQL["op8_blob_secrets"] = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
kinds AS ({" UNION ALL ".join(f"SELECT {i} AS o, '{k}' AS kind, '{p}' AS p" for i, (k, p) in enumerate(_SECRET_PATTERNS.items()))}),
lists AS (SELECT r, o, kind, p, regexp_extract_all(t, p) AS ms, string_split_regex(t, p) AS gaps FROM docs, kinds WHERE regexp_matches(t, p)),
parts AS (SELECT r, o, kind, p, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM lists),
ends AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY r, o ORDER BY i) AS e FROM parts),
spans AS (SELECT r, o, kind, e - length(m) AS s, e FROM ends
          WHERE CASE kind {" ".join(f"WHEN '{k}' THEN {c}" for k, c in _SECRET_LEAST.items())} END),
found AS (SELECT r, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, o) AS spans,
                 count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c
          FROM spans GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN found USING (r)
"""


@query
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantized(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024)
    return topk.search(rows.filter("id % 100 = 0"), rows, 10)


SQL["op9_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS w FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w::DOUBLE[], c.w::DOUBLE[])::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query
def op6_neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


@query
def op11_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text"), 20)


_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_FOLDED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op11_best_position"] = f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({_FOLDED.format("text")}, '{_TERM}') AS ws FROM documents),
held AS (SELECT d, doc_id, ws, len(ws)::BIGINT AS n FROM docs WHERE len(ws) > 0),
facts AS (SELECT count(*) AS documents, sum(n)::BIGINT AS length FROM held),
tf AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(ws) AS t FROM held) GROUP BY d, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
weights AS (SELECT t, floor(1000 * ln((2 * documents + 2) / (2 * df + 1)))::BIGINT AS w FROM df, facts),
asked AS (SELECT i, item_id, t, count(*) AS q FROM
          (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all({_FOLDED.format("text")}, '{_TERM}')) AS t FROM benchmark) GROUP BY i, item_id, t),
scores AS (SELECT i, item_id, d, doc_id,
                  sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * documents) // length))))::BIGINT AS score
           FROM asked JOIN weights USING (t) JOIN tf USING (t) JOIN held USING (d), facts GROUP BY i, item_id, d, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


SQL["op12_collocations"] = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_FOLDED.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
lists AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS ws FROM pieces),
spots AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists),
grams AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, m FROM spots, (SELECT unnest([1, 2, 3]) AS m) WHERE i + m - 1 <= len(ws)),
f AS (SELECT lang, phrase, any_value(m) AS m, count(*) AS a FROM grams GROUP BY lang, phrase),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND a >= 10),
cuts AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp
         FROM cand, (SELECT unnest([1, 2]) AS k) WHERE k < m),
scored AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, ((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
           FROM cuts c JOIN f x ON c.lang = x.lang AND lp = x.phrase JOIN f y ON c.lang = y.lang AND rp = y.phrase),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
halves AS (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM cand WHERE m = 3),
widest AS (SELECT lang, phrase, max(a) AS whole FROM halves GROUP BY lang, phrase),
kept AS (SELECT w.* FROM worst w LEFT JOIN widest h ON w.lang = h.lang AND w.phrase = h.phrase WHERE coalesce(100 * whole < 50 * w.a, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))
