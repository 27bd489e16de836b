"""Embedding tables and offer retrieval under business rules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from perkwise.operators.keyed import upsert
from perkwise.operators.nearest import nearest
from perkwise.operators.ordering import exact_percentiles

# Vector width, over-fetch factor and the offer used when nothing is found.
DIMENSIONS = 384
OVERFETCH = 4
TOP_K = 5
FALLBACK_OFFER = {
    "offer_id": "fallback",
    "title": "Loyalty Reward",
    "description": "Earn bonus points on your next visit.",
    "category": "general",
    "score": 0.0,
}


class UnknownOffer(ValueError):
    """Raised when an offer to re-embed is not in the catalogue."""


def embed_hashed(rows: DataFrame, text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """Add a unit vector of hashed word counts: the built-in encoder."""
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\W+"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimensions),
        Normalizer(inputCol="_counts", outputCol="_unit"),
    ]
    filled = rows.withColumn(text, F.coalesce(text, F.lit("")))
    model = Pipeline(stages=stages).fit(filled)
    return model.transform(filled).select(
        *rows.columns, vector_to_array("_unit", "float32").alias("embedding")
    )


def embed_with(rows: DataFrame, make_encoder, text: str = "text", batch_size: int = 64) -> DataFrame:
    """Add vectors from any encoder: ``make_encoder()`` runs once per task and returns a function
    from a list of texts to a list of vectors."""
    schema = rows.select("*", F.lit(None).cast("array<float>").alias("embedding")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for batch in batches:
            texts = batch[text].tolist()
            vectors = []
            for start in range(0, len(texts), batch_size):
                vectors.extend(encode(texts[start : start + batch_size]))
            yield batch.assign(embedding=[[float(x) for x in v] for v in vectors])

    return rows.mapInPandas(run, schema)


def upsert_embeddings(existing: DataFrame, batch: DataFrame, order: str = "arrival") -> DataFrame:
    """Embeddings by id; the last of the batch wins."""
    return upsert(existing, batch, ["id"], [order])


def reembed(
    existing: DataFrame, catalogue: DataFrame, ids: DataFrame, embed, strict: bool = True
) -> DataFrame:
    """Embed the chosen offers again and store them; an unknown id is an error when strict."""
    if strict:
        unknown = ids.join(catalogue.select("id"), "id", "left_anti").head(1)
        if unknown:
            raise UnknownOffer(f"offer {unknown[0]['id']!r} is not in the catalogue")
    chosen = catalogue.join(ids.select("id"), "id", "left_semi")
    fresh = embed(chosen).select(*existing.columns).withColumn("arrival", F.lit(0))
    return upsert_embeddings(existing, fresh)


def delete_offers(existing: DataFrame, ids: DataFrame) -> DataFrame:
    return existing.join(ids.select("id"), "id", "left_anti")


def count_indexed(existing: DataFrame) -> DataFrame:
    return existing.agg(F.count(F.lit(1)).alias("indexed"))


def _judged(found: DataFrame, queries: DataFrame, offers: DataFrame) -> DataFrame:
    """Neighbours with ``eligible``: the propensity reaches the offer's threshold (0 when missing).

    Only ids and numbers travel here; titles and texts are joined to the final rows.
    """
    thresholds = offers.select("id", F.coalesce("min_propensity_threshold", F.lit(0.0)).alias("_minimum"))
    return (
        found.join(thresholds, "id")
        .join(queries.select("query_id", "propensity"), "query_id")
        .select("query_id", "id", "score", "rank", (F.col("propensity") >= F.col("_minimum")).alias("eligible"))
    )


def _first(kept: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("position", F.row_number().over(place)).filter(F.col("position") <= k)


def _described(rows: DataFrame, offers: DataFrame, score: Column) -> DataFrame:
    details = offers.select("id", "title", "description", "category")
    return rows.join(details, "id").select(
        "query_id", "position", F.col("id").alias("offer_id"), "title", "description", "category",
        score.alias("score"),
    )


def retrieve(
    queries: DataFrame, offers: DataFrame, k: int = TOP_K, metric: str = "cosine", neighbours=nearest
) -> DataFrame:
    """Offers per query (query_id, embedding, propensity): the nearest 4k, less those whose
    threshold exceeds the propensity, then the first k. A query may end up with fewer than k."""
    found = neighbours(queries, offers, k * OVERFETCH, metric=metric)
    kept = _judged(found, queries, offers).filter("eligible")
    return _described(_first(kept, k), offers, F.col("score"))


def retrieve_or_all(
    queries: DataFrame, offers: DataFrame, k: int = TOP_K, neighbours=nearest,
    breadth: int | None = None,
) -> DataFrame:
    """Of the ``breadth`` (by default k) nearest offers those a query is eligible for, or all of them when it
    is eligible for none; the first k.

    The score is 1 / (1 + original place).
    """
    judged = _judged(neighbours(queries, offers, max(k, breadth or k), metric="cosine"), queries, offers)
    whole = Window.partitionBy("query_id")
    kept = judged.withColumn("_any", F.max("eligible").over(whole)).filter(
        F.col("eligible") | ~F.col("_any")
    )
    return _described(_first(kept, k), offers, F.lit(1.0) / F.col("rank"))


def with_fallback(customers: DataFrame, retrieved: DataFrame, key: str = "query_id") -> DataFrame:
    """The best offer of every customer, or the fallback offer where nothing was retrieved."""
    best = retrieved.filter(F.col("position") == 1).select(
        key, F.struct("offer_id", "title", "description", "category", "score").alias("_best")
    )
    fallback = F.struct(*[F.lit(v).alias(c) for c, v in FALLBACK_OFFER.items()])
    return (
        customers.select(key).join(best, key, "left")
        .select(key, F.coalesce("_best", fallback).alias("_best"))
        .select(key, "_best.*")
    )


def display_defaults(rows: DataFrame) -> DataFrame:
    """Fill in what a document lacks: id from its place, title and description from its text."""
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        "query_id",
        F.coalesce("offer_id", F.concat(F.lit("doc_"), (F.col("rank") - 1).cast("string"))).alias("offer_id"),
        F.coalesce("title", F.substring(text, 1, 60)).alias("title"),
        F.coalesce("description", text).alias("description"),
        F.coalesce("category", F.lit("")).alias("category"),
    )


def answer_summary(queries: DataFrame, retrieved: DataFrame) -> DataFrame:
    """A sentence with the number of offers and their descriptions in order (at most k per query)."""
    lists = retrieved.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "description"))).alias("_found")
    )
    descriptions = F.coalesce(
        F.transform("_found", lambda o: o["description"]), F.array().cast("array<string>")
    )
    return queries.select("query_id").join(lists, "query_id", "left").select(
        "query_id",
        # Fixed value: the sentence of an answer.
        F.format_string("Retrieved %d offers for context.", F.size(descriptions)).alias("answer"),
        descriptions.alias("filtered_offers"),
    )


def precision_at_k(queries: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Share of the returned offers having the expected category; 0 when none is returned."""
    expected = queries.select("query_id", "expected_category")
    hits = retrieved.join(expected, "query_id").groupBy("query_id").agg(
        F.avg((F.col("category") == F.col("expected_category")).cast("double")).alias("_p")
    )
    return expected.select("query_id").join(hits, "query_id", "left").select(
        "query_id", F.coalesce("_p", F.lit(0.0)).alias("precision")
    )


def latency_summary(runs: DataFrame, warmup: int = 0, groups: tuple[str, ...] = ("retriever",)) -> DataFrame:
    """Exact p50, p95 and mean per retriever; runs numbered below ``warmup`` are left out."""
    measured = runs.filter(F.col("run") >= warmup)
    cuts = exact_percentiles(
        measured, "latency_ms", {"latency_p50_ms": 0.50, "latency_p95_ms": 0.95}, groups
    )
    means = measured.groupBy(*groups).agg(
        F.avg("latency_ms").alias("latency_mean_ms"), F.count(F.lit(1)).alias("runs")
    )
    return cuts.join(means, list(groups))


def winners(summary: DataFrame) -> DataFrame:
    """Better retriever by latency (a tie goes to the second) and by precision (to the first)."""
    fastest = F.min_by("retriever", F.struct("latency_p50_ms", (-F.col("place")).alias("p")))
    sharpest = F.max_by("retriever", F.struct("precision_at_k", (-F.col("place")).alias("p")))
    return summary.agg(fastest.alias("winner_latency"), sharpest.alias("winner_precision"))
