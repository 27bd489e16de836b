"""A training corpus from the documents: language, repeated lines, near-duplicates, mixture, packed windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perkwise.llm import langid, linededup, mixing, shinglejoin
from perkwise.llm.queries import packed_digests, tokenizer_path
from perkwise.session import stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a missing language is filled in."""
    kept = langid.identify(docs, langid.fit(docs)).filter("not rejected")
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; those of which no word is left go."""
    kept = linededup.drop_repeated_lines(docs, min_words=1)
    emptied = (F.size("removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return kept.filter(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: SimHash groups of five-word shingles, then all pairs that share 0.8 or more of them."""
    return shinglejoin.keep_first(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture of sources takes it."""
    return mixing.mixed_documents(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in windows of 2048 tokens."""
    return packed_digests(docs, tokenizer_path())


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("near-dedup", near_duplicates),
    ("mixing", mixture),
    ("packing", packed),
]

# Trained centroids, a similarity join and a tokenizer are beyond SQL; the stages are tested on their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another over ``documents``, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
