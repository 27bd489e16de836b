"""Near-duplicate documents: SimHash groups, then an exact join on the Jaccard similarity of shingles.

Fingerprints of five-word shingles find copies and almost equal texts cheaply: the members of a SimHash group that
have the similarity with its first document go. What is left goes through the similarity join of lines with a whole
document as one line and its shingles as the words, which finds every pair at the similarity or above and verifies
it. A document goes where an earlier one is that similar, so that no two such documents stay.

Shingles are digests computed from the texts wherever they are needed; neither they nor the texts are written or
moved. Only prefixes of digests, the digests of candidates and ids are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkwise.llm import simhash
from perkwise.llm.linededup import Reader, _mixed, repeated_lines, verified, words_of
from perkwise.session import small_batches, stage, tidy

WORDS = 5
SIMILARITY = (4, 5)
# What a text without a word has in place of shingles, so that all such texts are equal.
_WORDLESS = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digest of each shingle, its text, text of each text, zeros): fewer words are one shingle, none are one of their own."""
    # A line end is white space here.
    digest, line, text_of, _ = words_of(texts)
    own = text_of[line]
    n = np.bincount(own, minlength=len(texts))
    lack = np.where((n > 0) & (n < words), words - n, 0)
    end = np.repeat(np.cumsum(n), lack)
    digest, own = np.insert(digest, end, np.uint64(0)), np.insert(own, end, np.repeat(np.arange(len(texts)), lack))
    last = max(0, len(own) - words + 1)
    start = np.flatnonzero(own[:last] == own[words - 1:words - 1 + last])
    mark = np.zeros(len(start), np.uint64)
    for i in range(words):
        mark = _mixed(mark + _mixed(digest[start + i] + np.uint64(i + 1)))
        mark = mark * np.uint64(3) + np.uint64(1)
    none = np.flatnonzero(n == 0)
    at = np.searchsorted(own[start], none)
    return np.insert(mark, at, _WORDLESS), np.insert(own[start], at, none), np.arange(len(texts)), np.zeros(len(texts), np.int64)


def reader(words: int) -> Reader:
    """Whole texts as units, their shingles as words."""
    return Reader(lambda text: [text], lambda texts: shingles(texts, words))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows with ``__key``, whose order is that of (id, digest of the text), null ids last; equal rows once.

    Where ids are whole numbers that are there and differ, they are the keys, and nothing is moved.
    """
    ids = docs.groupBy(id_col).count()
    whole = docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    if whole and ids.filter(F.col(id_col).isNull() | (F.col("count") > 1)).isEmpty():
        return docs.withColumn("__key", F.col(id_col).cast("long"))
    named = docs.withColumn("__text_key", F.xxhash64(text_col)).dropDuplicates([id_col, "__text_key"])
    keys = named.select(F.col(id_col).alias("__id"), F.col("__text_key").alias("__of_text"))
    keys = stage(keys.orderBy(F.col("__id").asc_nulls_last(), "__of_text").withColumn("__key", F.monotonically_increasing_id()), "document-keys")
    joined = named.join(keys, named[id_col].eqNullSafe(keys["__id"]) & (named["__text_key"] == keys["__of_text"]))
    return stage(joined.select(*docs.columns, "__key"), "documents-by-key")


def keep_first(docs: DataFrame, words: int = WORDS, t: tuple[int, int] = SIMILARITY,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that have an earlier one of similarity ``t`` or more.

    The order is by id, null ids last, then by a digest of the text; of rows of equal id and text one stays.
    Texts without a word, null ones too, are equal. Columns whose names begin with two underscores may be there.
    """
    names = [f"__c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names))
    renamed = docs.toDF(*names)
    rows = _keyed(renamed, own[id_col], own[text_col])
    texts = rows.select("__key", F.coalesce(own[text_col], F.lit("")).alias("__text"))
    with small_batches(docs.sparkSession), tidy(docs.sparkSession) as result:
        groups = simhash.near_duplicates(texts, words, id_col="__key", text_col="__text")
        alike = groups.filter("component_id < `__key`").select(
            F.col("__key").alias("doc"), F.lit(0).alias("line"), F.lit(0).cast("long").alias("crc"),
            F.col("component_id").alias("other_doc"), F.lit(0).alias("other_line"))
        close = stage(verified(texts, stage(alike, "simhash-pairs"), t, "__key", "__text", reader(words))
                      .select(F.col("doc").alias("__key")), "simhash-gone")
        left = texts.join(close, "__key", "left_anti")
        # Parity maps say little about long documents, so any three candidates end a search; where they fail it goes on.
        far = repeated_lines(left, t, "__key", "__text", min_words=1, alike=128, reader=reader(words)).select(F.col("doc").alias("__key"))
        gone = result(close.unionByName(far).distinct(), "near-duplicates-gone")
    return rows.join(gone, "__key", "left_anti").select(*[F.col(n).alias(c) for c, n in own.items()])
