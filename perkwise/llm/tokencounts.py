"""Token counts of a sentencepiece model, from one count per distinct pre-token.

Merges never cross a place where no piece of the vocabulary has two neighbouring letters: before a blank, and on
both sides of a letter that only stands alone. Texts are cut there into pre-tokens, so the count of a text is the
sum over its pre-tokens. Each distinct pre-token is encoded once in the whole job; documents hold frequencies.

The most frequent pre-tokens, at most ``KNOWN`` of at most ``KNOWN_CHARS`` letters, are copied to all tasks, so a
word that every document has never meets in one task; the others travel with their document's number to the table of
counts and back as sums. Token ids of documents are never built.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkwise.llm.common import windows
from perkwise.session import stage

LIMIT = 4096
KNOWN = 200_000
KNOWN_CHARS = 48
HELD = 500_000
ENCODED_AT_ONCE = 10_000
_BLANKS = " ▁"


class Model:
    """A sentencepiece model with the cuts that its vocabulary allows."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())
                  if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        if any(re.search("[^▁]▁", piece) for piece in pieces):
            raise ValueError("a piece goes on after a blank, so that words cannot be counted on their own")
        joining = {letter for piece in pieces if len(piece) > 1 for letter in piece} - set(_BLANKS)
        self.alone = next(c for c in map(chr, range(1, 0x110000)) if c not in joining and c not in _BLANKS)
        inner = "".join(map(re.escape, sorted(joining))) or "\\Z"
        self.cuts = re.compile(f"[{_BLANKS}]+[{inner}]*|[{inner}]+|[^{inner}{_BLANKS}]")
        # The letter that stands alone takes up the blank that the library puts before every text.
        self.before = len(self.library.encode(self.alone))

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, in lists of bounded size; those of "" are none."""
        first = " "
        for part in windows(text, space=lambda c: c in _BLANKS) if text else ():
            # A run of blanks belongs together, so a part that begins inside one waits for its end.
            if part.strip(_BLANKS):
                yield self.cuts.findall(first + part.rstrip(_BLANKS))
                first = part[len(part.rstrip(_BLANKS)):]
            else:
                first += part
        if text and first:
            yield self.cuts.findall(first)

    def lengths(self, pre_tokens: list[str]) -> list[int]:
        """How many pieces each has."""
        out: list[int] = []
        for start in range(0, len(pre_tokens), ENCODED_AT_ONCE):
            some = [self.alone + x for x in pre_tokens[start:start + ENCODED_AT_ONCE]]
            out.extend(len(ids) - self.before for ids in self.library.encode(some, num_threads=1))
        return out


def frequencies(model: Model, text: str | None) -> Counter:
    out: Counter = Counter()
    for some in model.pre_tokens(text or ""):
        out.update(some)
    return out


def piece_counts(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(pre, n, pieces): every distinct pre-token, its occurrences and its number of pieces."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Model(path), Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pre", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for some in model.pre_tokens(text or ""):
                    seen.update(some)
                if len(seen) > HELD:
                    yield rows()
                    seen.clear()
        yield rows()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(model.lengths(batch.column(0).to_pylist()), pa.int64())], names=["pre", "n", "pieces"])

    seen = docs.select(text_col).mapInArrow(count, "pre string, n long").groupBy("pre").agg(F.sum("n").alias("n"))
    return seen.mapInArrow(encode, "pre string, n long, pieces long")


def frequent(counts: DataFrame, most: int = KNOWN) -> dict[str, int]:
    """The pieces of the most frequent short pre-tokens: at most ``most``, down to a power of two of occurrences."""
    short = counts.filter(F.length("pre") <= KNOWN_CHARS).withColumn("level", F.floor(F.log2("n")).cast("int"))
    sizes = {r["level"]: r["count"] for r in short.groupBy("level").count().collect()}
    least, room = max(sizes, default=0) + 1, most
    while least - 1 in range(max(sizes, default=0) + 1) and sizes.get(least - 1, 0) <= room:
        least -= 1
        room -= sizes.get(least, 0)
    return {r["pre"]: r["pieces"] for r in short.filter(F.col("level") >= least).select("pre", "pieces").collect()}


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text",
                 known: int = KNOWN) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit): one row per row of ``docs``, repeated rows and null ids included.

    ``n_bytes`` is the length of the text in UTF-8, ``n_tokens`` what the library gives for the whole text without
    begin and end. A null text counts as empty, with 0 of both. Other columns are ignored; an empty table gives no rows.
    """
    counts = stage(piece_counts(docs, path, text_col), "pre-tokens")
    table = docs.sparkSession.sparkContext.broadcast(frequent(counts, known))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pieces = Model(path), table.value
        for batch in batches:
            sums, others = [], []
            for text in batch.column(3).to_pylist():
                found, open_ = 0, []
                for pre, n in frequencies(model, text).items():
                    length = pieces.get(pre)
                    if length is None:
                        open_.append({"pre": pre, "n": n})
                    else:
                        found += length * n
                sums.append(found)
                others.append(open_)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sums, pa.int64()), pa.array(others, pa.list_(pa.struct([("pre", pa.string()), ("n", pa.int64())])))],
                names=["row", "id", "n_bytes", "known", "others"])

    kind = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    rows = stage(named.mapInArrow(look, f"row long, id {kind}, n_bytes long, known long, others array<struct<pre: string, n: long>>"), "pre-token-rows")
    rest = (rows.select("row", F.inline("others")).join(counts.select("pre", "pieces"), "pre")
            .groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rest")))
    total = (F.col("known") + F.coalesce("rest", F.lit(0))).alias("n_tokens")
    return (rows.drop("others").join(rest, "row", "left").select(F.col("id").alias(id_col), "n_bytes", total)
            .withColumn("over_limit", F.col("n_tokens") > limit))
