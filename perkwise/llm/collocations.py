"""Phrase collocations from weighted automata of word sequences.

Tasks count the words of a shard, sort them and build one automaton per range of prefixes; a range
is an interval of the digest of a sequence's first two words, so that the sequences of a very frequent word are in
all ranges. The automata of a range are united and their weights summed. Two words can only be frequent together if
each of them is, three words if both pairs in them are: a second and a third pass count those that pass a table of
bits, fixed in size, of what the pass before found frequent. What shares its bit with something else costs work and
changes no result. The counts of a candidate's parts come
from composing an automaton of all parts asked for with the united automata of their ranges.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkwise.llm.automata import NONE, composed, in_order, restricted, rows, united
from perkwise.llm.common import windows
from perkwise.operators.keyed import top_k
from perkwise.session import stage

LEAST = 10
INSIDE = 50
RANGE_CHARS = 1 << 24
SHARD_WORDS = 1 << 21
SHARD_ALPHABET = 1 << 19
ROWS_AT_ONCE = 512
BITS = 27
SLICES = 64
_BREAKS = ".,;:!?\n\x0b\x0c\r"
# Byte 255 is in no UTF-8 text: it stands for the end of a piece.
_END = b"\xff"
_FOLDED = bytes(255 if chr(c) in _BREAKS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_digests(lang: str, words: list[bytes]) -> np.ndarray:
    seed = zlib.crc32(lang.encode("utf-8", "replace"))
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_digests(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mixed(first * np.uint64(3) + _mixed(second))


def prefix_digests(digest: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The digest of the first two words of each sequence, or of its only one."""
    return np.where(grams[:, 1] >= 0, pair_digests(digest[grams[:, 0]], digest[np.maximum(grams[:, 1], 0)]), _mixed(digest[grams[:, 0]]))


def prefix_ranges(digest: np.ndarray, grams: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each sequence: the interval that the digest of its prefix lies in."""
    prefix = prefix_digests(digest, grams)
    return ((prefix >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)


class Shard:
    """The words of some texts of one language as numbers, 0 between pieces."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.parts: list[np.ndarray] = []
        self.size = self.numbers[_END]

    def add(self, texts: list[bytes]) -> None:
        words = (b" " + _END + b" ").join([t.translate(_FOLDED).replace(_END, b" \xff ") for t in texts]).split()
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.parts.append(np.zeros(1, np.int32))
        self.size += len(words)

    def sorted(self) -> tuple[pa.Array, np.ndarray]:
        """(alphabet in byte order, numbers of the words in it with ``NONE`` between pieces)."""
        words = pa.array(list(self.numbers)[1:], pa.binary())
        by = pa.compute.sort_indices(words).to_numpy()
        place = np.full(len(words) + 1, NONE, np.int32)
        place[1 + by] = np.arange(len(words), dtype=np.int32)
        return words.take(pa.array(by)), place[np.concatenate([np.zeros(1, np.int32), *self.parts])]


Counted = tuple[np.ndarray, np.ndarray]


def single_words(ids: np.ndarray, digest: np.ndarray) -> Counted:
    weights = np.bincount(ids[ids >= 0], minlength=len(digest))
    grams = np.full((len(digest), 3), NONE, np.int32)
    grams[:, 0] = np.arange(len(digest))
    return grams[weights > 0], weights[weights > 0]


def pairs(bits: np.ndarray) -> Callable[[np.ndarray, np.ndarray], Counted]:
    """Counts the pairs of words both of which have their bit."""

    def of(ids: np.ndarray, digest: np.ndarray) -> Counted:
        # The last place stands for the number between pieces.
        fine = np.r_[_marked(bits, _mixed(digest)), False][ids]
        two = np.flatnonzero(fine[:-1] & fine[1:])
        grams = np.full((len(two), 3), NONE, np.int32)
        grams[:, 0], grams[:, 1] = ids[two], ids[two + 1]
        return in_order(grams)

    return of


def triples(bits: np.ndarray) -> Callable[[np.ndarray, np.ndarray], Counted]:
    """Counts the triples of words both pairs of which have their bit."""

    def of(ids: np.ndarray, digest: np.ndarray) -> Counted:
        two = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0)) if len(ids) else np.zeros(0, np.int64)
        two = two[_marked(bits, pair_digests(digest[ids[two]], digest[ids[two + 1]]))] if len(two) else two
        three = two[:-1][two[1:] == two[:-1] + 1]
        grams = np.stack([ids[three], ids[three + 1], ids[three + 2]], axis=1) if len(three) else np.zeros((0, 3), np.int32)
        return in_order(grams)

    return of


def _bit(digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = digest & np.uint64((1 << BITS) - 1)
    return (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8)


def _marked(bits: np.ndarray, digest: np.ndarray) -> np.ndarray:
    at, bit = _bit(digest)
    return bits[at] & bit > 0


def _messages(lang: str, alphabet: pa.Array, digest: np.ndarray, counted: Counted, ranges: int) -> Iterator[pa.RecordBatch]:
    """One automaton for each range that some of the sequences are in, with its words; both travel compressed.

    The more ranges there are, the more of them a word is in, so that the words are what grows. No word holds a line end.
    """
    grams, weights = counted
    number = prefix_ranges(digest, grams, ranges)
    order = np.argsort(number, kind="stable")
    texts = alphabet.cast(pa.string())
    found, starts = np.unique(number[order], return_index=True)
    for i, a, b in zip(found.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
        words, automaton = restricted(texts, grams[order[a:b]], weights[order[a:b]])
        joined = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_buffer()
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang], pa.string()), pa.array([i], pa.int32()), pa.array([zlib.compress(joined, 1)], pa.binary()),
             pa.array([zlib.compress(automaton, 1)], pa.binary())], names=["lang", "range", "words", "automaton"])


def _opened(messages: pa.Table) -> tuple[pa.ListArray, list[bytes]]:
    """(alphabets, automata) of some messages."""
    joined = pa.array(map(zlib.decompress, messages.column("words").to_pylist()), pa.binary()).cast(pa.string())
    return pa.compute.split_pattern(joined, "\n"), list(map(zlib.decompress, messages.column("automaton").to_pylist()))


_MESSAGE = "lang string, range int, words binary, automaton binary"
_UNITED = "lang string, range int, words array<string>, automaton binary, n long"


def shard_automata(docs: DataFrame, counter: Callable[[], Callable[[np.ndarray, np.ndarray], Counted]], ranges: int) -> DataFrame:
    """(lang, range, words, automaton) of every shard of (lang, text), as ``_messages`` packs them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, shards = counter(), defaultdict(Shard)

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, shard in shards.items():
                alphabet, ids = shard.sorted()
                digest = word_digests(lang, alphabet.to_pylist())
                counted = of(ids, digest)
                if len(counted[0]):
                    yield from _messages(lang, alphabet, digest, counted, ranges)
            shards.clear()

        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            by_lang = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang[lang].append(text)
            for lang, texts in by_lang.items():
                held, size = [], 0
                for text in texts:
                    for part in windows(text, space=_BREAKS.__contains__):
                        held.append(part.encode("utf-8", "replace"))
                        size += len(part)
                        if size > 1 << 20:
                            shards[lang].add(held)
                            held, size = [], 0
                            if shards[lang].size > SHARD_WORDS or len(shards[lang].numbers) > SHARD_ALPHABET:
                                yield from flush()
                if held:
                    shards[lang].add(held)
                if sum(s.size for s in shards.values()) > SHARD_WORDS or sum(len(s.numbers) for s in shards.values()) > SHARD_ALPHABET:
                    yield from flush()
        yield from flush()

    return docs.mapInArrow(run, _MESSAGE)


def union(shards: DataFrame, least: int) -> DataFrame:
    """(lang, range, words, automaton, n): the united automata of each range, cut to sequences of ``least`` and more.

    ``n`` is the number of words in the range, rare ones included.
    """

    def unite(group: pa.Table) -> pa.Table:
        words, grams, weights = united(*_opened(group))
        n = int(weights[grams[:, 1] < 0].sum())
        keep = weights >= least
        own, automaton = restricted(words, grams[keep], weights[keep])
        return pa.table([group.column("lang")[:1], group.column("range")[:1], pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                         pa.array([automaton], pa.binary()), pa.array([n], pa.int64())], names=["lang", "range", "words", "automaton", "n"])

    return shards.groupBy("lang", "range").applyInArrow(unite, _UNITED)


def phrases(counts: DataFrame, fewest: int = 1) -> DataFrame:
    """(lang, phrase, a): the sequences of ``fewest`` words or more, joined by blanks, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words, automaton in zip(*(batch.column(i).to_pylist() for i in range(3))):
                grams, weights = rows(automaton)
                keep = grams[:, fewest - 1] >= 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * int(keep.sum()), pa.string()), pa.array(_joined(words, grams[keep]), pa.string()), pa.array(weights[keep])],
                    names=["lang", "phrase", "a"])

    return counts.select("lang", "words", "automaton").mapInArrow(run, "lang string, phrase string, a long")


def _joined(words: list[str], grams: np.ndarray) -> list[str]:
    return [" ".join([words[i] for i in gram if i >= 0]) for gram in grams.tolist()]


def frequent_bits(counts: DataFrame) -> np.ndarray:
    """A table of 2^27 bits, 16 MB at any size, with those of the words or pairs in the automata set."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (BITS - 3), np.uint8)
        for batch in batches:
            for lang, words, automaton in zip(*(batch.column(i).to_pylist() for i in range(3))):
                grams, _ = rows(automaton)
                digest = word_digests(lang, [w.encode("utf-8", "replace") for w in words])
                if len(grams):
                    np.bitwise_or.at(bits, *_bit(prefix_digests(digest, grams)))
        for i, part in enumerate(bits.reshape(SLICES, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], names=["slice", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts[i] = parts.get(i, np.uint8(0)) | np.frombuffer(zlib.decompress(x), np.uint8)
        for i, x in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)])], names=["slice", "bits"])

    marked = counts.select("lang", "words", "automaton").mapInArrow(mark, "slice int, bits binary")
    table = np.zeros((SLICES, (1 << (BITS - 3)) // SLICES), np.uint8)
    for r in marked.repartition(8, "slice").mapInArrow(join, "slice int, bits binary").collect():
        table[r["slice"]] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return table.reshape(-1)


def looked_up(parts: DataFrame, counts: DataFrame, ranges: int) -> DataFrame:
    """(lang, phrase, f): the counts of distinct (lang, phrase) of one or two words, by composition in their ranges."""

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang = defaultdict(list)
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang[lang].append(phrase.split(" "))
            for lang, asked in by_lang.items():
                alphabet = sorted({w.encode("utf-8", "replace") for words in asked for w in words})
                number = {w.decode("utf-8", "replace"): i for i, w in enumerate(alphabet)}
                grams = np.array([[number[w] for w in words] + [NONE] * (3 - len(words)) for words in asked], np.int32)
                yield from _messages(lang, pa.array(alphabet, pa.binary()), word_digests(lang, alphabet), in_order(grams), ranges)

    def compose(asked: pa.Table, counted: pa.Table) -> pa.Table:
        alphabets, automata = _opened(asked)
        alphabets = pa.concat_arrays([alphabets, counted.column("words").combine_chunks().cast(alphabets.type)])
        automata += counted.column("automaton").to_pylist()
        empty = restricted(pa.array([], pa.string()), np.zeros((0, 3), np.int32), np.zeros(0, np.int64))[1]
        # One alphabet for both sides, so that words are the same numbers in both.
        n = asked.num_rows
        words, *left = united(alphabets, automata[:n] + [empty] * counted.num_rows)
        _, *right = united(alphabets, [empty] * n + automata[n:])
        grams, weights = composed(tuple(left), tuple(right))
        lang = asked.column("lang")[0].as_py() if n else ""
        return pa.table([pa.array([lang] * len(grams), pa.string()), pa.array(_joined(words.to_pylist(), grams), pa.string()), pa.array(weights, pa.int64())],
                        names=["lang", "phrase", "f"])

    asked = parts.select("lang", "phrase").mapInArrow(accept, _MESSAGE)
    return (asked.groupBy("lang", "range").cogroup(counts.select("lang", "range", "words", "automaton").groupBy("lang", "range"))
            .applyInArrow(compose, "lang string, phrase string, f long"))


def _cuts(words: Column) -> Column:
    """(k, left, right) for each way to cut a phrase."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice(words, 1, k), " ").alias("left"), F.array_join(F.slice(words, k + 1, F.size(words)), " ").alias("right")))


def collocations(docs: DataFrame, most: int = 2000, least: int = LEAST, inside: int = INSIDE, lang_col: str = "lang",
                 text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``most`` best phrases of two or three words of each language.

    Texts in A-Z folded to a-z are cut into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs.
    Phrases of ``least`` occurrences or more score floor(10^6 a^2 / (l r)) by their worst cut, of equal ones the
    first; one that lies in a longer phrase with ``inside`` percent of its occurrences goes. Order: score and count
    falling, then the phrase's bytes. A null language is ``und``, a null text empty; every row counts, repeated ones
    too; other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.coalesce(text_col, F.lit("")).alias("text"))
    chars = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    ranges = max(1, -(-chars // RANGE_CHARS))
    copied = docs.sparkSession.sparkContext.broadcast
    single = stage(union(shard_automata(texts, lambda: single_words, ranges), least), "word-automata")
    of_words = copied(frequent_bits(single))
    double = stage(union(shard_automata(texts, lambda: pairs(of_words.value), ranges), least), "pair-automata")
    of_pairs = copied(frequent_bits(double))
    longer = stage(union(shard_automata(texts, lambda: triples(of_pairs.value), ranges), least), "triple-automata")
    counts = single.unionByName(double)
    found = phrases(double, 2).unionByName(phrases(longer, 3))
    words = F.split("phrase", " ")
    cut = found.select("lang", "phrase", "a", F.inline(_cuts(words)))
    sides = stage(cut.select("lang", "phrase", "a", "k", F.inline(F.array(
        F.struct(F.lit("l").alias("side"), F.col("left").alias("part")), F.struct(F.lit("r").alias("side"), F.col("right").alias("part"))))), "phrase-parts")
    known = looked_up(sides.select("lang", F.col("part").alias("phrase")).distinct(), counts, ranges)
    joined = sides.join(known.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    by_cut = joined.groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    by_cut = by_cut.withColumn("above", (F.lit(1_000_000).cast("decimal(7,0)") * wide["a"] * wide["a"]).cast("decimal(38,0)"))
    by_cut = by_cut.withColumn("below", (wide["l"] * wide["r"]).cast("decimal(38,0)")).withColumn("score", F.expr("above div below"))
    scored = by_cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.score", "x.l", "x.r")
    of_three = phrases(longer, 3)
    halves = of_three.select("lang", F.col("a").alias("whole"), F.explode(F.array(
        F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 2), " "))).alias("phrase"))
    widest = halves.groupBy("lang", "phrase").agg(F.max("whole").alias("whole"))
    kept = scored.join(widest, ["lang", "phrase"], "left").filter(~F.coalesce(F.col("whole") * 100 >= F.col("a") * inside, F.lit(False))).drop("whole")
    ranked = top_k(kept, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], most, hot_keys=True)
    total = single.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
