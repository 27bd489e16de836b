"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

A document's tokens are cut into full windows, which need no partner, and a rest. Rests are halved again
and again into pieces of falling size and dealt at random into blocks of a bounded number of tokens; within
a block differencing spreads the pieces over near-equal windows.
"""

from __future__ import annotations

import heapq
import os
import re
import string
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkwise.llm import common
from perkwise.llm.common import lean, windows
from perkwise.session import small_batches, stage

CAPACITY = 2048
BLOCK_WINDOWS = 128
SMALLEST_CUT = 32
END_ID = 1
CACHED_WORDS = 200_000
PART_CHARS = 1 << 18
# Unicode's white space, which the tokenizer drops; str.split() also splits at U+001C to U+001F.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
# Below this code point, and only there surely, lower-casing commutes with normalising and nothing composes.
_BEYOND_LATIN = re.compile("[\u0250-\U0010ffff]")
# Byte-level vocabularies spell printable bytes as themselves and the others as the code points from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - _PRINTABLE))}
# White space to Python, but not to the tokenizer.
_ONLY_PYTHON = "\x1c\x1d\x1e\x1f"
_MARKS = string.punctuation


def _is_space(char: str) -> bool:
    return _SPACE.match(char) is not None


def _latin(text: str) -> bool:
    """No character from U+0250 on."""
    if text.isascii():
        return True
    try:
        # Much faster than a search, and true of most texts.
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _BEYOND_LATIN.search(text)
    return True


def _split(part: str) -> list[str]:
    """The words of a text, as the tokenizer sees white space."""
    if any(c in part for c in _ONLY_PYTHON):
        return [w for w in _SPACE.split(part) if w]
    return part.split()


class _KnownWords(dict):
    """The ids of words as bytes: those of a word not seen yet are made when it is asked for."""

    def __init__(self, tokenizer, older: dict[str, bytes]):
        super().__init__()
        self._encode, self._tokenize, self._older = tokenizer.encode, tokenizer.model.tokenize, older

    def __missing__(self, word: str) -> bytes:
        ids = self._older.get(word)
        if ids is None:
            ids = self._made(word)
        self[word] = ids
        return ids

    def _made(self, word: str) -> bytes:
        base = word.rstrip(_MARKS)
        if base and len(base) < len(word) and base[-1] < "\u0100" and base[-1].isalnum() and "<|" not in word:
            return self[base] + self[word[len(base):]]
        if word.isalpha() and word.islower() and (word.isascii() or not _BEYOND_LATIN.search(word)):
            # Nothing to normalise or to split: such a word goes to the model as it is, in its byte alphabet.
            spelled = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
            return array("i", [t.id for t in self._tokenize(spelled)]).tobytes()
        return array("i", self._encode(word, add_special_tokens=False).ids).tobytes()


class WordTokenizer:
    """Token ids of texts, word by word.

    The tokenizer never joins characters across white space, nor a letter or digit to the marks after it, so
    each distinct word is encoded once, without its closing marks, and kept in two tables of bounded size
    (the older one is dropped when the newer one is full). Latin texts are lower-cased first, as the
    tokenizer would do, unless they may hold one of its special tokens. A text's ids are those of its words, looked up
    one after another and joined as bytes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._words = _KnownWords(self._tokenizer, {})

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        values, counts = self.flat(texts)
        return np.split(values, np.cumsum(counts)[:-1])

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the number of ids of each text."""
        counts, values = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)]
        parts: list[str] = []
        of: list[int] = []
        size = 0

        def encode() -> None:
            ids, n = self._parts(parts)
            values.append(ids)
            np.add.at(counts, of, n)
            parts.clear()
            of.clear()

        for i, text in enumerate(texts):
            for part in windows(text, space=_is_space):
                if "<|" not in part and _latin(part):
                    part = part.lower()
                parts.append(part)
                of.append(i)
                size += len(part)
                if size > PART_CHARS:
                    encode()
                    size = 0
        if parts:
            encode()
        return np.concatenate(values), counts

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self._words) > CACHED_WORDS:
            self._words = _KnownWords(self._tokenizer, dict(self._words))
        ids_of = self._words.__getitem__
        blobs = [b"".join(map(ids_of, _split(part))) for part in parts]
        return np.frombuffer(b"".join(blobs), np.int32), np.fromiter((len(b) // 4 for b in blobs), np.int64, len(blobs))


_TOKENS = "tokens"


def worker_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for all tasks of a worker process, so that what it has learned is used again; tasks of other kinds drop it."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    kept = common.KEPT.setdefault(_TOKENS, {})
    if path not in kept:
        kept[path] = WordTokenizer(path)
    return kept[path]


def rest_cuts(rest: int, smallest: int = SMALLEST_CUT) -> list[int]:
    """Lengths of the pieces of a rest: half of it, half of what is left, and so on."""
    out = []
    while rest > smallest:
        out.append((rest + 1) // 2)
        rest -= out[-1]
    return [*out, rest] if rest else out


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each piece, by multiway differencing.

    Every partial partition is an ascending vector of window sums less their minimum. The two of the
    largest spread are merged, the fullest window of one with the emptiest of the other, until one is left.
    """
    n = len(sizes)
    if windows <= 1 or n == 0:
        return np.zeros(n, np.int64)
    size = sizes.tolist()
    sums: dict[int, np.ndarray] = {}
    merges: list[tuple[int, int, np.ndarray]] = []
    heap = [(-s, i) for i, s in enumerate(size)]
    heapq.heapify(heap)
    bits = windows.bit_length()
    number, mask = np.arange(windows), (1 << bits) - 1
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        if a >= n:
            both = sums.pop(a)
        else:
            both = np.zeros(windows, np.int64)
            both[-1] = size[a]
        if b >= n:
            both += sums.pop(b)[::-1]
        else:
            both[0] += size[b]
        # Sum and place in one number: sorting it gives the sums in order and where each came from.
        both <<= bits
        both |= number
        both.sort()
        node = n + len(merges)
        merges.append((a, b, both & mask))
        both >>= bits
        both -= both[0]
        sums[node] = both
        heapq.heappush(heap, (-int(both[-1]), node))
    out = np.zeros(n, np.int64)
    places = {heap[0][1]: number}
    for i in range(len(merges) - 1, -1, -1):
        a, b, order = merges[i]
        left = np.empty(windows, np.int64)
        left[order] = places.pop(n + i)
        for node, where in ((a, left), (b, left[::-1])):
            if node >= n:
                places[node] = where
            else:
                out[node] = where[-1]
    return out


def spread(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each piece; one more window is tried whenever the fullest exceeds the capacity."""
    count = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = difference(sizes, count)
        if not len(sizes) or np.bincount(window, weights=sizes).max() <= capacity:
            return window
        count += 1


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document: (id, start, ids, n, doc_tokens, whole, uid). A null text is an empty one.

    ``ids`` are ``n`` little-endian 32-bit numbers, which Spark moves as one value.
    """
    key = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, made = worker_tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        cuts: dict[int, list[int]] = {}
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            first = 0
            sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
            while first < batch.num_rows:
                # So many documents at once that their words and tokens stay within a few megabytes.
                last, size = first + 1, sizes[first]
                while last < batch.num_rows and size + sizes[last] <= PART_CHARS:
                    size += sizes[last]
                    last += 1
                ids, counts = tokenizer.flat([t or "" for t in texts[first:last].to_pylist()])
                ids = np.insert(ids, np.cumsum(counts), end_id)
                rows, starts, lengths, totals, whole = [], [], [], [], []
                for i, n in enumerate((counts + 1).tolist()):
                    full, rest = divmod(n, capacity)
                    if rest not in cuts:
                        cuts[rest] = rest_cuts(rest)
                    own = [capacity] * full + cuts[rest]
                    rows += [first + i] * len(own)
                    lengths += own
                    starts += accumulate(own[:-1], initial=0)
                    totals += [n] * len(own)
                    whole += [True] * full + [False] * len(cuts[rest])
                uid = (np.int64(part) << 33) + made + np.arange(len(rows))
                made += len(rows)
                offsets = np.cumsum([0, *lengths]).astype(np.int64) * 4
                blobs = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<i4", copy=False))])
                yield pa.RecordBatch.from_arrays([
                    keys.take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), blobs.cast(pa.binary()),
                    pa.array(lengths, pa.int32()), pa.array(totals, pa.int64()), pa.array(whole), pa.array(uid),
                ], names=[id_col, "start", "ids", "n", "doc_tokens", "whole", "uid"])
                first = last

    schema = f"`{id_col}` {key}, start long, ids binary, n int, doc_tokens long, whole boolean, uid long"
    return docs.select(id_col, text_col).mapInArrow(lean(run, _TOKENS), schema)


def pack_bytes(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, block_windows: int = BLOCK_WINDOWS,
               end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """As ``pack``, with the ids of a piece as little-endian 32-bit numbers in one binary value.

    ``carry`` names what to return in place of the ids, as expressions of a piece's ``ids`` and ``n``; it is all that
    is written and shuffled, so where a checksum will do no ids are moved. Its names may not be those of other columns here.
    """
    carry = carry or {"ids": F.col("ids")}
    with small_batches(docs.sparkSession, 250, 1 << 20):
        pieces = stage(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col).select(
            id_col, "start", "n", "doc_tokens", "whole", "uid", *[value.alias(name) for name, value in carry.items()]), "pieces")
    rests = pieces.filter(~F.col("whole"))
    total = rests.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, round(total / (capacity * block_windows)))
    kept = [id_col, "start", *carry, "doc_tokens"]

    def place(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("uid").to_numpy(), kind="stable")
        sizes = table.column("n").to_numpy()[order].astype(np.int64)
        window = spread(sizes, capacity)
        by_window = np.argsort(window, kind="stable")
        before = np.cumsum(sizes[by_window]) - sizes[by_window]
        first = np.r_[True, window[by_window][1:] != window[by_window][:-1]]
        offset = np.empty(len(sizes), np.int64)
        offset[by_window] = before - np.maximum.accumulate(np.where(first, before, 0))
        back = np.argsort(order)
        block = table.column("block").to_numpy()
        return table.select(kept).append_column(
            "sequence_id", pa.array((np.int64(1) << 62) + (block << 20) + window[back])).append_column("offset", pa.array(offset[back]))

    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in kept) + ", sequence_id long, offset long"
    packed = (rests.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks))).drop("whole")
              .groupBy("block").applyInArrow(place, schema))
    full = pieces.filter("whole").select(*kept, F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(packed)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, block_windows: int = BLOCK_WINDOWS,
         end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every token of every document in exactly one piece of a window of at most ``capacity`` tokens.

    Returns (id, start, ids, doc_tokens, sequence_id, offset). ``end_id`` closes each document. A null or
    empty text is the end token alone; repeated rows, also with equal or null ids, are documents of their
    own; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    packed = pack_bytes(docs, tokenizer_path, capacity, block_windows, end_id, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(2)
            ends = np.r_[0, np.cumsum(pa.compute.binary_length(blobs).to_numpy(zero_copy_only=False))] // 4
            ids = pa.array(np.frombuffer(b"".join(blobs.to_pylist()), "<i4"))
            yield batch.set_column(2, "ids", pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), ids))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema)
    return packed.mapInArrow(run, fields.replace("`ids` binary", "`ids` array<int>"))
