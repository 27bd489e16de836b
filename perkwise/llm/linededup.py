"""Removing lines that repeat an earlier line, by an exact set-similarity join.

Lines are sets of lower-cased words in order of rarity. Two lines with Jaccard similarity t or more share a
word in their prefixes, lie within a factor t in length, and have enough words left after the shared one.
What passes these filters and a bound from 128-bit parity maps is verified on the words themselves.

Words are 64-bit digests computed for a whole batch at once. A task sends to the shuffle only the first of
its lines with the same words, so a line copied everywhere arrives once per task; the rows travel packed,
one binary per task and target, and are searched target by target. Lines with the same set of words, by its 64-bit
digest, its parity maps and its size, are settled at once where their rarest shared word meets. Runs of letters of scripts without blanks are cut into trigrams, which count
as words. Lines so short that only an equal set is similar enough meet by one digest of the whole set. Rarity comes from a table of hashed counts of all words, of fixed size; it
only orders words, so a collision costs speed and not results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkwise.llm.common import lean
from perkwise.session import small_batches, stage, tidy

SIMILARITY = (4, 5)
MIN_WORDS = 5
BUCKETS = 1 << 22
SLICES = 64
BATCH_CHARS = 1 << 18
ROWS_AT_ONCE = 256
ROWS_PER_TARGET = 400_000
CROWDED = 200_000
# A task forgets the lines it has sent when there are so many; that costs shuffle and changes no result.
REMEMBERED = 100_000
HELD = 150_000
# A table of bits, 2 MB at any size, tells which cells a second search looks into.
CELL_BITS = 24
ALIKE = 24
ENOUGH = 3
# Tables of line numbers up to this many rows (about 20 MB) are copied to all tasks; larger ones are shuffled.
SMALL_ROWS = 1_000_000
# role: 1 looks for earlier lines, 2 may be one, 4 is the line's first entry.
_ENTRY = np.dtype([("cell", "<u8"), ("doc", "<i8"), ("whole", "<u8"), ("low", "<u8"), ("high", "<u8"), ("line", "<i4"), ("crc", "<u4"),
                   ("n", "<i4"), ("at", "<i4"), ("role", "u1")])
_COPY = np.dtype([("doc", "<i8"), ("line", "<i4"), ("crc", "<u4")])
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
# The value of a byte in a word's digest, that of the small letter for A-Z; white space has none.
_LETTER = np.where(np.isin(np.arange(256), [32, *range(9, 14)]), 0, np.frombuffer(bytes(range(256)).lower(), np.uint8) + 1.0).astype(np.uint64)
_POWERS: list[np.ndarray] = []
# Runs of Thai, Lao, Myanmar, Khmer, kana and Han, which have no blanks between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]+")
GRAM = 3


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _grams(run: re.Match) -> str:
    letters = run.group()
    return f" {' '.join(letters[i:i + GRAM] for i in range(max(1, len(letters) - GRAM + 1)))} "


def _spaced(text: str) -> str:
    """The text in lower case but for A-Z of ASCII texts, with blanks between the trigrams of runs that have none."""
    if text.isascii():
        # The values of bytes make A-Z small.
        return text
    text = text.lower()
    try:
        # Much faster than a search, and true of most texts.
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _UNSPACED.sub(_grams, text)
    return text


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(digest of each word, its line, text of each line, number of the line in its text)."""
    counts = np.array([t.count("\n") + 1 for t in texts], np.int64)
    raw = np.frombuffer("\n".join([_spaced(t) for t in texts]).encode("utf-8", "replace") + b"\n", np.uint8)
    text_of = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(text_of)) - np.repeat(np.cumsum(counts) - counts, counts)
    values = _LETTER.take(raw)
    solid = values != 0
    starts = np.flatnonzero(np.r_[solid[:1], solid[1:] > solid[:-1]])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), text_of, number
    # A polynomial over the whole batch; dividing by the power of a word's place makes it independent of the place.
    powers, inverse = _powers(len(raw))
    values *= powers
    # White space adds nothing, so a word's sum is what is added up to the next word.
    sums = np.cumsum(values, out=values)[np.r_[starts[1:] - 1, len(raw) - 1]]
    sums[1:] -= sums[:-1].copy()
    digest = _mixed(sums * inverse[starts])
    ends = np.flatnonzero(raw == 10)
    line = np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(starts, ends), prepend=0))
    return digest, line, text_of, number


def lines_of(text: str) -> list[str]:
    return text.split("\n")


@dataclass(frozen=True)
class Reader:
    """What is compared: the units of a text, and the digests of their words as ``words_of`` gives them."""

    units: Callable[[str], list[str]] = lines_of
    words: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = words_of


LINES = Reader()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier to the powers 1 to n, and its inverse (modulo 2^64) to the powers 0 to n - 1."""
    if n > 4 * BATCH_CHARS:
        return _power_table(n)
    if not _POWERS:
        _POWERS.extend(_power_table(4 * BATCH_CHARS))
    return _POWERS[0][:n], _POWERS[1][:n]


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.full(n, pow(int(_MULTIPLIER), -1, 1 << 64), np.uint64)
    inverse[0] = 1
    return np.cumprod(np.full(n, _MULTIPLIER, np.uint64)), np.cumprod(inverse)


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about BATCH_CHARS of text, at least one row each."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        first = 0
        while first < batch.num_rows:
            last, size = first + 1, lengths[first]
            while last < batch.num_rows and size + lengths[last] <= BATCH_CHARS:
                size += lengths[last]
                last += 1
            part = batch.slice(first, last - first)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            first = last


def rarity(docs: DataFrame, text_col: str = "text", reader: Reader = LINES) -> tuple[np.ndarray, int]:
    """Twice the binary logarithm of the hashed count of all words, by bucket, and the number of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for _, texts in _groups(batches, 0):
            np.add.at(seen, (reader.words(texts)[0] & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
        for i, part in enumerate(seen.reshape(SLICES, -1)):
            if part.any():
                size = next(n for n in (1, 2, 4, 8) if int(part.max()) < 1 << 8 * n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([zlib.compress(part.astype(f"<u{size}").tobytes(), 1)])], names=["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = zlib.decompress(x)
                sums[i] = sums.get(i, 0) + np.frombuffer(raw, f"<u{len(raw) * SLICES // BUCKETS}").astype(np.int64)
        for i, x in sums.items():
            # Byte 255 would be a count no table reaches.
            level = np.where(x > 0, np.floor(2 * np.log2(np.maximum(x, 1))) + 1, 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.array([level.tobytes()]), pa.array([int(x.sum())], pa.int64())],
                names=["slice", "levels", "n"])

    rows = (docs.select(text_col).mapInArrow(lean(count), "slice int, counts binary").repartition(8, "slice")
            .mapInArrow(lean(add), "slice int, levels binary, n long").collect())
    levels = np.zeros((SLICES, BUCKETS // SLICES), np.uint8)
    for r in rows:
        levels[r["slice"]] = np.frombuffer(r["levels"], np.uint8)
    return levels.reshape(-1), sum(r["n"] for r in rows)


def _overlap(total: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """The least number of shared words of two lines with so many words in all."""
    return -(-t[0] * total // (t[0] + t[1]))


def _pairs(rows: dict[str, np.ndarray], t: tuple[int, int], stop: bool, alike: int = ALIKE,
           settle: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(later, earlier, stopped, settled) of sorted entries; with ``stop`` a few convincing candidates end the search of each.

    ``settled`` are entries with an earlier line of the same words: the search of such a line ends, its candidates
    count no more. Without ``settle`` that line is a candidate like others.
    """
    total = len(rows["cell"])
    edge = np.r_[True, rows["cell"][1:] != rows["cell"][:-1]][:total]
    first = np.maximum.accumulate(np.where(edge, np.arange(total), 0)) if total else np.zeros(0, np.int64)
    later, earlier, stopped = [], [], []
    active = np.flatnonzero((rows["role"] & 1 > 0) & (first < np.arange(total)))
    n, role, low, high, whole, doc, line = (rows[x] for x in ("n", "role", "low", "high", "whole", "doc", "line"))
    left, offers = n - rows["at"], role & 2 > 0
    back, convincing, settled, ended = 1, np.zeros(total, np.int32), np.zeros(total, bool), np.zeros(total, bool)
    while len(active):
        other = active - back
        a, b = n[active], n[other]
        small, large = np.minimum(a, b), np.maximum(a, b)
        both = a + b
        need = _overlap(both, t)
        hit = (small * t[1] >= large * t[0]) & offers[other]
        hit &= np.minimum(left[active], left[other]) >= need
        # The maps are read only where sizes and places leave a chance.
        may = np.flatnonzero(hit)
        a, b, spare = active[may], other[may], (both - 2 * need)[may]
        apart = np.bitwise_count(low[a] ^ low[b]).astype(np.int64) + np.bitwise_count(high[a] ^ high[b])
        near = np.flatnonzero((apart <= spare) & ((doc[a] != doc[b]) | (line[a] != line[b])))
        a, b, spare, apart = a[near], b[near], spare[near], apart[near]
        equal = settle & (apart == 0) & (n[a] == n[b]) & (whole[a] == whole[b])
        settled[a[equal]] = True
        a, b, spare, apart = a[~equal], b[~equal], spare[~equal], apart[~equal]
        later.append(a)
        earlier.append(b)
        back += 1
        if stop:
            # Maps so much alike are no accident, whatever the length of the lines.
            convincing[a[(apart * 3 <= 2 * spare) & (apart <= alike)]] += 1
            enough = (convincing[a] >= ENOUGH) & (a - back >= first[a])
            stopped.append(enough)
            ended[a[enough]] = True
        else:
            stopped.append(np.zeros(len(a), bool))
        active = active[(active - back >= first[active]) & ~settled[active] & ~ended[active]]
    none = np.zeros(0, np.int64)
    later, earlier, stopped = np.concatenate([none, *later]), np.concatenate([none, *earlier]), np.concatenate([none > 0, *stopped])
    keep = ~settled[later] & ~ended[later]
    if ended.any():
        # Of a search that has ended early the nearest candidate is enough; where it fails the search is done to the end.
        late = np.flatnonzero(ended[later] & ~settled[later])
        apart = np.bitwise_count(low[later[late]] ^ low[earlier[late]]).astype(np.int64) + np.bitwise_count(high[later[late]] ^ high[earlier[late]])
        late = late[np.lexsort((apart, later[late]))]
        late = late[np.r_[True, later[late][1:] != later[late][:-1]][:len(late)]]
        keep[late], stopped[late] = True, True
    return later[keep], earlier[keep], stopped[keep], np.flatnonzero(settled & (role & 4 > 0))


def candidates(docs: DataFrame, levels: np.ndarray, words: int, t: tuple[int, int], stop: bool,
               id_col: str, text_col: str, probes: str | None = None, crowded: int = CROWDED, *, min_words: int = MIN_WORDS,
               alike: int = ALIKE, reader: Reader = LINES, cells: np.ndarray | None = None) -> DataFrame:
    """(doc, line, crc, other_doc, other_line, apart, stopped): lines with an earlier line that may match.

    Without another line the match is certain: a line of the same words came earlier. ``probes`` names
    a column with the only line numbers to look for; their matches all name the other line. ``cells`` is a table of
    bits of the only cells that matter, as ``probed_cells`` makes it.
    """
    targets = max(1, -(-words // (4 * ROWS_PER_TARGET))) * 4
    sent = entries(docs, levels, targets, t, id_col, text_col, probes, crowded, min_words, reader, cells)

    def searched(blobs: list[bytes]) -> pa.RecordBatch:
        rows = _unpacked(blobs)
        blobs.clear()
        # Most words of a target are in one line only.
        order = np.argsort(rows["cell"])
        same = rows["cell"][order[1:]] == rows["cell"][order[:-1]]
        order = order[np.r_[False, same] | np.r_[same, False]]
        rows = {c: x[order] for c, x in rows.items()}
        order = _by_place(rows)
        rows = {c: x[order] for c, x in rows.items()}
        later, earlier, stopped, settled = _pairs(rows, t, stop, alike, probes is None)
        a, b = ({c: rows[c][i] for c in ("doc", "line", "crc", "low", "high")} for i in (later, earlier))
        apart = np.bitwise_count(a["low"] ^ b["low"]).astype(np.int32) + np.bitwise_count(a["high"] ^ b["high"])
        sure = (rows["doc"][settled], rows["line"][settled], rows["crc"][settled], None, None, None, np.zeros(len(settled), bool))
        open_ = (a["doc"], a["line"], a["crc"], b["doc"], b["line"], apart, stopped)
        return pa.concat_batches([_found(*sure), _found(*open_)])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                # One message at a time: a batch of them is as large as their target.
                target, blob, certain = (batch.column(i)[row].as_py() for i in range(3))
                if certain:
                    rows = np.frombuffer(blob, _COPY)
                    yield _found(rows["doc"], rows["line"], rows["crc"], None, None, None, np.zeros(len(rows), bool))
                    continue
                if target != now and blobs:
                    yield searched(blobs)
                now = target
                blobs.append(blob)
        if blobs:
            yield searched(blobs)

    return sent.repartition(targets, "target").sortWithinPartitions("target").mapInArrow(
        lean(search), "doc long, line int, crc long, other_doc long, other_line int, apart int, stopped boolean")


def _by_place(rows: dict[str, np.ndarray]) -> np.ndarray:
    """The order by cell, document and line of rows that are in order of cells."""
    cell, doc, line = rows["cell"], rows["doc"], rows["line"]
    if not len(cell):
        return np.zeros(0, np.int64)
    group = np.cumsum(np.r_[False, cell[1:] != cell[:-1]]).astype(np.uint64)
    bits = [int(x).bit_length() for x in (group[-1], int(doc.max()) - int(doc.min()), line.max())]
    if sum(bits) > 64:
        return np.lexsort((line, doc, cell))
    # One number, nearly in order, is sorted much faster than three columns.
    key = group << np.uint64(bits[1]) | (doc - doc.min()).astype(np.uint64)
    return np.argsort(key << np.uint64(bits[2]) | line.astype(np.uint64), kind="stable")


def _unpacked(blobs: list[bytes]) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {c: [] for c in _ENTRY.names}
    for blob in blobs:
        size, at = len(blob) // _ENTRY.itemsize, 0
        for c in _ENTRY.names:
            parts[c].append(np.frombuffer(blob, _ENTRY[c], size, at))
            at += size * _ENTRY[c].itemsize
    return {c: np.concatenate(parts.pop(c)) for c in _ENTRY.names}


def _cell_bit(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = _mixed(cell) & np.uint64((1 << CELL_BITS) - 1)
    return (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8)


def _may_send(digest: np.ndarray, line: np.ndarray, cells: np.ndarray, t: tuple[int, int]) -> np.ndarray:
    """Which words are of lines that may have an entry in the cells: of most lines no word is in one.

    The cell of a line so short that only an equal set is similar enough is no word's; all lines that may be as short stay.
    """
    at, bit = _cell_bit(digest >> np.uint64(20))
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    hit = np.logical_or.reduceat(cells[at] & bit > 0, first)
    # No more than the number of its different words.
    least = np.bitwise_count(np.bitwise_or.reduceat(np.uint64(1) << (digest & np.uint64(63)), first)).astype(np.int64)
    return np.repeat(hit | (least * t[1] < t[0] * (least + 1)), np.diff(np.r_[first, len(line)]))


def probed_cells(docs: DataFrame, levels: np.ndarray, t: tuple[int, int], id_col: str, text_col: str, probes: str,
                 min_words: int = MIN_WORDS, reader: Reader = LINES) -> np.ndarray:
    """The bits of the cells in which the lines of ``probes`` look for others."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (CELL_BITS - 3), np.uint8)
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                rows = _unpacked([blob])
                np.bitwise_or.at(bits, *_cell_bit(rows["cell"][rows["role"] & 1 > 0]))
        for i, part in enumerate(bits.reshape(SLICES, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], names=["slice", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts[i] = parts.get(i, np.uint8(0)) | np.frombuffer(zlib.decompress(x), np.uint8)
        for i, x in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()])], names=["slice", "bits"])

    # Crowded cells are cut by their places later on, so they keep their own numbers here.
    rows, send = _sender(docs, levels, 1, t, id_col, text_col, probes, 1 << 62, min_words, reader, None)
    table = np.zeros((SLICES, (1 << (CELL_BITS - 3)) // SLICES), np.uint8)
    # Both in one worker: two functions one after the other take two workers a task, which stay and fill up with each stage.
    marked = rows.mapInArrow(lean(lambda batches: mark(send(batches))), "slice int, bits binary")
    for r in marked.repartition(8, "slice").mapInArrow(lean(join), "slice int, bits binary").collect():
        table[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return table.reshape(-1)


def entries(docs: DataFrame, levels: np.ndarray, targets: int, t: tuple[int, int], id_col: str, text_col: str, probes: str | None,
            crowded: int, min_words: int, reader: Reader, cells: np.ndarray | None) -> DataFrame:
    """(target, rows, certain): packed entries of the lines' prefixes, and lines whose words came earlier in the same task."""
    rows, send = _sender(docs, levels, targets, t, id_col, text_col, probes, crowded, min_words, reader, cells)
    return rows.mapInArrow(lean(send), "target int, rows binary, certain boolean")


def _sender(docs: DataFrame, levels: np.ndarray, targets: int, t: tuple[int, int], id_col: str, text_col: str, probes: str | None,
            crowded: int, min_words: int, reader: Reader, cells: np.ndarray | None
            ) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]]:
    """The rows that ``entries`` reads, and what makes its rows of their batches."""
    table = docs.sparkSession.sparkContext.broadcast((levels, cells))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (level_of, wanted_cells), seen, held, copies = table.value, {}, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                # Columns that lie together are put in order much faster than those of wide rows.
                columns_ = [np.concatenate([x[c] for x in held]) for c in _ENTRY.names]
                held.clear()
                # Small numbers are sorted by their digits.
                target = (_mixed(columns_[0]) % np.uint64(targets)).astype(np.min_scalar_type(targets))
                order = np.argsort(target, kind="stable")
                cuts = np.r_[0, np.cumsum(np.bincount(target, minlength=targets))].tolist()
                full = [i for i in range(targets) if cuts[i] < cuts[i + 1]]
                columns_ = [x[order] for x in columns_]
                packed = [b"".join(x[cuts[i]:cuts[i + 1]].tobytes() for x in columns_) for i in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array(packed, pa.binary()), pa.array([False] * len(full))], names=["target", "rows", "certain"])
            if copies:
                packed = np.concatenate(copies)
                copies.clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(packed["doc"][0]) % targets], pa.int32()), pa.array([packed.tobytes()]), pa.array([True])],
                    names=["target", "rows", "certain"])

        for part, texts in _groups(batches, 1):
            order = np.argsort(part.column(0).to_numpy(zero_copy_only=False), kind="stable")
            texts = [texts[i] for i in order]
            ids = part.column(0).to_numpy(zero_copy_only=False)[order].astype(np.int64)
            wanted = [set(part.column(2)[int(i)].as_py() or ()) for i in order] if probes else None
            digest, line, text_of, number = reader.words(texts)
            if not len(digest):
                continue
            if wanted_cells is not None:
                stays = _may_send(digest, line, wanted_cells, t)
                digest, line = digest[stays], line[stays]
            short = digest >> np.uint64(20)
            level = level_of[(digest & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64)
            for low in range(0, len(text_of), 1 << 13):
                mine = slice(*np.searchsorted(line, [low, low + (1 << 13)]))
                # Line, rarity and digest in one number: sorting it orders the words of every line.
                key = (line[mine] - low).astype(np.uint64) << np.uint64(51) | level[mine] << np.uint64(44) | short[mine]
                if not len(key):
                    continue
                # Lines are in order already, which a stable sort makes use of.
                by = np.argsort(key, kind="stable")
                key = key[by]
                once = np.r_[True, key[1:] != key[:-1]]
                key, full = key[once], digest[mine][by[once]]
                own = (key >> np.uint64(51)).astype(np.int64)
                word = key & np.uint64((1 << 44) - 1)
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                n = np.diff(np.r_[first, len(key)])
                whole = np.add.reduceat(_mixed(full), first)
                bit = np.uint64(1) << (word & np.uint64(63))
                is_low = word & np.uint64(64) == 0
                maps = [np.bitwise_xor.reduceat(np.where(x, bit, np.uint64(0)), first) for x in (is_low, ~is_low)]
                lines = own[first] + low
                docs_, numbers = ids[text_of[lines]], number[lines]
                fresh, double = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
                long_ = np.flatnonzero(n >= min_words)
                for i, mark, doc, number_ in zip(*(x.tolist() for x in (long_, whole[long_], docs_[long_], numbers[long_]))):
                    # One number for (document, line): a dictionary of pairs takes twice the memory.
                    place = (doc << 32) + number_
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    before = seen.get(mark)
                    if before is None or place <= before:
                        seen[mark] = place
                        fresh[i] = True
                    else:
                        double[i] = True
                role = np.full(len(lines), 3, np.uint8)
                if probes:
                    role = np.array([3 if int(x) in wanted[t] else 2 for x, t in zip(numbers, text_of[lines])], np.uint8)
                    fresh |= (role == 3) & (n >= min_words)
                if (double | fresh).any():
                    crc = np.zeros(len(lines), np.uint32)
                    split, now, sums, marked = [], -1, [], np.flatnonzero(double | fresh)
                    for t_, number_ in zip(text_of[lines[marked]].tolist(), numbers[marked].tolist()):
                        if t_ != now:
                            split, now = reader.units(texts[t_]), t_
                        sums.append(zlib.crc32(split[number_].encode("utf-8", "replace")))
                    crc[marked] = sums
                if double.any() and not probes:
                    out = np.zeros(int(double.sum()), _COPY)
                    out["doc"], out["line"], out["crc"] = docs_[double], numbers[double], crc[double]
                    copies.append(out)
                of = np.repeat(np.arange(len(lines)), n)
                at = np.arange(len(key)) - np.repeat(first, n)
                prefix = n - -(-t[0] * n // t[1]) + 1
                # Level 1 is a word that occurs once in the corpus.
                rare = (key >> np.uint64(44)) & np.uint64(127)
                use = np.flatnonzero(fresh[of] & (at < prefix[of]) & (rare > 1))
                out = np.zeros(len(use), _ENTRY)
                of = of[use]
                # Where a word more or less is too much, equal sets are all that can match.
                equal = n[of] * t[1] < t[0] * (n[of] + 1)
                out["cell"], out["doc"], out["line"], out["crc"] = np.where(equal, whole[of], word[use]), docs_[of], numbers[of], crc[of] if len(use) else 0
                out["n"], out["at"], out["low"], out["high"], out["whole"] = n[of], at[use], maps[0][of], maps[1][of], whole[of]
                out["role"] = role[of] | np.where(np.r_[True, of[1:] != of[:-1]][:len(of)], 4, 0).astype(np.uint8)
                level_here = rare[use]
                if wanted_cells is not None:
                    at_, bit_ = _cell_bit(out["cell"])
                    hit = wanted_cells[at_] & bit_ > 0
                    out, level_here = out[hit], level_here[hit]
                grid = np.ceil(2.0 ** (level_here.astype(float) / 2) / crowded).astype(np.int64)
                if (grid > 1).any():
                    held.append(_grid(out[grid > 1], grid[grid > 1]))
                    out = out[grid <= 1]
                held.append(out)
            if sum(map(len, held)) > HELD:
                yield from flush()
        yield from flush()

    columns = [id_col, text_col] + ([probes] if probes else [])
    return docs.select(*columns), send


def _grid(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows of a crowded word in cells of (row of the earlier line, column of the later line)."""
    chunk = (_mixed(rows["doc"].astype(np.uint64) * np.uint64(31) + rows["line"].astype(np.uint64)) % size.astype(np.uint64)).astype(np.int64)
    out = []
    for other in range(int(size.max())):
        for role, i, j in ((2, chunk, other), (1, other, chunk)):
            keep = (size > other) & (rows["role"] & role > 0)
            part = rows[keep].copy()
            part["role"] = part["role"] & 4 | role
            place = np.broadcast_to(i, len(rows))[keep] * 65536 + np.broadcast_to(j, len(rows))[keep] + 1
            part["cell"] ^= _mixed(place.astype(np.uint64))
            out.append(part)
    return np.concatenate(out)


def _found(doc, line, crc, other_doc, other_line, apart, stopped) -> pa.RecordBatch:
    none = np.zeros(len(doc), np.int64)
    empty = np.full(len(doc), other_doc is None)
    arrays = [pa.array(np.ascontiguousarray(doc), pa.int64()), pa.array(np.ascontiguousarray(line), pa.int32()),
              pa.array(np.ascontiguousarray(crc).astype(np.int64))]
    for x, kind in ((other_doc, pa.int64()), (other_line, pa.int32()), (apart, pa.int32())):
        arrays.append(pa.array(np.ascontiguousarray(none if x is None else x), mask=empty).cast(kind))
    return pa.RecordBatch.from_arrays(
        [*arrays, pa.array(stopped)], names=["doc", "line", "crc", "other_doc", "other_line", "apart", "stopped"])


def _small(rows: DataFrame, weights: str) -> DataFrame:
    """The staged frame, to be broadcast if its lines are few enough."""
    n = rows.agg(F.sum(F.size(weights)) + F.count("*")).first()[0] or 0
    return F.broadcast(rows) if n <= SMALL_ROWS else rows


def line_words(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, reader: Reader = LINES) -> DataFrame:
    """(doc, line, words): sorted digests of the words of the wanted (doc, line)."""
    per_doc = wanted.groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("line").alias("__lines"))
    per_doc = _small(stage(per_doc, "line-wanted"), "__lines")
    joined = docs.select(id_col, text_col).join(per_doc, F.col(id_col) == F.col("__doc")).select("__doc", text_col, "__lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _groups(batches, 1):
            ids, wanted_ = part.column(0).to_pylist(), part.column(2).to_pylist()
            rows, lines, sets = [], [], []
            for key, text, numbers in zip(ids, texts, wanted_):
                split = reader.units(text)
                numbers = [i for i in sorted(numbers) if i < len(split)]
                digest, line, _, _ = reader.words([split[i] for i in numbers]) if numbers else (np.zeros(0, np.uint64), np.zeros(0, int), 0, 0)
                cuts = np.searchsorted(line, np.arange(len(numbers) + 1))
                for i, number in enumerate(numbers):
                    rows.append(key)
                    lines.append(number)
                    sets.append(np.unique(digest[cuts[i]:cuts[i + 1]]).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(lines, pa.int32()), pa.array(sets, pa.binary())], names=["doc", "line", "words"])

    return joined.mapInArrow(lean(run), "doc long, line int, words binary")


def verified(docs: DataFrame, pairs: DataFrame, t: tuple[int, int], id_col: str, text_col: str, reader: Reader = LINES) -> DataFrame:
    """The (doc, line, crc) of the pairs whose words have the similarity."""
    wanted = pairs.select("doc", "line").unionByName(pairs.select(F.col("other_doc").alias("doc"), F.col("other_line").alias("line")))
    sets = stage(line_words(docs, wanted, id_col, text_col, reader), "line-words")
    # Ids may repeat; any row of the id will do for the earlier line, and for the later one its checksum tells.
    other = sets.select(F.col("doc").alias("other_doc"), F.col("line").alias("other_line"), F.col("words").alias("other_words"))
    joined = pairs.join(sets, ["doc", "line"]).join(other, ["other_doc", "other_line"]).select("doc", "line", "crc", "words", "other_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both * t[1] >= t[0] * (len(a) + len(b) - both))
            yield batch.select(["doc", "line", "crc"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(lean(run), "doc long, line int, crc long").distinct()


def repeated_lines(docs: DataFrame, t: tuple[int, int] = SIMILARITY, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS, alike: int = ALIKE, reader: Reader = LINES) -> DataFrame:
    """(doc, line, crc) of every line with an earlier line of Jaccard similarity ``t`` or more.

    Lines are in order of (id, number of the line, from 0). Lines of fewer than
    ``min_words`` different words are never removed; with 1 only lines without any word stay. Documents of null id or text take no part.
    """
    docs = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    levels, words = rarity(docs, text_col, reader)
    found = stage(candidates(docs, levels, words // 4, t, True, id_col, text_col, min_words=min_words, alike=alike, reader=reader), "line-candidates")
    certain = found.filter("other_doc is null").select("doc", "line", "crc").distinct()
    # In the cells of its other words a line that is settled may have been a candidate.
    open_ = found.filter("other_doc is not null").join(certain, ["doc", "line", "crc"], "left_anti")
    # Of a line's candidates the one that looks nearest first, the others only where that one fails.
    best = stage(open_.groupBy("doc", "line", "crc").agg(
        F.min(F.struct("apart", "other_doc", "other_line")).alias("x"), F.bool_or("stopped").alias("stopped"))
        .select("doc", "line", "crc", "x.other_doc", "x.other_line", "stopped"), "line-best")
    ok = stage(verified(docs, best, t, id_col, text_col, reader), "line-verified")
    failed = best.join(ok, ["doc", "line", "crc"], "left_anti")
    rest = (open_.join(failed.select("doc", "line", "crc"), ["doc", "line", "crc"], "left_semi")
            .select("doc", "line", "crc", "other_doc", "other_line").distinct()
            .join(failed.select("doc", "line", "other_doc", "other_line"), ["doc", "line", "other_doc", "other_line"], "left_anti"))
    also = stage(verified(docs, stage(rest, "line-rest"), t, id_col, text_col, reader), "line-verified")
    out = certain.unionByName(ok).unionByName(also)
    # A search that stopped at a candidate which failed goes on to the end for these lines.
    unsettled = stage(failed.filter("stopped").join(also, ["doc", "line", "crc"], "left_anti")
                      .groupBy("doc").agg(F.collect_set("line").alias("__probes")), "line-unsettled")
    if not unsettled.isEmpty():
        probed = docs.join(unsettled, docs[id_col] == unsettled["doc"], "left").drop("doc")
        cells = probed_cells(probed.filter("__probes is not null"), levels, t, id_col, text_col, "__probes", min_words, reader)
        more = candidates(probed, levels, words // 4, t, False, id_col, text_col, "__probes", min_words=min_words, reader=reader, cells=cells)
        more = stage(more.select("doc", "line", "crc", "other_doc", "other_line").distinct(), "line-candidates")
        out = out.unionByName(stage(verified(docs, more, t, id_col, text_col, reader), "line-verified"))
    return out.distinct()


def drop_repeated_lines(docs: DataFrame, t: tuple[int, int] = SIMILARITY, id_col: str = "doc_id", text_col: str = "text",
                        min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without their repeated lines, and ``n_lines`` and ``removed`` (numbers of the lines).

    A null text stays null with 0 lines; a document may end up empty; a row of null id stays as it is. Rows
    that repeat an id are told apart by their lines; with equal texts they are one document and all treated
    alike. Columns of the two new names that are there already are replaced.
    """
    docs = docs.drop("n_lines", "removed")
    with small_batches(docs.sparkSession), tidy(docs.sparkSession) as result:
        gone = (repeated_lines(docs, t, id_col, text_col, min_words).groupBy(F.col("doc").alias("__doc"))
                .agg(F.collect_list(F.shiftleft(F.col("line").cast("long"), 32) + F.col("crc")).alias("__gone")))
        gone = result(gone, "lines-gone")
    gone = _small(gone, "__gone")
    joined = docs.join(gone, docs[id_col] == gone["__doc"], "left").drop("__doc")
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            texts, counts, removed = [], [], []
            for text, gone_ in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()):
                n, out = 0 if text is None else text.count("\n") + 1, []
                if gone_ and text is not None:
                    lines = text.split("\n")
                    # One number holds the line and the checksum.
                    marks = set(gone_)
                    hit = {x >> 32 for x in marks}
                    out = [i for i in sorted(hit) if i < n and (i << 32) + zlib.crc32(lines[i].encode("utf-8", "replace")) in marks]
                    drop = set(out)
                    text = "\n".join([x for i, x in enumerate(lines) if i not in drop])
                texts.append(text)
                counts.append(n)
                removed.append(out)
            arrays = list(batch.columns[:len(names)])
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(counts, pa.int32()), pa.array(removed, pa.list_(pa.int32()))], names=[*names, "n_lines", "removed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(lean(run), f"{fields}, n_lines int, removed array<int>")
