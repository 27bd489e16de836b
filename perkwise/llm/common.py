"""Helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDS = 5
WORD = r"[^\x20\x09-\x0D]+"


def held_out(doc_id: str) -> Column:
    """True for the fold that no model may learn from; a null id is in no known fold and so held out too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def row_key(*columns: str) -> Column:
    """A 64-bit digest of some columns; nulls have a place of their own, so ("a", null) and (null, "a") differ."""
    parts = [part for c in columns for part in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(*parts)


def stable_hash(text: str) -> int:
    """A digest that is the same in every process."""
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def give_back() -> None:
    """Return memory that a task has freed to the system: a Python worker waits for its next task with all it ever had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


# What a worker process keeps from task to task, such as a tokenizer and the words it knows, by the name of the kind of tasks.
KEPT: dict[str, dict] = {}


def let_go(keeps: str | None = None) -> None:
    """Drop what tasks of other kinds have kept."""
    others = [name for name in KEPT if name != keeps]
    for name in others:
        KEPT.pop(name)
    if others:
        give_back()


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
         keeps: str | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches, giving memory back when the task ends; what is kept for tasks but those of ``keeps`` goes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(keeps)
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def windows(text: str, size: int = 1 << 20, space: Callable[[str], bool] = str.isspace) -> Iterator[str]:
    """A text in pieces that end before white space, so that no word is cut; short texts come whole."""
    start, n = 0, len(text)
    while n - start > size:
        end = start + size
        while end < n and not space(text[end]):
            end += 1
        yield text[start:end]
        start = end
    if start < n or not n:
        yield text[start:]
