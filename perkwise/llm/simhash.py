"""Near-duplicates by SimHash, linked exactly through vantage-point trees.

Two fingerprints at distance 3 or less are at distance 1 or less in one of their halves, so each half has
a tree. A level splits all its shards by the distance to one vantage point at the median radius; the points
are rows of a Hadamard matrix, mutually as far apart as can be, so the tree is known without building it. A
fingerprint lives in one shard and also visits every later shard that the triangle inequality does not rule
out. Shards are searched exhaustively and give a spanning forest of their links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkwise.llm.common import give_back, lean, windows
from perkwise.llm.components import stars
from perkwise.session import stage

WORDS = 3
DISTANCE = 3
SEED = 42
SHARD = 400
CROWDED = 20_000
_ASCII_SPACE = frozenset(" \t\n\v\f\r").__contains__


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of the shingles of a whole text; zero without any word."""
    counts, total, tail = np.zeros(64, np.int64), 0, []
    for part in windows(text, space=_ASCII_SPACE):
        # bytes.lower() and bytes.split() know ASCII only, as wanted here.
        own = tail + part.encode("utf-8", "replace").lower().split()
        if len(own) >= words:
            joined = b" ".join(own)
            size = np.fromiter(map(len, own), np.int64, len(own)) + 1
            ends = np.cumsum(size)
            starts = (ends - size)[: len(own) - words + 1].tolist()
            digest = xxhash.xxh64_intdigest
            found = [digest(joined[s:e], seed) for s, e in zip(starts, (ends - 1)[words - 1:].tolist())]
            bits = np.unpackbits(np.array(found, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
            total += len(found)
            own = own[len(own) - words + 1:]
        tail = own
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(tail), seed) if tail else 0
    return sum(1 << i for i in np.flatnonzero(counts * 2 > total).tolist())


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, fp) of every row; a null text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t, words) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(marks, np.uint64).view(np.int64))],
                names=[id_col, "text_key", "fp"])

    rows = docs.select(id_col, F.xxhash64(text_col).alias("text_key"), text_col)
    return rows.mapInArrow(lean(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, text_key long, fp long")


def vantage_points(levels: int) -> np.ndarray:
    """Rows 1 to ``levels`` of the Hadamard matrix of order 32, as bits."""
    return np.array([sum((bin(i & row).count("1") & 1) << i for i in range(32)) for row in range(1, levels + 1)], np.uint32)


def half(fps: np.ndarray, tree: int) -> np.ndarray:
    return (fps >> np.uint64(32 * tree)).astype(np.uint32)


def visits(halves: np.ndarray, points: np.ndarray, radii: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, lives there): the shard of each row and the later ones that may hold a neighbour."""
    row, shard, home = np.arange(len(halves)), np.zeros(len(halves), np.int64), np.zeros(len(halves), np.int64)
    for point, radius in zip(points, radii):
        away = np.bitwise_count(halves ^ point).astype(np.int64)
        home = home * 2 + (away > radius)
        inner, outer = away[row] - reach <= radius, away[row] + reach > radius
        row, shard = np.concatenate([row[inner], row[outer]]), np.concatenate([shard[inner] * 2, shard[outer] * 2 + 1])
        later = shard >= home[row]
        row, shard = row[later], shard[later]
    return row, shard, shard == home[row]


def forest(residents: np.ndarray, others: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between residents and others (or residents), as (vertex, root)."""
    values = np.unique(np.concatenate([residents, others]))
    labels = np.arange(len(values))
    own = np.searchsorted(values, residents)
    step = max(1, 4_000_000 // max(1, len(residents)))
    for start in range(0, len(others), step):
        part = others[start:start + step]
        a, b = np.nonzero(np.bitwise_count(residents[:, None] ^ part[None, :]) <= distance)
        a, b = own[a], np.searchsorted(values, part)[b]
        while True:
            low = np.minimum(labels[a], labels[b])
            if (labels[a] == low).all() and (labels[b] == low).all():
                break
            # Hang the roots, so that what was linked before stays linked.
            np.minimum.at(labels, labels[a], low)
            np.minimum.at(labels, labels[b], low)
            while (labels != labels[labels]).any():
                labels = labels[labels]
    hung = np.flatnonzero(labels != np.arange(len(values)))
    return values[hung], values[labels[hung]]


def links(marks: DataFrame, distance: int = DISTANCE, shard: int = SHARD, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fp`` at the distance or nearer."""
    reach, spark = distance // 2, marks.sparkSession
    total = marks.count()
    levels = min(31, max(0, int(np.ceil(np.log2(max(1, total) / shard)))))
    points = vantage_points(levels)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, levels, 33), np.int64)
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for tree in range(2):
                for i, point in enumerate(points):
                    seen[tree, i] += np.bincount(np.bitwise_count(half(fps, tree) ^ point), minlength=33)
        tree, level, away = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x.astype(np.int64)) for x in (tree, level, away, seen[tree, level, away])], names=["tree", "level", "away", "n"])

    radii = np.zeros((2, levels), np.int64)
    if levels:
        table = np.zeros((2, levels, 33), np.int64)
        counted = marks.select("fp").mapInArrow(lean(distances), "tree long, level long, away long, n long")
        for r in counted.groupBy("tree", "level", "away").agg(F.sum("n").alias("n")).collect():
            table[r.tree, r.level, r.away] = r.n
        radii = (np.cumsum(table, axis=2) * 2 >= table.sum(axis=2, keepdims=True)).argmax(axis=2)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            for tree in range(2):
                row, place, lives = visits(half(fps, tree), points, radii[tree], reach)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), tree, np.int32)), pa.array(place), pa.array(fps[row].view(np.int64)), pa.array(lives)],
                    names=["tree", "place", "fp", "lives"])

    routed = marks.select("fp").mapInArrow(lean(route), "tree int, place long, fp long, lives boolean")
    # A crowded shard becomes a grid of cells, residents by rows and all its fingerprints by columns.
    sizes = (routed.groupBy("tree", "place").count().filter(F.col("count") > crowded)
             .select("tree", "place", F.ceil(F.col("count") / (crowded / 2)).alias("cells")))
    sizes = stage(sizes, "crowded-shards")
    own = F.pmod(F.xxhash64("fp"), F.col("cells"))
    every = F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)
    as_resident = F.transform(every, lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(True).alias("resident"), F.lit(False).alias("other")))
    as_other = F.transform(every, lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(False).alias("resident"), F.lit(True).alias("other")))
    zero = F.lit(0).cast("long")
    alone = F.array(F.struct(zero.alias("i"), zero.alias("j"), F.col("lives").alias("resident"), F.lit(True).alias("other")))
    if sizes.isEmpty():
        cells = routed.select("*", F.explode(alone).alias("cell"))
    else:
        cells = (routed.join(sizes, ["tree", "place"], "left").select(
            "*", F.explode(F.when(F.col("cells").isNull(), alone).when(F.col("lives"), F.concat(as_resident, as_other)).otherwise(as_other)).alias("cell")))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        fps = group["fp"].to_numpy().view(np.uint64)
        a, b = forest(fps[group["resident"].to_numpy()], fps[group["other"].to_numpy()], distance)
        if len(fps) > SHARD * 10:
            give_back()
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return (cells.select("tree", "place", "cell.*", "fp").groupBy("tree", "place", "i", "j")
            .applyInPandas(search, "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, fp, root, component_id): each row's fingerprint and the group it is linked to.

    ``component_id`` is the smallest id of the group, null only where all its ids are null. A null text or
    one without words has fingerprint zero and is linked like any other; repeated rows are one vertex;
    other columns are ignored; an empty table gives no rows.
    """
    rows = stage(fingerprints(docs, words, id_col, text_col), "fingerprints")
    marks = stage(rows.groupBy("fp").agg(F.min(id_col).alias("first")), "distinct-fingerprints")
    hung = stars(links(marks, distance))
    member = hung.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    member = member.unionByName(member.select(F.col("root").alias("fp"), "root").distinct())
    named = member.join(marks, "fp")
    component = named.groupBy("root").agg(F.min("first").alias("component_id"))
    places = marks.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    places = places.join(component, "root", "left").select(
        "fp", "root", F.coalesce("component_id", "first").alias("component_id"))
    return rows.join(places, "fp").select(id_col, "text_key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, the one of the smallest id.

    Of a group's rows of null id one stays as well, the one of the smallest text key.
    """
    found = near_duplicates(docs, words, distance, id_col, text_col)
    best = (found.groupBy("root", F.col(id_col).isNull().alias("nameless"))
            .agg(F.min(F.struct(F.col(id_col).alias("id"), "text_key")).alias("x")).select("x.*").distinct())
    named = docs.withColumn("__text_key", F.xxhash64(text_col))
    hit = named[id_col].eqNullSafe(best["id"]) & (named["__text_key"] == best["text_key"])
    return named.join(best, hit, "left_semi").dropDuplicates([id_col, "__text_key"]).drop("__text_key")
