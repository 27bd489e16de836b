"""Exact and approximate nearest-neighbour joins of many queries with a catalogue of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from perkwise.operators.keyed import top_k

# A catalogue up to this many numbers (64 MB as doubles) is broadcast; a larger one is joined by blocks.
BROADCAST_NUMBERS = 8_000_000
# Rows of queries and of catalogue that meet in one block task.
BLOCK_ROWS = 50_000
# Grid lines up to which small blocks are kept: every line sends the other side once more.
GRID_LINES = 16
# Queries and catalogue rows whose scores are in memory at once.
SLICE_ROWS, TILE_ROWS = 512, 4096
# Multiplications of a task, where queries come in fewer parts; catalogues below so many numbers are not worth a shuffle.
TASK_PRODUCTS, SMALL_CATALOGUE = 2**33, 2**18
# Similarities are compared to nine digits, so equal vectors tie whatever the order of additions.
DIGITS = 9

_NEIGHBOURS = "query_id string, id string, score double, rank int"


def _matrix(vectors: pd.Series, cosine: bool) -> np.ndarray:
    if not len(vectors):
        return np.zeros((0, 0))
    values = np.empty((len(vectors), len(vectors.iloc[0])))
    for i, v in enumerate(vectors):
        row = np.asarray(v, dtype=np.float64)
        if row.shape != values.shape[1:]:
            raise ValueError(f"vectors of {row.shape[0]} and {values.shape[1]} numbers")
        values[i] = row
    if cosine:
        norms = np.linalg.norm(values, axis=1, keepdims=True)
        values /= np.where(norms == 0.0, 1.0, norms)
    return values


def _comparable(scores: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(scores), -np.inf, scores)


def _first_best(queries: np.ndarray, catalogue: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and row numbers of the k best rows of each query, best first."""
    scores = np.round(queries @ catalogue.T, DIGITS)
    value = _comparable(scores)
    edge = np.partition(value, -k, axis=1)[:, -k][:, None]
    above, level = value > edge, value == edge
    room = k - above.sum(axis=1, keepdims=True)
    chosen = np.nonzero(above | (level & (np.cumsum(level, axis=1) <= room)))[1].reshape(len(scores), k)
    order = np.argsort(-np.take_along_axis(value, chosen, axis=1), axis=1, kind="stable")
    picked = np.take_along_axis(chosen, order, axis=1)
    return np.take_along_axis(scores, picked, axis=1), picked


def _best(query_ids, queries: np.ndarray, ids: np.ndarray, catalogue: np.ndarray, k: int, width: int = TILE_ROWS) -> pd.DataFrame:
    """The k best catalogue rows of each query; ``ids`` ascend, so of equal scores the first rows are taken.

    The catalogue is read in tiles. After the first one only rows above a query's k-th score so far are looked at,
    so a tile costs a product and a comparison.
    """
    k = min(k, len(catalogue))
    width = max(width, k)
    best, picked = _first_best(queries, catalogue[:width], k)
    for start in range(width, len(catalogue), width):
        raw = queries @ catalogue[start : start + width].T
        edge = _comparable(best[:, -1])
        at, row = np.nonzero(raw >= edge[:, None])
        score = np.round(raw[at, row], DIGITS)
        higher = score > edge[at]
        at, row, score = at[higher], row[higher] + start, score[higher]
        if not len(at):
            continue
        touched = np.unique(at)
        of = np.concatenate([np.repeat(touched, k), at])
        scores = np.concatenate([best[touched].ravel(), score])
        rows = np.concatenate([picked[touched].ravel(), row])
        order = np.lexsort((rows, -_comparable(scores), of))
        place = np.searchsorted(of[order], touched)[:, None] + np.arange(k)
        best[touched], picked[touched] = scores[order][place], rows[order][place]
    return pd.DataFrame({
        "query_id": np.repeat(np.asarray(query_ids, dtype=object), k),
        "id": ids[picked].ravel(),
        "score": best.ravel(),
        "rank": np.tile(np.arange(1, k + 1, dtype=np.int32), len(queries)),
    })


def _slices(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Cut a batch so that the scores of a tile are about two million numbers."""
    for start in range(0, len(frame), SLICE_ROWS):
        yield frame.iloc[start : start + SLICE_ROWS]


def _fits(catalogue: DataFrame, limit: int) -> bool:
    dims = catalogue.select(F.size("embedding").alias("d")).head(1)
    if not dims:
        return True
    rows = max(1, limit // max(dims[0]["d"], 1))
    return catalogue.select("id").limit(rows + 1).count() <= rows


def _broadcast_join(queries: DataFrame, catalogue: DataFrame, k: int, cosine: bool) -> DataFrame:
    local = catalogue.select("id", "embedding").toPandas().sort_values("id", kind="stable")
    ids, matrix = local["id"].to_numpy(dtype=object), _matrix(local["embedding"], cosine)
    shared = queries.sparkSession.sparkContext.broadcast((ids, matrix))
    queries = queries.select("query_id", "embedding")
    if matrix.size >= SMALL_CATALOGUE:
        # A few files of queries would be a few long tasks.
        parts = -(-queries.count() * matrix.size // TASK_PRODUCTS)
        queries = queries.repartition(parts) if parts > 1 else queries

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        if not len(ids):
            return
        for batch in batches:
            for part in _slices(batch):
                yield _best(part["query_id"], _matrix(part["embedding"], cosine), ids, matrix, k)

    return queries.mapInPandas(search, _NEIGHBOURS)


def _search_group(k: int, cosine: bool):
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({
                "query_id": np.empty(0, object), "id": np.empty(0, object),
                "score": np.empty(0), "rank": np.empty(0, np.int32),
            })
        right = right.sort_values("id", kind="stable")
        ids, matrix = right["id"].to_numpy(dtype=object), _matrix(right["embedding"], cosine)
        found = pd.concat([
            _best(part["query_id"], _matrix(part["embedding"], cosine), ids, matrix, k)
            for part in _slices(left)
        ])
        # Text gathered from several Arrow batches is chunked, which Spark does not take back.
        return found.astype({"query_id": object, "id": object})

    return search


def _merge(partial: DataFrame, k: int) -> DataFrame:
    """The best k per query of the answers of several blocks."""
    return top_k(partial.drop("rank"), ["query_id"], [F.desc("score"), F.asc("id")], k)


def _lines(rows: int, block_rows: int, dims: int) -> int:
    """Blocks of one side. Each is sent to every block of the other side, so blocks below ``BLOCK_ROWS`` grow with the
    table once there are ``GRID_LINES`` of them; wide vectors take smaller blocks up to there."""
    wanted = min(block_rows, max(1, BROADCAST_NUMBERS // max(dims, 1)))
    return max(1, min(-(-rows // wanted), max(GRID_LINES, -(-rows // BLOCK_ROWS))))


def _block_join(
    queries: DataFrame, catalogue: DataFrame, k: int, cosine: bool, block_rows: int
) -> DataFrame:
    """Exact join of two large sides: each pair of blocks meets in one bounded task, which keeps only
    its k best per query."""
    dims = (catalogue.select(F.size("embedding").alias("d")).head(1) or [{"d": 1}])[0]["d"]
    parts = _lines(catalogue.count(), block_rows, dims)
    strips = _lines(queries.count(), block_rows, dims)
    left = queries.select(
        "query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(strips)).alias("strip"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
    )
    right = catalogue.select(
        "id", "embedding", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(strips - 1).cast("bigint"))).alias("strip"),
    )
    return left.groupBy("part", "strip").cogroup(right.groupBy("part", "strip")).applyInPandas(
        _search_group(k, cosine), _NEIGHBOURS
    )


def nearest(
    queries: DataFrame, catalogue: DataFrame, k: int = 5, metric: str = "cosine",
    broadcast_numbers: int = BROADCAST_NUMBERS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact top-k of a catalogue (id, embedding) for every query (query_id, embedding).

    Result: query_id, id, score, rank. ``metric`` is cosine or dot (both: higher is better), or
    distance (1 - cosine, lower is better). Ties go to the smaller id. Rows without a vector take no part.
    """
    if metric not in ("cosine", "dot", "distance"):
        raise ValueError(f"unknown metric {metric!r}")
    cosine = metric != "dot"
    queries, catalogue = (side.filter("embedding is not null") for side in (queries, catalogue))
    if _fits(catalogue, broadcast_numbers):
        # A query meets the whole catalogue in one task, so its answer needs no shuffle.
        ranked = _broadcast_join(queries, catalogue, k, cosine)
    else:
        ranked = _merge(_block_join(queries, catalogue, k, cosine, block_rows), k)
    if metric == "distance":
        ranked = ranked.withColumn("score", F.round(F.lit(1.0) - F.col("score"), DIGITS))
    return ranked


def _cells(
    rows: DataFrame, model, id_column: str, keep: int, held: np.ndarray | None = None, least: int = 0
) -> DataFrame:
    """The ``keep`` nearest cell centres of every vector, and further ones until those hold ``least`` rows.

    ``held`` has the rows of every cell.
    """
    centres = np.stack(model.clusterCenters())
    held = np.zeros(len(centres), np.int64) if held is None else held

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = (centres**2).sum(axis=1) / 2.0
        for batch in batches:
            values = _matrix(batch["embedding"], True)
            if not len(values):
                continue
            closest = np.argsort(half - values @ centres.T, axis=1, kind="stable")
            before = np.cumsum(held[closest], axis=1) - held[closest]
            wanted = (np.arange(closest.shape[1]) < keep) | (before < least)
            out = batch.iloc[np.repeat(np.arange(len(batch)), wanted.sum(axis=1))].copy()
            out["cell"] = closest[wanted]
            yield out

    return rows.select(id_column, "embedding").mapInPandas(
        assign, f"{id_column} string, embedding array<float>, cell int"
    )


def nearest_approximate(
    queries: DataFrame, catalogue: DataFrame, k: int = 5, cells: int = 16, probes: int = 4,
    metric: str = "cosine", seed: int = 42, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Approximate top-k: the catalogue is cut into cells around trained centres and a query looks
    only into its ``probes`` nearest cells, and into further ones until those hold k rows. So every
    query gets k rows, or all where the catalogue has fewer.

    Cells and the queries routed to them are split into blocks of ``block_rows``, so a crowded cell
    becomes many bounded tasks.
    """
    cosine = metric != "dot"
    queries, catalogue = (side.filter("embedding is not null") for side in (queries, catalogue))
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="features").fit(
        catalogue.select(array_to_vector("embedding").alias("features"))
    )
    stored = _cells(catalogue, model, "id", 1)
    held = np.zeros(len(model.clusterCenters()), np.int64)
    for row in stored.groupBy("cell").count().collect():
        held[row["cell"]] = row["count"]
    routed = _cells(queries, model, "query_id", probes, held, k)

    def pieces(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).alias(name))

    # One row per cell: how many pieces each side of it is cut into.
    plan = F.broadcast(pieces(stored, "parts").join(pieces(routed, "strips"), "cell"))
    left = routed.join(plan, "cell").select(
        "query_id", "embedding", "cell", F.pmod(F.xxhash64("query_id"), F.col("strips")).alias("strip"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"),
    )
    right = stored.join(plan, "cell").select(
        "id", "embedding", "cell", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("strips") - 1)).alias("strip"),
    )
    keys = ["cell", "part", "strip"]
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        _search_group(k, cosine), _NEIGHBOURS
    )
    return _merge(partial, k)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the approximate join found."""
    found = approximate.select("query_id", "id").withColumn("_found", F.lit(1))
    return exact.join(found, ["query_id", "id"], "left").agg(
        F.count(F.lit(1)).alias("n_exact"), F.count("_found").alias("n_found"),
        (F.count("_found") / F.count(F.lit(1))).alias("recall"),
    )
