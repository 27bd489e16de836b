"""Exact top-k search by inner product of integers, term at a time.

Queries come in blocks and candidates in groups of bounded size; a cell is one block against one group. In a
cell each dimension is a posting list of weights, scattered into dense score arrays of the queries that have
it; the best k of a cell are cut out by partition selection, and the cells of a query are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 4096
CANDIDATE_GROUP = 65_536
# Groups are no smaller than this to give every task one.
LEAST_GROUP = 1024
ROWS_AT_ONCE = 64
LONGS = np.iinfo(np.int64)


def usable(vector: str) -> Column:
    """Vectors that are there and hold only finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def quantized(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, weights) with floor(scale * x); rows of null id or unusable vector are left out.

    Rows that repeat an id count once, with the smallest of their vectors. A weight beyond 64 bits is the
    largest or smallest number of 64 bits.
    """
    fine = rows.filter(F.col(id_col).isNotNull() & usable(vector_col))
    weights = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return fine.select(F.col(id_col).cast("long").alias("id"), weights.alias("weights")).groupBy("id").agg(F.min("weights").alias("weights"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of equal width; a shorter vector has zeros in the dimensions that it lacks."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


def _beyond(part: np.ndarray, postings: np.ndarray, scores: np.ndarray) -> None:
    """Put right the scores whose sum may leave 64 bits on the way: exact sums, cut to the range of 64 bits."""
    if part.size and postings.size and float(abs(part.astype(float)).max()) * float(abs(postings.astype(float)).max()) * len(postings) >= 2.0**62:
        for i, j in np.argwhere(abs(part.astype(float)) @ abs(postings.astype(float)) >= 2.0**62):
            exact = sum(int(a) * int(b) for a, b in zip(part[i], postings[:, j]))
            scores[i, j] = min(max(exact, LONGS.min), LONGS.max)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, in order, ties by id; ``ids`` ascend."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > cut)
        places = np.concatenate([above, np.flatnonzero(scores == cut)[: k - len(above)]])
    else:
        places = np.arange(len(scores))
    # Complements descend as negatives do, and the smallest number of 64 bits has one.
    return places[np.lexsort((ids[places], ~scores[places]))]


def search(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from frames (id, weights): the k best candidates but the query itself.

    A score beyond 64 bits counts as the largest or smallest number of 64 bits, and ties go to the smaller id. The
    number of groups is that of the tasks at once, as long as groups stay between two bounds; results do not depend on it.
    """
    n_queries, n_rows = queries.count(), candidates.count()
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    tasks = candidates.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-n_rows // CANDIDATE_GROUP), min(-(-tasks // blocks), n_rows // LEAST_GROUP))
    width = candidates.agg(F.max(F.size("weights"))).first()[0] or 0
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("part", upto(groups))
    right = candidates.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int")).withColumn("block", upto(blocks))

    def cell(q: pa.Table, c: pa.Table) -> pa.Table:
        qs, rows = _matrix(q.column("weights"), width), _matrix(c.column("weights"), width)
        q_ids, ids = q.column("id").to_numpy(), c.column("id").to_numpy()
        order = np.argsort(ids)
        ids, postings = ids[order], np.ascontiguousarray(rows[order].T)
        out = []
        for start in range(0, len(qs), ROWS_AT_ONCE):
            part = qs[start:start + ROWS_AT_ONCE]
            scores = np.zeros((len(part), len(ids)), np.int64)
            for term in range(width):
                has = np.flatnonzero(part[:, term])
                scores[has] += part[has, term, None] * postings[term]
            _beyond(part, postings, scores)
            for i, own in enumerate(q_ids[start:start + ROWS_AT_ONCE]):
                others = np.flatnonzero(ids != own)
                places = others[best_of(scores[i, others], ids[others], k)]
                out.append((np.full(len(places), own), ids[places], scores[i, places]))
        columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, columns))))

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(
        cell, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
