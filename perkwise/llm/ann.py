"""Approximate nearest neighbours by inner product: NN-descent builds a graph, queries walk it greedily.

Vectors get one more component that makes their norms equal, so that the largest inner product is the nearest
vector. Graph and walk work on copies of single precision scaled to a largest norm of 1, the answers on the
originals. With r the added component and s = 1 - r, the product of two copies less 1 is x.y + ss' - s - s', in which
short vectors lose no digits beside long ones. Each round of NN-descent is a
Spark join: the sampled neighbours of a node meet, and whoever is nearer than a neighbour's farthest is
proposed to it. The first graph comes from exact neighbours within blocks of random hyperplanes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perkwise.llm.topk import usable
from perkwise.session import stage, tidy

NEIGHBOURS = 36
FOREST = 6
BLOCK = 256
SAMPLED = 18
BEAM = 192
EXPANDED = 16
SETTLED = 96
ENTRIES = 64
LONGEST = 1024
STARTS = 32
PARTS = 64


def _floats(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def _codes(column: pa.Array) -> np.ndarray:
    """Binary codes of equal length as rows (x, s, 1) of float32; those of queries are (x, 0, 0)."""
    return _rows(column.to_pylist())


def _rows(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f4").reshape(max(1, len(raw)), -1)[:len(raw)]


def _facing(codes: np.ndarray) -> np.ndarray:
    """The rows (x, s - 1, -s) by which codes are multiplied."""
    s = codes[:, -2:-1]
    return np.hstack([codes[:, :-2], s - 1, -s])


def _packed(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array([c.tobytes() for c in x.astype("<f4")], pa.binary())], names=["id", "code"])


def prepared(rows: DataFrame, id_col: str, vector_col: str, copies: int) -> tuple[DataFrame, DataFrame, int]:
    """(distinct vectors as (id, vector), members as (rep, id), width).

    Rows of null id, null or zero vectors and vectors with null or non-finite components take no part, nor
    do vectors of another width than most have (of equally frequent widths the larger). An id stands for all rows of its vector; of those the
    ``copies`` smallest ids are members, which is all that a search for one less can return.
    """
    fine = rows.filter(F.col(id_col).isNotNull() & usable(vector_col) & F.exists(vector_col, lambda x: x != 0))
    widths = fine.groupBy(F.size(vector_col).alias("width")).count().agg(F.max(F.struct("count", "width"))).first()[0]
    width = widths["width"] if widths else 0
    fine = fine.filter(F.size(vector_col) == width).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("vector"))
    # An id that is there twice keeps the smaller vector.
    fine = fine.groupBy("id").agg(F.min("vector").alias("vector"))
    # A vector of many rows is cut in parts first; its smallest ids are among the smallest of the parts.
    part = Window.partitionBy("vector", "part").orderBy("id")
    fine = (fine.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(PARTS))).withColumn("place", F.row_number().over(part))
            .filter(F.col("place") <= copies).drop("part", "place"))
    of_vector = Window.partitionBy("vector").orderBy("id")
    ranked = fine.withColumn("place", F.row_number().over(of_vector)).withColumn("rep", F.min("id").over(of_vector))
    ranked = stage(ranked.filter(F.col("place") <= copies), "ann-members")
    return ranked.filter("place = 1").select("id", "vector"), ranked.select("rep", "id"), width


def coded(points: DataFrame, width: int) -> DataFrame:
    """(id, code): the vectors with the component that makes norms equal, as ``_codes`` has them."""
    squares = F.aggregate(F.transform("vector", lambda x: x / F.col("largest")), F.lit(0.0), lambda s, x: s + x * x)
    largest = points.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0] or 1.0
    norm = largest * np.sqrt(points.withColumn("largest", F.lit(largest)).agg(F.max(squares)).first()[0] or 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _floats(batch.column(1), width) / norm
            square = np.minimum(1.0, (x * x).sum(axis=1, keepdims=True))
            yield _packed(batch.column(0), np.hstack([x, square / (1 + np.sqrt(1 - square)), np.ones((len(x), 1))]))

    return stage(points.mapInArrow(run, "id long, code binary"), "ann-codes")


def query_codes(points: DataFrame, width: int) -> DataFrame:
    """(id, code) of vectors as queries: of norm 1, with nothing in the added component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _floats(batch.column(1), width)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            yield _packed(batch.column(0), np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 2))]))

    return points.select("id", "vector").mapInArrow(run, "id long, code binary")


def _best(edges: DataFrame, key: str, count: int, *keep: str) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.col("sim").desc(), "other")
    return edges.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= count).select(key, "other", "sim", *keep)


def first_graph(codes: DataFrame, total: int, seed: int = 1) -> DataFrame:
    """(id, other, sim): neighbours within blocks of rows on the same sides of random hyperplanes."""
    planes = max(0, int(np.ceil(np.log2(max(1, total) / BLOCK))))

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _codes(batch.column(1))[:, :-2]
            for tree in range(FOREST):
                normal = np.random.default_rng(seed + tree).standard_normal((x.shape[1], planes)).astype(np.float32)
                side = (x @ normal > 0) @ (1 << np.arange(planes, dtype=np.int64)) if planes else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), tree, np.int32)), pa.array(side), batch.column(0), batch.column(1)],
                    names=["tree", "side", "id", "code"])

    rows = codes.mapInArrow(sides, "tree int, side long, id long, code binary")
    sizes = rows.groupBy("tree", "side").agg(F.ceil(F.count("*") / (2 * BLOCK)).alias("parts"))
    rows = rows.join(sizes, ["tree", "side"]).withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.col("parts")))

    def block(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["id"].to_numpy()
        x = _rows(group["code"])
        sims = x @ _facing(x).T
        np.fill_diagonal(sims, -np.inf)
        k = min(NEIGHBOURS, len(ids) - 1)
        if k < 1:
            return pd.DataFrame({"id": ids[:0], "other": ids[:0], "sim": sims[:0, 0]})
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        return pd.DataFrame({"id": np.repeat(ids, k), "other": ids[near].ravel(), "sim": np.take_along_axis(sims, near, 1).ravel()})

    found = rows.groupBy("tree", "side", "part").applyInPandas(block, "id long, other long, sim float").distinct()
    return _best(found, "id", NEIGHBOURS)


def improved(graph: DataFrame, codes: DataFrame) -> DataFrame:
    """One round: (id, other, sim, fresh), where ``fresh`` tells the edges that the round has found."""
    worst = graph.groupBy("id").agg(F.when(F.count("*") >= NEIGHBOURS, F.min("sim")).otherwise(F.lit(-3.0e38)).alias("worst"))
    # A sample by digest, of the new edges and of the others; new edges that it leaves out stay new.
    draw = Window.partitionBy("id", "fresh").orderBy(F.xxhash64("id", "other"))
    graph = graph.withColumn("drawn", F.row_number().over(draw) <= SAMPLED)
    drawn = graph.filter("drawn")
    back = Window.partitionBy("centre", "fresh").orderBy(F.xxhash64("other", "centre"))
    back = (drawn.select(F.col("other").alias("centre"), F.col("id").alias("other"), "fresh")
            .withColumn("place", F.row_number().over(back)).filter(F.col("place") <= SAMPLED).drop("place"))
    both = drawn.select(F.col("id").alias("centre"), "other", "fresh").unionByName(back)
    data = codes.join(worst, "id", "left").withColumn("worst", F.coalesce("worst", F.lit(-3.0e38)))
    met = (both.join(data, both["other"] == data["id"])
           .groupBy("centre").agg(F.collect_list(F.struct("other", "fresh", F.col("worst").cast("float").alias("worst"), "code")).alias("m")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            ids, fresh, worst_ = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            x = _codes(flat.field(3))
            facing = _facing(x)
            out = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                sims = x[a:b] @ facing[a:b].T
                own, new = ids[a:b], fresh[a:b]
                better = (sims > worst_[a:b, None]) & (new[:, None] | new[None, :]) & (own[:, None] != own[None, :])
                i, j = np.nonzero(better)
                out.append((own[i], own[j], sims[i, j]))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [ids[:0], ids[:0], worst_[:0]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float32())], names=["id", "other", "sim"])

    proposed = met.select("m").mapInArrow(meet, "id long, other long, sim float").withColumn("fresh", F.lit(True))
    merged = (graph.select("id", "other", "sim", (F.col("fresh") & ~F.col("drawn")).alias("fresh")).unionByName(proposed)
              .groupBy("id", "other").agg(F.max("sim").alias("sim"), F.bool_and("fresh").alias("fresh")))
    return _best(merged, "id", NEIGHBOURS, "fresh")


def build(codes: DataFrame) -> DataFrame:
    """(id, other, sim, fresh): the neighbour graph; stops when a round changes less than one edge in a hundred.

    Edges are replaced by nearer ones only, so that it does stop.
    """
    total = codes.count()
    graph = stage(first_graph(codes, total).withColumn("fresh", F.lit(True)), "ann-graph")
    while True:
        graph = stage(improved(graph, codes), "ann-graph")
        if graph.filter("fresh").count() <= 0.01 * total * NEIGHBOURS:
            return graph


def walk(queries: DataFrame, codes: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """(id, other, sim): for queries (id, code) the beam of nodes that a greedy walk has come to.

    It starts at the best of a few fixed entries and of the longest vectors, which are often the answer and seldom
    a neighbour, and for a query that is a node at its neighbours. Links are followed both ways. Each step looks
    at the neighbours of the nearest nodes that were not looked at before, of all queries at once. A query is one row
    with its beam; its new nodes come together there and are tested against the beam inside the row. A node that has
    left the beam cannot come back, since the beam only gets nearer. A query goes on until its nearest ``SETTLED``
    have all been looked at.
    """
    def long_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(_codes(batch.column(1))[:, -2])], names=["id", "code", "s"])

    longest = codes.mapInArrow(long_ones, "id long, code binary, s float").orderBy(F.col("s").desc(), "id").limit(LONGEST).select("id", "code")
    entries = codes.orderBy(F.xxhash64("id"), "id").limit(ENTRIES).unionByName(longest).toPandas().drop_duplicates("id")
    entry_ids = entries["id"].to_numpy()
    entry_codes = _facing(_rows(entries["code"])) if len(entries) else None

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argsort(-(_codes(batch.column(1)) @ entry_codes.T), axis=1, kind="stable")[:, :STARTS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(len(near)), near.shape[1]))), pa.array(entry_ids[near].ravel())],
                names=["id", "other"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sims = np.einsum("ij,ij->i", _codes(batch.column(2)), _facing(_codes(batch.column(3))))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims)], names=["id", "other", "sim"])

    def measured(pairs: DataFrame) -> DataFrame:
        """(id, found): one row per query with what its new nodes are worth."""
        node = codes.select(F.col("id").alias("other"), F.col("code").alias("node_code"))
        rows = pairs.join(node, "other").join(queries, "id").select("id", "other", "code", "node_code")
        sims = rows.mapInArrow(measure, "id long, other long, sim float")
        return sims.groupBy("id").agg(F.collect_list(F.struct("other", "sim")).alias("found"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, sims, seen, found in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                ids = np.array([*(ids or ()), *(x["other"] for x in found or ())], np.int64)
                sims = np.array([*(sims or ()), *(x["sim"] for x in found or ())], np.float32)
                seen = np.r_[np.array(seen or (), bool), np.zeros(len(found or ()), bool)]
                order = np.lexsort((ids, -sims))[:max(BEAM, k)]
                ids, sims, seen = ids[order], sims[order], seen[order]
                look = np.flatnonzero(~seen)[:EXPANDED] if not seen[:max(SETTLED, k)].all() else np.zeros(0, np.int64)
                seen[look] = True
                out.append((ids.tolist(), sims.tolist(), seen.tolist(), ids[look].tolist()))
            kinds = (pa.int64(), pa.float32(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([x[i] for x in out], pa.list_(kind)) for i, kind in enumerate(kinds))], names=["id", "ids", "sims", "seen", "look"])

    def merged(state: DataFrame) -> DataFrame:
        return state.select("id", "ids", "sims", "seen", "found").mapInArrow(
            merge, "id long, ids array<long>, sims array<float>, seen array<boolean>, look array<long>")

    if not len(entries):
        return queries.select("id", F.col("id").alias("other"), F.lit(None).cast("float").alias("sim")).limit(0)
    start = queries.select("id", "code").mapInArrow(enter, "id long, other long")
    own = graph.join(queries.select("id"), "id", "left_semi").select("id", "other")
    start = start.unionByName(own).unionByName(queries.select("id", F.col("id").alias("other")))
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (("ids", "array<long>"), ("sims", "array<float>"), ("seen", "array<boolean>"))]
    state = stage(merged(measured(start.distinct()).select("id", *empty, "found")), "ann-walk")
    links = graph.select(F.col("id").alias("node"), F.col("other").alias("next"), "sim")
    back = _best(links.select(F.col("next").alias("id"), F.col("node").alias("other"), "sim"), "id", NEIGHBOURS)
    links = links.select("node", "next").unionByName(back.select(F.col("id").alias("node"), F.col("other").alias("next")))
    links = stage(links.groupBy("node").agg(F.collect_set("next").alias("nexts")), "ann-links")
    while not state.filter(F.size("look") > 0).isEmpty():
        with tidy(state.sparkSession) as result:
            nodes = state.select("id", F.explode("look").alias("node")).join(links, "node")
            nexts = nodes.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("nexts"))).alias("nexts"))
            fresh = state.join(nexts, "id").select("id", F.explode(F.array_except("nexts", "ids")).alias("other"))
            state = result(merged(state.join(measured(fresh), "id", "left")), "ann-walk")
    return state.select("id", F.inline(F.arrays_zip(F.col("ids").alias("other"), F.col("sims").alias("sim"))))


def search(rows: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of the rows that ``is_query``, a condition on ``id``, selects.

    ``score`` is the inner product of the original vectors in double precision; ties go to the smaller id.
    """
    with tidy(rows.sparkSession) as result:
        return result(_search(rows, is_query, k, id_col, vector_col), "ann-found")


def _search(rows: DataFrame, is_query, k: int, id_col: str, vector_col: str) -> DataFrame:
    points, members, width = prepared(rows, id_col, vector_col, k + 1)
    codes = coded(points, width)
    graph = build(codes)
    # A query walks under the id of its vector; equal queries share one walk.
    everyone = stage(rows.filter(F.col(id_col).isNotNull() & usable(vector_col) & F.exists(vector_col, lambda x: x != 0)
                                 & (F.size(vector_col) == width))
                     .select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("vector"))
                     .filter(is_query).groupBy("id").agg(F.min("vector").alias("vector")), "ann-queries")
    asked = everyone.join(points.select(F.col("id").alias("rep"), F.col("vector").alias("v")), F.col("vector") == F.col("v")).select("id", "rep", "vector")
    asked = stage(asked, "ann-asked")
    walkers = stage(query_codes(points.join(asked.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), width), "ann-walkers")
    found = walk(walkers, codes, graph, k).select(F.col("id").alias("rep"), F.col("other").alias("near"))
    near = points.select(F.col("id").alias("near"), F.col("vector").alias("w"))
    pairs = asked.join(found, "rep").join(near, "near")
    score = F.aggregate(F.zip_with("vector", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select(F.col("id").alias("query_id"), "near", score.alias("score"))
    scored = scored.join(members.select(F.col("rep").alias("near"), F.col("id").alias("vec_id")), "near").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
