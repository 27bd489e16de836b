from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from perkwise.operators import nearest as nn, retrieval as rt


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    # Every offer exists twice, so ties must go to the smaller id.
    base = rng.normal(size=(60, 8)).astype("float32")
    offers = [(f"o{i:03d}", base[i % 60].tolist()) for i in range(120)]
    queries = [(f"q{i}", rng.normal(size=8).astype("float32").tolist()) for i in range(50)]
    kind = "string, embedding array<float>"
    return spark.createDataFrame(queries, f"query_id {kind}"), spark.createDataFrame(offers, f"id {kind}"), queries, offers


def slow(queries, offers, k, cosine=True):
    out = []
    for q, v in queries:
        v = np.asarray(v, dtype=float)
        scored = []
        for o, w in offers:
            w = np.asarray(w, dtype=float)
            s = v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) if cosine else v @ w
            scored.append((-round(float(s), 9), o))
        out += [(q, o, rank + 1) for rank, (_, o) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def rows(found):
    return sorted((r["query_id"], r["id"], r["rank"]) for r in found.collect())


@pytest.mark.parametrize("metric", ["cosine", "dot", "distance"])
def test_both_ways_equal_brute_force(vectors, metric):
    q, o, queries, offers = vectors
    want = slow(queries, offers, 6, metric != "dot")
    assert rows(nn.nearest(q, o, 6, metric)) == want
    assert rows(nn.nearest(q, o, 6, metric, broadcast_numbers=80, block_rows=17)) == want


def test_k_beyond_the_catalogue(vectors):
    q, o, queries, offers = vectors
    few = o.filter("id < 'o003'")
    assert nn.nearest(q, few, 10).count() == 150
    assert nn.nearest(q, few, 10, broadcast_numbers=1, block_rows=2).count() == 150
    assert nn.nearest(q, o.filter("false"), 10).isEmpty()


def test_approximate_is_exact_when_all_cells_are_probed(vectors):
    q, o, queries, offers = vectors
    assert rows(nn.nearest_approximate(q, o, 4, cells=5, probes=5, block_rows=11)) == slow(queries, offers, 4)
    some = nn.nearest_approximate(q, o, 4, cells=5, probes=2)
    found = nn.recall(some, nn.nearest(q, o, 4)).first()
    assert found["n_exact"] == 200 and 0.5 < found["recall"] <= 1.0


def test_approximate_widens_the_search_until_k_are_found(vectors):
    q, o, queries, offers = vectors
    for k, cells in ((20, 12), (len(offers) + 5, 6)):
        got = rows(nn.nearest_approximate(q, o, k, cells=cells, probes=1, block_rows=11))
        per_query = Counter(r[0] for r in got)
        assert len(per_query) == len({r["query_id"] for r in q.collect()}) and set(per_query.values()) == {min(k, len(offers))}
    assert got == slow(queries, offers, k)


def offers_frame(spark, thresholds):
    entries = [(f"o{i}", f"T{i}", f"D{i}", "food", t, [1.0, 0.01 * i]) for i, t in enumerate(thresholds)]
    return spark.createDataFrame(entries, "id string, title string, description string, category string, min_propensity_threshold double, embedding array<float>")


def queries_frame(spark, *propensities):
    entries = [(f"q{i}", p, "food", [1.0, 0.0]) for i, p in enumerate(propensities)]
    return spark.createDataFrame(entries, "query_id string, propensity double, expected_category string, embedding array<float>")


def test_thresholds_apply_after_the_overfetch(spark):
    offers = offers_frame(spark, [0.9] * 19 + [None, 0.0])
    got = rt.retrieve(queries_frame(spark, 0.5, 1.0), offers)
    picked = {}
    for r in got.collect():
        picked.setdefault(r["query_id"], []).append((r["position"], r["offer_id"]))
    # The nearest twenty end at o19; o20 would be eligible but is not among them.
    assert sorted(picked["q0"]) == [(1, "o19")]
    assert sorted(picked["q1"]) == [(i + 1, f"o{i}") for i in range(5)]


def test_all_offers_when_none_is_eligible(spark):
    offers = offers_frame(spark, [0.9, 0.4, 0.9, 0.9, 0.9, 0.0])
    got = rt.retrieve_or_all(queries_frame(spark, 0.5, 0.1), offers)
    picked = {}
    for r in got.collect():
        picked.setdefault(r["query_id"], []).append((r["position"], r["offer_id"], r["score"]))
    assert picked["q0"] == [(1, "o1", 0.5)]
    assert [p[1] for p in sorted(picked["q1"])] == ["o0", "o1", "o2", "o3", "o4"]
    assert sorted(picked["q1"])[4][2] == pytest.approx(0.2)


def test_fallback_summary_and_precision(spark):
    offers = offers_frame(spark, [0.9, 0.8])
    queries = queries_frame(spark, 0.85, 0.1)
    got = rt.retrieve(queries, offers)
    best = {r["query_id"]: r["offer_id"] for r in rt.with_fallback(queries, got).collect()}
    assert best == {"q0": "o1", "q1": "fallback"}
    answers = {r["query_id"]: (r["answer"], r["filtered_offers"]) for r in rt.answer_summary(queries, got).collect()}
    assert answers == {"q0": ("Retrieved 1 offers for context.", ["D1"]), "q1": ("Retrieved 0 offers for context.", [])}
    precision = {r["query_id"]: r["precision"] for r in rt.precision_at_k(queries, got).collect()}
    assert precision == {"q0": 1.0, "q1": 0.0}


def test_reembed_needs_a_known_id(spark):
    stored = spark.createDataFrame([("a", "A", [1.0])], "id string, title string, embedding array<float>")
    catalogue = spark.createDataFrame([("a", "A2")], "id string, title string")
    with pytest.raises(rt.UnknownOffer):
        rt.reembed(stored, catalogue, spark.createDataFrame([("z",)], "id string"), lambda x: x)

    def make():
        return lambda texts: [[float(len(t))] for t in texts]

    out = rt.reembed(stored, catalogue, spark.createDataFrame([("a",)], "id string"), lambda x: rt.embed_with(x, make, "title")).first()
    assert (out["title"], out["embedding"]) == ("A2", [2.0])


def test_hashed_vectors_are_unit_and_repeatable(spark):
    frame = spark.createDataFrame([(1, "Double points today"), (2, "double points, today!"), (3, None)], "id int, text string")
    got = {r["id"]: r["embedding"] for r in rt.embed_hashed(frame).collect()}
    assert len(got[1]) == 384 and got[1] == got[2] and sum(x * x for x in got[1]) == pytest.approx(1.0, abs=1e-5)
    assert not any(got[3])


@pytest.mark.parametrize("p50, precision, want", [((1.0, 2.0), (0.5, 0.5), ("a", "a")), ((2.0, 2.0), (0.5, 0.6), ("b", "b"))])
def test_winner_ties(spark, p50, precision, want):
    frame = spark.createDataFrame([("a", 0, p50[0], precision[0]), ("b", 1, p50[1], precision[1])],
        "retriever string, place int, latency_p50_ms double, precision_at_k double")
    assert tuple(rt.winners(frame).first()) == want


def test_best_rows_match_a_full_sort_with_ties_and_nan():
    rng = np.random.default_rng(5)
    queries, rows = rng.integers(-2, 3, (40, 3)).astype(float), rng.integers(-2, 3, (60, 3)).astype(float)
    rows[7] = np.nan
    ids = np.array([f"{i:03}" for i in range(60)], dtype=object)
    for k in (1, 5, 60, 80):
        found = nn._best(np.arange(40), queries, ids, rows, k)
        expected = []
        for q in queries:
            scores = q @ rows.T
            order = sorted(range(60), key=lambda i: (np.isnan(scores[i]), -scores[i] if scores[i] == scores[i] else 0, i))
            expected += [ids[i] for i in order[: min(k, 60)]]
        assert found["id"].tolist() == expected


def test_rows_without_a_vector_take_no_part(spark):
    schema = "embedding array<float>"
    queries = spark.createDataFrame([("q", [1.0, 0.0]), ("none", None)], f"query_id string, {schema}")
    catalogue = spark.createDataFrame([("a", None), ("b", [0.0, 1.0]), ("c", [2.0, 0.0])], f"id string, {schema}")
    found = nn.nearest(queries, catalogue, 3).orderBy("rank").collect()
    assert [(r["query_id"], r["id"]) for r in found] == [("q", "c"), ("q", "b")]


def test_tiles_give_the_rows_of_a_whole_matrix():
    rng = np.random.default_rng(6)
    queries, rows = rng.integers(-2, 3, (40, 3)).astype(float), rng.integers(-2, 3, (300, 3)).astype(float)
    rows[[0, 1, 2, 150]] = np.nan
    ids = np.array([f"{i:03}" for i in range(300)], dtype=object)
    for k in (1, 7, 60, 299, 300):
        whole = nn._best(np.arange(40), queries, ids, rows, k, width=300)
        for width in (1, 16, 299):
            assert whole.equals(nn._best(np.arange(40), queries, ids, rows, k, width=width))
    ascending = np.arange(300.0)[:, None]
    assert nn._best(["q"], np.ones((1, 1)), ids, ascending, 3, width=8)["id"].tolist() == ["299", "298", "297"]


def test_memory_of_a_search_does_not_grow_with_the_catalogue():
    import tracemalloc

    rng = np.random.default_rng(7)
    ids, peaks = np.arange(60_000).astype(str).astype(object), []
    queries = pd.DataFrame({"query_id": ["q"] * 2000, "embedding": list(rng.random((2000, 4)))})
    for n in (15_000, 60_000):
        rows = rng.random((n, 4))
        tracemalloc.start()
        for part in nn._slices(queries):
            nn._best(part["query_id"], nn._matrix(part["embedding"], False), ids[:n], rows, 5)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert max(peaks) < 150e6 and peaks[1] < 1.2 * peaks[0]


def test_a_grid_has_few_lines_unless_blocks_are_full():
    assert [nn._lines(n, 150, 64) for n in (0, 500, 2000, 100_000, 600_000, 6_000_000)] == [1, 4, 14, 16, 16, 120]
    assert nn._lines(600_000, nn.BLOCK_ROWS, 64) == 12 and nn._lines(100_000, nn.BLOCK_ROWS, 384) == 5
