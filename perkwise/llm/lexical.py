"""Ranked lexical search by the Best Position Algorithm over impact lists.

One pass over the texts keeps, of every document, its length and the frequencies of the items' terms. A task turns
up to ``DOCS_AT_ONCE`` of those documents into one list per term in order of falling impact and answers every item
on them: it reads all lists of an item downwards side by side, looks up each new document in all other lists, marks
the places where it was found, and knows for each list how far down everything has been seen without a gap. No
unseen document can score more than the impacts at these best positions add up to; reading stops when that is
strictly below the k-th score, so that equal scores are all seen. The best of all tasks are merged.

Nothing is shuffled but the answers, and no key gathers the documents of a frequent term.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkwise.llm.common import windows
from perkwise.operators.keyed import top_k
from perkwise.session import stage

# Items are answered in blocks of about this many; their terms are what is copied to all tasks.
ITEMS_AT_ONCE = 256
DOCS_AT_ONCE = 65_536
POSTINGS_AT_ONCE = 4_000_000
# Places of documents in lists, 4 bytes each, that one item may hold.
PLACES_AT_ONCE = 1 << 24
FIRST_STEP = 32
_UPPER = range(0x41, 0x5B)
_FOLDED = bytes(c + 32 if c in _UPPER else c if c > 0x7F or bytes([c]).isalnum() else 0x20 for c in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size: letters of A-Z in lower case, digits, all beyond ASCII."""
    for part in windows(text or "", space=lambda c: c < "\x80" and not c.isalnum()):
        yield part.encode("utf-8", "replace").translate(_FOLDED).split()


def term_counts(text: str | None) -> Counter:
    out: Counter = Counter()
    for some in terms(text):
        out.update(some)
    return out


def profiles(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents that have a term: length, and frequencies of the vocabulary's terms."""
    table = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = table.value
        for batch in batches:
            keep, lengths, sizes, found, tfs = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                n, held = 0, Counter()
                for some in terms(text):
                    n += len(some)
                    held.update(map(numbers.get, some))
                if not n:
                    continue
                held.pop(None, None)
                keep.append(i)
                lengths.append(n)
                sizes.append(len(held))
                found.extend(held)
                tfs.extend(held.values())
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(lengths, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(found, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))],
                names=["doc_id", "n", "terms", "tfs"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term adds to a document's score for each unit of its weight; whole numbers only."""
    m = 75 + (25 * n * documents) // length
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def best_positions(lists: list[tuple[np.ndarray, np.ndarray]], weights: list[int], order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, depth): the k best by score, then by ``order``, and how far down the lists were read.

    ``lists`` are (documents by falling impact, impacts) of documents 0 .. len(order) - 1; weights are above 0.
    """
    total = len(order)
    places = np.full((len(lists), total), -1, np.int32)
    for j, (docs, _) in enumerate(lists):
        places[j, docs] = np.arange(len(docs), dtype=np.int32)
    met = [np.zeros(len(docs), bool) for docs, _ in lists]
    best = [0] * len(lists)
    known = np.zeros(total, bool)
    top, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth, step = 0, FIRST_STEP
    while any(depth < len(docs) for docs, _ in lists):
        new = np.unique(np.concatenate([docs[depth:depth + step] for docs, _ in lists]))
        new = new[~known[new]]
        known[new] = True
        depth, step = depth + step, step * 2
        gained = np.zeros(len(new), np.int64)
        for j, (_, impact) in enumerate(lists):
            place = places[j, new]
            there = place >= 0
            met[j][place[there]] = True
            gained[there] += weights[j] * impact[place[there]]
        top, scores = np.concatenate([top, new]), np.concatenate([scores, gained])
        if len(top) > k:
            first = np.lexsort((order[top], -scores))[:k]
            top, scores = top[first], scores[first]
        bound = 0
        for j, (docs, impact) in enumerate(lists):
            gap = np.flatnonzero(~met[j][best[j]:])
            best[j] = best[j] + int(gap[0]) if len(gap) else len(docs)
            # Whoever is in a list that has been seen whole is no longer unseen.
            if best[j] < len(docs):
                bound += weights[j] * int(impact[max(0, best[j] - 1)])
        if len(top) == k and bound < scores.min():
            break
    first = np.lexsort((order[top], -scores))
    return top[first], scores[first], depth


def _item_tables(items: list, vocabulary: dict[bytes, int]) -> list[dict[int, int]]:
    return [{vocabulary[t]: n for t, n in held.items()} for held in items]


def answers(found: DataFrame, asked: list[dict[int, int]], k: int) -> DataFrame:
    """(item, doc_id, score): each task's best documents of each item, from staged ``profiles``."""
    facts = found.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    df = {r["term"]: r["count"] for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = {t: w for t, n in df.items() if (w := weight(facts["documents"], n)) > 0}
    plan = [[(t, weights[t] * n) for t, n in item.items() if t in weights] for item in asked]
    widest = max([len(x) for x in plan], default=1) or 1
    at_once = max(1, min(DOCS_AT_ONCE, PLACES_AT_ONCE // widest))
    shared = found.sparkSession.sparkContext.broadcast((plan, facts["documents"], facts["length"]))

    def answer(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        plan_, documents, length = shared.value
        table = pa.Table.from_batches(batches).combine_chunks()
        sizes = pa.compute.list_value_length(table.column("terms")).to_numpy()
        doc = np.repeat(np.arange(len(sizes)), sizes)
        term = pa.compute.list_flatten(table.column("terms")).to_numpy()
        impact = impacts(pa.compute.list_flatten(table.column("tfs")).to_numpy(), table.column("n").to_numpy()[doc], documents, length)
        by = np.lexsort((doc, -impact, term))
        doc, term, impact = doc[by], term[by], impact[by]
        wanted, starts = np.unique(term, return_index=True)
        lists = {int(t): (doc[a:b], impact[a:b]) for t, a, b in zip(wanted, starts, [*starts[1:], len(term)])}
        ids = table.column("doc_id")
        order = np.empty(len(ids), np.int64)
        order[pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
        out = []
        for number, item in enumerate(plan_):
            here = [(t, w) for t, w in item if t in lists]
            if here:
                top, scores, _ = best_positions([lists[t] for t, _ in here], [w for _, w in here], order, k)
                out.append((np.full(len(top), number), top, scores))
        columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0]), ids.combine_chunks().take(pa.array(columns[1])), pa.array(columns[2])], names=["item", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, postings = [], 0, 0
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                part = batch.slice(start, min(at_once - rows, batch.num_rows - start))
                start += part.num_rows
                held.append(part)
                rows += part.num_rows
                postings += pa.compute.sum(pa.compute.list_value_length(part.column(2))).as_py() or 0
                if rows >= at_once or postings >= POSTINGS_AT_ONCE:
                    yield answer(held)
                    held, rows, postings = [], 0, 0
        if held:
            yield answer(held)

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"item long, doc_id {kind}, score long")


def search(items: DataFrame, docs: DataFrame, k: int = 20, item_col: str = "item_id", id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of the highest score above 0 for each row of ``items``.

    Ties go to the smaller id, null ids last; every row of ``docs`` is a document and every row of ``items`` an item
    of its own, repeated or of null id. Null and empty texts have no term: such a document is never found, such an
    item has no rows, nor has an empty table. Other columns are ignored. Both tables may call their text ``text_col``.
    """
    spark = docs.sparkSession
    rows = stage(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.col(text_col).alias("text")), "lexical-items")
    blocks = max(1, -(-rows.count() // ITEMS_AT_ONCE))
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_col].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
    for block in range(blocks):
        asked = rows.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        held = [term_counts(r["text"]) for r in asked]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*held)))} if held else {}
        if not vocabulary:
            continue
        found = stage(profiles(docs, vocabulary, id_col, text_col), "lexical-profiles")
        if found.isEmpty():
            continue
        best = answers(found, _item_tables(held, vocabulary), k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(asked)], f"item long, item_id {item_kind}")
        ranked = top_k(best.filter("score > 0"), ["item"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k)
        out = out.unionByName(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out

