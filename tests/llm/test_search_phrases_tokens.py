"""Ranked search, phrases and token counts against brute force, with the odd rows that tables hold."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from checks.compare import connect, differences
from perkwise.llm import automata, collocations, lexical, queries, tokencounts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def scores_of_all(items, docs, k):
    """Rows of (item position, rank, id, score), by looking at every document for every item."""
    held = [(i, Counter(TERM.findall(folded(t)))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for place, text in items:
        asked, found = Counter(TERM.findall(folded(text))), []
        for i, c in held:
            m = 75 + (25 * sum(c.values()) * n) // length
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if score:
                found.append((score, i))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(place, rank, i, score) for rank, (score, i) in enumerate(found[:k], 1)]
    return out


def collection(seed, size=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Über", "naïve", "数据", "x1"]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(64)], k=rng.randint(1, 40)))) for i in range(size)]
    docs += [(1000 + i, docs[5][1]) for i in range(30)] + [(7, "w1 w2 ÜBER"), (None, "w3 w40"), (2000, None), (2001, ""), (2002, "?! ..\n")]
    docs += [(3000, " ".join(f"long{i}" for i in range(20000)) + " w3 w40")]
    return docs, [(0, "w50 w51 w1 W1 über"), (1, "w3,w40;x1"), (2, None), (2, "数据 nowhere"), (None, "w0"), (3, "!")]


@pytest.mark.parametrize("at_once, step", [(65_536, 32), (37, 1), (128, 4)])
def test_search_is_that_of_all_documents(spark, monkeypatch, at_once, step):
    monkeypatch.setattr(lexical, "DOCS_AT_ONCE", at_once)
    monkeypatch.setattr(lexical, "FIRST_STEP", step)
    docs, items = collection(1)
    got = lexical.search(spark.createDataFrame([(*r, "a", 1) for r in items], "item_id long, text string, doc_id string, rank int"),
                         spark.createDataFrame([(*r, 2, "b") for r in docs], "doc_id long, text string, score int, item_id string"), 7).collect()
    want = scores_of_all(items, docs, 7)
    assert sorted(map(str, got)) == sorted(map(str, [type(got[0])(item_id=i, rank=r, doc_id=d, score=s) for i, r, d, s in want]))


def test_items_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS_AT_ONCE", 2)
    docs, items = collection(2, 60)
    got = lexical.search(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"), 5)
    assert sorted((r.rank, r.score) for r in got.collect()) == sorted((r, s) for _, r, _, s in scores_of_all(items, docs, 5))


def test_reading_stops_early_and_bound_is_strict():
    rng = np.random.default_rng(3)
    total, lists = 5000, []
    for _ in range(3):
        docs = rng.permutation(total)[:4000]
        impact = np.sort(rng.pareto(1.5, 4000) * 1000).astype(np.int64)[::-1]
        lists.append((docs, impact))
    exact = np.zeros(total, np.int64)
    for (docs, impact), w in zip(lists, (5, 3, 2)):
        exact[docs] += w * impact
    top, scores, depth = lexical.best_positions(lists, [5, 3, 2], np.arange(total), 5)
    assert top.tolist() == np.lexsort((np.arange(total), -exact))[:5].tolist() and depth < 4000
    # All documents score the same: a bound equal to the k-th score must not end the search.
    same = [(np.arange(99, -1, -1), np.full(100, 7, np.int64))]
    assert lexical.best_positions(same, [1], np.arange(100), 3)[0].tolist() == [0, 1, 2]


@pytest.mark.parametrize("items, docs", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, None)]), ([(1, "b")], [(1, "a")])])
def test_search_without_anything_to_find(spark, items, docs):
    got = lexical.search(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def counted_phrases(rows, least, most, inside=50):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            f.update((lang, tuple(words[i:i + m])) for m in (1, 2, 3) for i in range(len(words) - m + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in found.items():
        if any(x[0] == lang and len(x[1]) > len(words) and inside * a <= 100 * b and any(x[1][i:i + len(words)] == words for i in range(2)) for x, b in found.items()):
            continue
        cuts = [((10**6 * a * a) // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], total[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    return [(r[0], rank, *r[1:]) for _, group in itertools.groupby(out, key=lambda r: r[0]) for rank, r in enumerate(list(group)[:most], 1)]


@pytest.mark.parametrize("shard, range_chars", [(1 << 21, 1 << 23), (50, 200), (400, 1000)])
def test_phrases_are_those_of_brute_force(spark, monkeypatch, shard, range_chars):
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    monkeypatch.setattr(collocations, "RANGE_CHARS", range_chars)
    rng = random.Random(4)
    words = ["New", "York", "city", "the", "of", "Über", "数据", "a\x00b", "x\xa0y"]
    rows = [(rng.choice(["en", "de", None, ""]), "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for w in rng.choices(words, range(9, 0, -1), k=rng.randint(0, 30)))) for _ in range(150)]
    rows += [("en", "new york city " * 40), ("en", "new york city " * 40), ("en", None), ("en", ""), (None, " . , "), ("fr", "z " * 5000), ("one", "x")]
    got = collocations.collocations(spark.createDataFrame([(*r, 1, "p") for r in rows], "lang string, text string, rank int, phrase string"), 25, 3)
    assert sorted(map(tuple, got.collect())) == sorted(counted_phrases(rows, 3, 25))


def test_longer_phrases_take_in_shorter_ones(spark):
    rows = [("en", "alpha beta gamma. " * 12 + "alpha beta. " * 11 + "beta gamma. " * 13)]
    got = {r.phrase for r in collocations.collocations(spark.createDataFrame(rows, "lang string, text string")).collect()}
    # 12 of 23 is half and more, 12 of 25 is not.
    assert got == {"alpha beta gamma", "beta gamma"}


def test_phrases_of_nothing(spark):
    for rows in ([], [(None, None)], [("en", "a b c")]):
        assert collocations.collocations(spark.createDataFrame(rows, "lang string, text string")).count() == 0


def random_rows(seed, size, words):
    rng = np.random.default_rng(seed)
    grams = rng.integers(0, words, (size, 3)).astype(np.int32)
    length = rng.integers(1, 4, size)
    grams[length < 3, 2] = automata.NONE
    grams[length < 2, 1] = automata.NONE
    return automata.in_order(grams, rng.integers(1, 5, size))


@pytest.mark.parametrize("size, words", [(0, 5), (1, 1), (300, 4), (2000, 50), (500, 1 << 22)])
def test_automata_keep_rows(size, words):
    grams, weights = random_rows(5, size, words)
    back, sums = automata.in_order(*automata.rows(automata.build(grams, weights)))
    assert back.tolist() == grams.tolist() and sums.tolist() == weights.tolist()


def test_equal_states_are_shared():
    grams = np.array([[a, b, c] for a in range(20) for b in range(20) for c in range(3)], np.int32)
    assert len(automata.build(grams, np.ones(len(grams), np.int64))) < 1200


def test_union_sums_and_composition_looks_up():
    parts, want = [], Counter()
    for seed in range(4):
        alphabet = pa.array(sorted(f"{'é' if i % 3 else 'w'}{i * (seed + 1)}" for i in range(6)))
        grams, weights = random_rows(seed, 80, 6)
        parts.append(automata.restricted(alphabet, grams, weights))
        for gram, weight in zip(grams.tolist(), weights.tolist()):
            want[tuple(alphabet[i].as_py() for i in gram if i >= 0)] += weight
    words, grams, weights = automata.united(pa.array([w.to_pylist() for w, _ in parts], pa.list_(pa.string())), [a for _, a in parts])
    assert words.to_pylist() == sorted(words.to_pylist(), key=str.encode)
    assert {tuple(words[i].as_py() for i in gram if i >= 0): w for gram, w in zip(grams.tolist(), weights.tolist())} == want
    asked = automata.in_order(np.array([grams[3], [len(words), 0, -1]], np.int32))
    found, sums = automata.composed(asked, (grams, weights))
    assert found.tolist() == asked[0].tolist() and sums.tolist() == [weights[3], 0]


@pytest.fixture(scope="module")
def piece_model():
    pytest.importorskip("public_tokenizers")
    return queries.tokenizer_path("piece_bpe_32k.model")


ODD_TEXTS = [
    None, "", " ", "   ", "a", " a", "a ", "a  b   ", "\n", "a\n\nb", "\r\n\tx", "▁", "a▁b ▁ c▁", " ▁ ", "<s>x</s> <unk> <0x0A>", "ﬁ é é ①", "数据 处理数据",
    "日本語のテキスト", "👩‍👩‍👧 ok 👍🏽", "a​b\x00c\x01d\x7f", "x" * 5000, "=" * 700, "don't stop... (it's, well; ok?)", "　全角　", "Ωμέγα русский العربية ไทย",
]


def test_token_counts_are_those_of_the_library(spark, piece_model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    rng = random.Random(6)
    letters = " ▁\n\r\tabcdeéßж数。.,'-<>&01́\x00"
    texts = ODD_TEXTS + ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(400)] + ["the cat"] * 50
    rows = [(i % 300 if i != 7 else None, t, "n", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pre string, row int")
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or ""))) for i, t, *_ in rows)
    # All pre-tokens in the copied table, and none.
    for known in (tokencounts.KNOWN, 0):
        got = tokencounts.count_tokens(docs, piece_model, 20, known=known).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 20) for r in got)
    assert tokencounts.count_tokens(docs.limit(0), piece_model).count() == 0


def test_token_counts_across_windows(piece_model, monkeypatch):
    import sentencepiece

    library, model = sentencepiece.SentencePieceProcessor(model_file=piece_model), tokencounts.Model(piece_model)
    whole = tokencounts.windows
    for size in (1, 3, 10):
        monkeypatch.setattr(tokencounts, "windows", lambda text, space, size=size: whole(text, size, space))
        for text in [t for t in ODD_TEXTS if t] + ["   lead  and   trail    ", "one two  three   four"]:
            found = Counter(x for some in model.pre_tokens(text) for x in some)
            assert sum(n * length for n, length in zip(found.values(), model.lengths(list(found)))) == len(library.encode(text)), (size, text)


def test_most_frequent_pre_tokens_fit(spark, piece_model):
    counts = spark.createDataFrame([(f"w{i}", 1 << (i % 6), 1) for i in range(60)] + [("x" * 100, 1 << 30, 3)], "pre string, n long, pieces long")
    for most in (0, 9, 10, 25, 60, 1000):
        found = tokencounts.frequent(counts, most)
        assert len(found) == min(most // 10 * 10, 60) and "x" * 100 not in found


@pytest.mark.parametrize("name", ["op11_best_position", "op12_collocations"])
def test_queries_against_sql(spark, sf_dir, name):
    assert differences(queries.QUERIES[name](spark, sf_dir).toPandas(), connect(sf_dir).execute(queries.SQL[name]).df()) is None


def test_token_count_query(spark, sf_dir, piece_model):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    want = {r.doc_id: len(library.encode(r.text or "")) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in queries.QUERIES["op13_token_counts"](spark, sf_dir).collect()} == want


def test_shards_travel_compressed():
    shard = collocations.Shard()
    shard.add([" ".join(f"collocation{i:05d}" for i in range(20_000)).encode()])
    alphabet, ids = shard.sorted()
    digest = collocations.word_digests("en", alphabet.to_pylist())
    sent = list(collocations._messages("en", alphabet, digest, collocations.single_words(ids, digest), 3))
    table = pa.Table.from_batches(sent)
    assert len(sent) == 3 and table.nbytes < 100_000
    words, grams, weights = automata.united(*collocations._opened(table))
    assert words.to_pylist() == [f"collocation{i:05d}" for i in range(20_000)] and weights.tolist() == [1] * 20_000 and len(grams) == 20_000
