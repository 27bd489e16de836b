"""The corpus operators on small frames: brute force, round trips, and the odd rows that tables hold."""

import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from checks.compare import connect, differences
from perkwise.llm import ann, common, extraction, langid, linededup, mixing, packing, queries, secrets, shinglejoin, simhash, topk, toxicity
from perkwise.llm.components import stars

SCHEMA = "doc_id long, text string, lang string, source string, extra string"
EN = ["the cat sat on the mat and then it left the house for good", "a dog ran over the hill to see the red barn again today"]
DE = ["der hund lief schnell über die straße und kam nicht mehr zurück", "die katze saß auf dem dach und sah den vögeln lange nach"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows."""
    rows = [(i, (EN if i % 3 else DE)[i % 2] + f" number{i}", "en" if i % 3 else "de", "s1" if i % 2 else "s2") for i in range(40)]
    rows += [(100, None, None, None), (101, "", "en", "s1"), (None, "null id text with a few words", "en", "s2"), (102, "12 34 !!", None, "s1")]
    rows += [(103, " ".join(f"w{i}" for i in range(30000)), "en", "s3"), (3, EN[1] + " number3", "en", "s1"), (104, "x" * 50000, None, None)]
    return frame(spark, rows)


def text_bits(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    n = max(1, len(words) - 2)
    marks = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in marks) > n)


def test_fingerprints_of_odd_rows(odd):
    for r in simhash.fingerprints(odd).join(odd, ["doc_id"]).filter("doc_id <> 3").collect():
        assert r.fp % (1 << 64) == text_bits(r.text)


def test_fingerprint_across_windows(monkeypatch):
    text = " ".join(f"Wort{i}Ä" for i in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "windows", lambda t, space: (t[i:i + 60] for i in range(0, 0)) if not t else _cut(t))
    assert simhash.fingerprint(text) == whole == text_bits(text)


def _cut(text):
    words = text.split(" ")
    return [" ".join(words[i:i + 7]) for i in range(0, len(words), 7)]


@pytest.mark.parametrize("crowded", [20_000, 40])
def test_links_are_those_of_brute_force(spark, crowded):
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = fps[:120] ^ (np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64))
    chain = np.array([fps[0] ^ np.uint64((1 << i) - 1) for i in range(1, 40)], np.uint64)
    fps = np.unique(np.concatenate([fps, near, chain]))
    marks = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r.a: r.b for r in stars(simhash.links(marks, shard=16, crowded=crowded)).collect()}
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= 3):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    signed = [int(x) for x in fps.view(np.int64)]
    groups, got = {}, {}
    for i, x in enumerate(signed):
        groups.setdefault(root(i), set()).add(x)
        got.setdefault(found.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_one_of_each_group_stays(spark, odd):
    docs = frame(spark, [(5, EN[0], "en", "s"), (2, EN[0], "en", "s"), (2, EN[0], "en", "s"), (9, DE[0], "de", "s"), (None, EN[0], "en", "s"), (7, None, None, None), (8, "", "en", "s")])
    assert sorted((r.doc_id or -1) for r in simhash.keep_one(docs).collect()) == [-1, 2, 7, 9]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    assert simhash.keep_one(odd).columns == odd.columns


def test_copies_without_an_id_stay_once(spark):
    near = " ".join(f"w{i}" for i in range(3000))
    rows = [(None, EN[0], "en", "s")] * 3 + [(None, near, "en", "s"), (None, near + " end", "en", "s"), (4, DE[0], "de", "s"), (None, DE[1], "de", "s")]
    assert bin(simhash.fingerprint(near) ^ simhash.fingerprint(near + " end")).count("1") <= 3
    got = [(r.doc_id, r.text[:20]) for r in simhash.keep_one(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(None, EN[0][:20]), (None, near[:20]), (4, DE[0][:20]), (None, DE[1][:20])], key=str)
    vectors = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(900)], "vec_id long, embedding array<double>")
    _, members, _ = ann.prepared(vectors, "vec_id", "embedding", 5)
    assert sorted(tuple(r) for r in members.collect()) == [(0, i) for i in range(5)]


def test_near_duplicates_are_those_of_brute_force(spark):
    import corpus_pipeline

    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(30):
        base = list(rng.choice(vocabulary, rng.integers(30, 200)))
        for j in range(5):
            own = list(base)
            for _ in range(rng.integers(0, 2 + len(base) // 40)):
                own[rng.integers(len(own))] = str(rng.choice(vocabulary))
            rows.append((i + 30 * j, " ".join(own), "en", "s"))
    rows += [(1000, "two words", "en", "s"), (1001, "Two\nwords", "en", "s"), (1002, None, None, "s"), (1003, " ", None, "s"), (1002, None, None, "s")]

    def marks(text):
        words = (text or "").lower().split()
        return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))}

    sets = [(i, marks(t)) for i, t, _, _ in sorted({r[:2] + ("", "") for r in rows}, key=lambda r: r[0])]
    want = [i for a, (i, x) in enumerate(sets) if not any(5 * len(x & y) >= 4 * len(x | y) for _, y in sets[:a])]
    docs = frame(spark, [*rows, (None, rows[0][1], "en", "s"), *[(None, "null id and words of its own", "en", "s")] * 3]).repartition(5)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in got.collect()) == [-1, *want]
    assert 30 < len(want) < 150 and shinglejoin.keep_first(docs.limit(0)).count() == 0


def test_mix_meets_targets_and_limits(spark, odd):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 300)), "en", f"s{i % 4}") for i in range(800)]
    got = mixing.mix(frame(spark, rows)).toPandas()
    assert len(got) == 800 and (got.taken <= 3 * got["size"]).all()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.01 * g.target.iloc[0]
    assert got.groupby("source").target.first().sum() == pytest.approx(got["size"].sum())
    again = mixing.mix(frame(spark, rows[::-1])).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    odd_mix = mixing.mix(odd).toPandas()
    assert len(odd_mix) == odd.count() and odd_mix[odd_mix["size"] == 0].taken.eq(0).all()
    assert mixing.mix(odd.limit(0)).count() == 0
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and out.count() == odd_mix.copies[odd_mix["size"] > 0].sum()


def test_targets_fill_up_to_the_limit(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), (None, 500), ("c", 40)], "source string, size long")
    got = {r.source: (r.source_size, r.target) for r in mixing.source_targets(sizes).collect()}
    # Weights 5, 2, 1, 5 in the order a, b, c, null; a and c stop at three times their size.
    want, left, weights = {}, 1550.0, {"a": 5, "b": 2, "c": 1, None: 5}
    limits = {"a": 30, "b": 3000, "c": 120, None: 1500}
    while True:
        over = [s for s in weights if left * weights[s] / sum(weights.values()) > limits[s]]
        if not over:
            break
        for s in over:
            want[s] = limits[s]
        left -= sum(limits[s] for s in over)
        weights = {s: w for s, w in weights.items() if s not in over}
    want |= {s: left * w / sum(weights.values()) for s, w in weights.items()}
    assert {s: t for s, (_, t) in got.items()} == pytest.approx(want)


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    docs = odd.filter("doc_id is not null and doc_id <> 3")
    pieces = packing.pack(docs, path).toPandas()
    for r in docs.collect():
        own = pieces[pieces.doc_id == r.doc_id].sort_values("start")
        ids = [int(x) for p in own.ids for x in p]
        assert ids == tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        assert (own.doc_tokens == len(ids)).all()
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        sizes = g.ids.map(len)
        assert (g.offset == sizes.cumsum() - sizes).all() and sizes.sum() <= 2048
    assert packing.pack(odd.limit(0), path).count() == 0
    whole = [sorted(map(tuple, f.collect()), key=str) for f in (queries.packed_digests(docs, path), queries.piece_digests(packing.pack_bytes(docs, path)))]
    assert whole[0] == whole[1] and whole[0]
    digests = queries.piece_digests(packing.pack_bytes(docs.filter("doc_id = 5"), path)).collect()
    ids = tokenizer.encode(docs.filter("doc_id = 5").first().text, add_special_tokens=False).ids + [1]
    assert all(d.ids_crc32 == zlib.crc32(np.array(ids[d.start:d.start + d.length], "<u4").tobytes()) for d in digests)


def test_words_are_encoded_as_in_the_text():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    whole, own = Tokenizer.from_file(path), packing.WordTokenizer(path)
    texts = ["It's a Test, isn't it? 12.5%", "ÄÖÜß Ñandú İstanbul ΑΣ", "a<|endoftext|>b <|ENDOFTEXT|>", "x\x1cy z w", "ab̈c 漢字 ﬁ", "", "  ", "don't!! ...ok.; e.g."]
    assert [x.tolist() for x in own.ids(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_differencing_is_near_equal():
    sizes = np.array([9, 8, 7, 6, 5, 4, 3, 2, 1, 1])
    sums = np.bincount(packing.difference(sizes, 3), weights=sizes)
    assert sums.max() - sums.min() <= 2
    assert np.bincount(packing.spread(np.array([60, 60, 60]), 100), weights=[60, 60, 60]).max() <= 100


def test_languages(spark, odd):
    rows = [(i, (EN, DE)[i % 2][i // 2 % 2] + f" {i}", ("en", "de")[i % 2], "s") for i in range(60)]
    docs = frame(spark, rows)
    model = langid.fit(docs)
    got = langid.identify(docs, model).collect()
    assert all(r.lang == r.lang_pred and not r.rejected and 0 <= r.lang_score <= 1 for r in got)
    odd_rows = {r.doc_id: r for r in langid.identify(odd.withColumn("lang_pred", F.lit("old")), model).collect()}
    for i in (100, 101, 102):
        assert (odd_rows[i].lang_pred, odd_rows[i].lang_score, odd_rows[i].rejected) == ("und", 0.0, True)
    assert odd_rows[1].extra == "x"
    empty = langid.fit(odd.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}


def peak(function):
    """Result and largest number of bytes held meanwhile beyond those held before."""
    tracemalloc.start()
    try:
        return function(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_languages_are_learned_from_one_array_of_vectors():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, (500, langid.DIMENSIONS)).astype(np.float32)
    places = [np.flatnonzero(c).astype(np.int32) for c in counts]
    sample = pa.table({"lang": ["en"] * 500, "places": places, "values": [c[p] for c, p in zip(counts, places)]})
    weights = rng.random(langid.DIMENSIONS) + 1
    unit = langid.vectors(counts, weights)
    unit = unit[np.lexsort(np.round(unit[:, :64], 9).T)]
    # Clusters as they were computed before, from copies of the rows of each.
    own = langid.spherical_clusters(unit, 3, rounds=0)
    near = np.argmax(unit @ own.T, axis=1)
    own = langid._unit(np.stack([unit[near == i].sum(axis=0) for i in range(3)]))
    got, held = peak(lambda: langid.spherical_clusters(unit, 3, rounds=1))
    assert np.array_equal(got, own) and held < unit.nbytes / 4
    rows, held = peak(lambda: langid.sample_rows(sample, weights))
    assert np.array_equal(rows, unit) and held < 2 * unit.nbytes


def test_a_worker_drops_what_other_tasks_have_kept():
    path = queries.tokenizer_path()
    kept = packing.worker_tokenizer(path)
    list(common.lean(iter, "tokens")([]))
    assert packing.worker_tokenizer(path) is kept
    list(common.lean(iter)([]))
    assert not common.KEPT and packing.worker_tokenizer(path) is not kept


def test_cells_to_look_into_take_one_worker_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(i, EN[i % 2], [0]) for i in range(6)], "doc_id long, text string, probes array<int>")
    kind, plans = type(docs), []
    plain = kind.mapInArrow

    def noted(self, *args):
        plans.append(self._jdf.queryExecution().optimizedPlan().toString())
        return plain(self, *args)

    monkeypatch.setattr(kind, "mapInArrow", noted)
    bits = linededup.probed_cells(docs, np.full(linededup.BUCKETS, 3, np.uint8), (4, 5), "doc_id", "text", "probes", 1)
    assert bits.any() and len(plans) == 2
    # Between one Python function and the next is an exchange.
    assert all("MapInArrow" not in plan or "Repartition" in plan.partition("MapInArrow")[0] for plan in plans)


def repeated(rows):
    lines = [(i, n, {w for w in re.split(r"[ \t\r\v\f]+", x.lower()) if w}) for i, t in sorted(rows) for n, x in enumerate(t.split("\n"))]
    out = set()
    for a, (i, n, x) in enumerate(lines):
        for _, _, y in lines[:a]:
            if len(x) >= 5 and len(y) >= 5 and 5 * len(x & y) >= 4 * len(x | y):
                out.add((i, n))
                break
    return out


def noisy_lines():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(vocabulary, rng.integers(3, 25))) for _ in range(60)]
    rows = []
    for i in range(80):
        text = []
        for _ in range(4):
            line = list(base[rng.integers(60)])
            for _ in range(rng.integers(0, 4)):
                line[rng.integers(len(line))] = str(rng.choice(vocabulary))
            text.append(" ".join(line).upper() if rng.random() < 0.2 else " ".join(line))
        rows.append((i, "\n".join(text)))
    return rows


@pytest.mark.parametrize("enough,crowded", [(3, 200_000), (1, 200_000), (3, 4)])
def test_repeated_lines_are_those_of_brute_force(spark, monkeypatch, enough, crowded):
    monkeypatch.setattr(linededup, "ENOUGH", enough)
    monkeypatch.setattr(linededup.candidates, "__defaults__", (None, crowded))
    rows = noisy_lines()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(r.doc, r.line) for r in linededup.repeated_lines(docs).collect()}
    assert got == repeated(rows)


def test_search_for_given_lines_only(spark):
    rows = noisy_lines()
    want = repeated(rows)
    docs = spark.createDataFrame([(i, t, [n for d, n in want if d == i and n % 2]) for i, t in rows], "doc_id long, text string, p array<int>")
    levels, words = linededup.rarity(docs)
    pairs = linededup.candidates(docs, levels, words, (4, 5), False, "doc_id", "text", "p")
    got = {(r.doc, r.line) for r in linededup.verified(docs, pairs.select("doc", "line", "crc", "other_doc", "other_line").distinct(), (4, 5), "doc_id", "text").collect()}
    assert got == {(d, n) for d, n in want if n % 2}


def test_lines_of_odd_rows(spark, odd):
    got = {r.doc_id: r for r in linededup.drop_repeated_lines(odd.withColumn("removed", F.lit(1))).collect()}
    assert got[100].text is None and got[100].n_lines == 0 and got[101].text == ""
    assert got[None].text == "null id text with a few words" and linededup.drop_repeated_lines(odd.limit(0)).count() == 0
    docs = frame(spark, [(1, EN[0] + "\nshort line", "en", "s"), (2, "short line\n" + EN[0] + "\nnew", "en", "s")])
    assert {r.doc_id: r.text for r in linededup.drop_repeated_lines(docs).collect()} == {1: EN[0] + "\nshort line", 2: "short line\nnew"}


def test_short_lines_and_lines_without_blanks(spark):
    rng = np.random.default_rng(4)
    words = [f"v{i}" for i in range(12)]
    rows = [(i, "\n".join(" ".join(rng.choice(words, rng.integers(1, 7))) for _ in range(4)) + "\n\n") for i in range(40)]
    lines = [(i, n, set(x.split())) for i, t in rows for n, x in enumerate(t.split("\n"))]
    want = {(i, n) for a, (i, n, x) in enumerate(lines) if x and any(5 * len(x & y) >= 4 * len(x | y) for _, _, y in lines[:a])}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {(r.doc, r.line) for r in linededup.repeated_lines(docs, min_words=1).collect()} == want
    han = "".join(chr(0x4E00 + 7 * i) for i in range(60))
    docs = spark.createDataFrame([(1, f"{han}\nread more"), (2, f"{han[:30]}的{han[31:]}\nRead more\n{han[::-1]}")], "doc_id long, text string")
    got = linededup.drop_repeated_lines(docs.repartition(2), min_words=1).filter("doc_id = 2").first()
    assert got.removed == [0, 1] and got.text == han[::-1]


def test_toxicity(spark, odd):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = list(rng.choice([f"word{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(200)], 20)) + (["you", "idiot"] if bad else [])
        rows.append((i, " ".join(rng.permutation(words)), "en", "s"))
        labels.append((i, 1, int(bad)))
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    got = toxicity.score(docs, model).toPandas().set_index("doc_id").score
    assert all((got[i] >= 0.5) == (t == 1) for i, _, t in labels) and got.between(0, 1).all()
    assert toxicity.score(odd, model).count() == odd.count()
    assert {r.score for r in toxicity.score(odd, toxicity.fit(odd, marks.limit(0))).collect()} == {0.0}
    assert len(toxicity.features("", {})) == len(toxicity.NAMES)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this long site of ours</div>
<article><h1>Head &amp; line</h1><p><b>First   one<br>goes on</b> here with a lot of text to be kept.<p>Second&nbsp;one is long enough too.
<p>Short.</p><form>Search <input></form><div class="comments"><p>Reader says</p></div></article>
<aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_main_text(spark):
    want = "Head & line\nFirst one goes on here with a lot of text to be kept.\nSecond one is long enough too.\nShort."
    pages = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, "o"), (3, "v", "", "o"), (4, "w", "plain words", "o"), (5, "x", "<p>" * 3000 + "deep", "o")],
                                  "page_id long, url string, html string, text string")
    assert {r.page_id: r.text for r in extraction.extract(pages).collect()} == {1: want, 2: "", 3: "", 4: "plain words", 5: "deep"}
    assert extraction.extract(pages.limit(0)).count() == 0


def test_main_text_of_nested_and_uneven_parts():
    line = "A sentence of the article with enough words to be taken for its text, number {}."
    big, small = ("".join(f"<p>{line.format(i)}</p>" for i in part) for part in (range(8), range(8, 11)))
    want = [line.format(i) for i in range(11)]
    menu = "".join(f"<p><a href=/{i}>Go {i}</a></p>" for i in range(12))
    for tag in ("section", "div", "td"):
        html = f"<body><div>{menu}</div><div><{tag}>{big}</{tag}><{tag}>{small}</{tag}></div></body>"
        assert extraction.main_text(html).split("\n") == want
    html = f"<main><article>{big}</article><article>{small}</article></main><div>{menu}</div>"
    assert extraction.main_text(html).split("\n") == want
    html = f"<div>{menu}</div><article><h1>Head</h1><p>The lead.</p><div class=body>{big}{small}</div></article>"
    assert extraction.main_text(html).split("\n") == ["Head", "The lead.", *want]


def test_names_of_boilerplate_need_a_container_and_a_low_ratio():
    line = "A sentence of the article with enough words to be taken for its text, number {}."
    text = [line.format(i) for i in range(9)]
    p = [f"<p>{x}</p>" for x in text]
    html = (f"<article>{''.join(p[:3])}<h2 id=comments-on-the-method>Comments on it</h2>{p[3]}<section id=related-work>{p[4]}{p[5]}</section>"
            f"<p class=notice>A <span class=share-price>price</span> of 3</p><div class=notice>{p[6]}{p[7]}</div>{p[8]}"
            f"<ul class='share-buttons'>{'<li><a href=/><i></i>Go</a></li>' * 9}</ul></article><div class=related-posts>{p[0]}</div>")
    assert extraction.main_text(html).split("\n") == [*text[:3], "Comments on it", *text[3:6], "A price of 3", *text[6:]]


def test_secrets_spans_and_ledger(spark):
    text = "é Password = 'abcdefgh12' AKIA1234567890ABCD " + "0a" * 17 + " token: short token=secret=abcdefgh1"
    docs = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, text, 1), (4, "clean", 1)], "doc_id long, text string, blob int")
    ledger, found = secrets.scan(docs)
    got = {r.doc_id: r for r in secrets.by_path(docs, found).collect()}
    want = []
    for order, (kind, pattern, group, least) in enumerate((("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
                                                          ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32))):
        want += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    assert [tuple(x) for x in got[1].found] == sorted(want) and got[3].found == got[1].found
    assert (got[2].n_assign, got[4].found) == (0, [])
    assert ledger.count() == 3 * 3
    again, new = secrets.scan(docs, ledger)
    assert new.count() == 0 and again.count() == 9
    raised = (secrets.RULES[0], secrets.Rule("access", "AKIA[A-Z0-9]+", 0, 16, 2), secrets.RULES[2])
    assert {r.kind for r in secrets.scan(docs, ledger, raised)[1].collect()} == {"access"}
    assert secrets.by_path(docs.limit(0), found).count() == 0


def test_secrets_of_a_raised_rule_count_once(spark):
    docs = spark.createDataFrame([(1, "AKIA1234567890ABCD and AKIA12345678901", "f", 7, None), (1, "AKIA1234567890ABCD and AKIA12345678901", "f", 7, None)],
                                 "doc_id long, text string, found string, n_hex long, blob string")
    ledger, found = secrets.scan(docs)
    raised = (secrets.RULES[0], secrets.Rule("access", "AKIA[A-Z0-9]+", 0, 10, 2), secrets.RULES[2])
    ledger, more = secrets.scan(docs, ledger, raised)
    every = found.unionByName(more).unionByName(more)
    for rules, want in ((secrets.RULES, [(0, 18)]), (raised, [(0, 18), (23, 38)])):
        out = secrets.by_path(docs, every, rules=rules)
        assert out.columns == ["doc_id", "text", "blob", "n_assign", "n_access", "n_hex", "found"]
        rows = out.collect()
        assert len(rows) == 2 and all([(x.start, x.end) for x in r.found] == want and r.n_access == len(want) and r.n_hex == 0 for r in rows)


def test_mixture_with_clashing_names(spark, odd):
    clashing = odd.selectExpr("doc_id", "text", "lang", "source", "7 AS __key", "8 AS size", "9 AS copies", "'k' AS key", "1 AS total")
    out = mixing.mixed_documents(clashing)
    assert out.columns == clashing.columns
    plain = sorted(map(str, mixing.mixed_documents(odd).select("doc_id", "text").collect()))
    rows = out.collect()
    assert plain and sorted(str(r) for r in out.select("doc_id", "text").collect()) == plain
    assert {(r["__key"], r["size"], r["copies"], r["key"], r["total"]) for r in rows} == {(7, 8, 9, "k", 1)}
    assert mixing.mixed_documents(clashing.limit(0)).count() == 0


def test_top_k_with_ties_and_odd_vectors(spark):
    rows = [(i, [float(i % 7), 1.0, -0.5]) for i in range(200)] + [(500, None), (501, [1.0, None, 0.0]), (502, [float("nan"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (0, [0.0, 1.0, -0.5])]
    frame_ = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", 1024)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(frame_.filter("id % 100 = 0"), frame_, 5).collect()}
    w = {i: np.array([1024 * (i % 7), 1024, -512]) for i in range(200)}
    for q in (0, 100):
        best = sorted((-int(w[q] @ w[i]), i) for i in w if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert topk.search(frame_.limit(0), frame_, 5).count() == 0


def test_top_k_beyond_64_bits(spark):
    rng = np.random.default_rng(4)
    x = [[float(v) for v in rng.standard_normal(4) * 10.0 ** rng.integers(0, 9)] for _ in range(60)] + [[1e300, 0.0, 0.0, -1e300], [-1e300, 1e300, 1.0, 0.0]]
    low, high = -(1 << 63), (1 << 63) - 1
    w = [[min(max(int(np.floor(1024 * v)), low), high) for v in row] for row in x]
    rows = topk.quantized(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>"), "vec_id", "embedding", 1024)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.search(rows, rows, 61).collect()}
    for q, a in enumerate(w):
        best = sorted((-min(max(sum(s * t for s, t in zip(a, b)), low), high), i) for i, b in enumerate(w) if i != q)
        assert [got[q, k + 1] for k in range(61)] == [(i, -s) for s, i in best]


def test_top_k_in_many_groups(spark, monkeypatch):
    rows = [(i, [(i * 37 % 101) / 64, (i * 53 % 97) / 64]) for i in range(300)]
    frame_ = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 1024)
    want = topk.search(frame_.filter("id % 50 = 0"), frame_, 7).collect()
    monkeypatch.setattr(topk, "LEAST_GROUP", 10)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    assert sorted(topk.search(frame_.filter("id % 50 = 0"), frame_, 7).collect()) == sorted(want)


def test_graph_search_recall_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 16))
    x[1200:1300] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("inf")] + [0.0] * 15), (None, [1.0] * 16)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, 10).toPandas()
    asked, hits = [i for i in range(0, 1500, 20)], 0
    for q in asked:
        own = got[got.query_id == q].sort_values("rank")
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(set(own.vec_id) & set(np.lexsort((np.arange(1500), -scores))[:10]))
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own.score, scores[own.vec_id])
    assert set(got.query_id) == set(asked) and hits >= 0.9 * 10 * len(asked)
    few = ann.search(spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, 10)
    assert few.count() == 2


def test_graph_search_takes_the_common_width_and_walks_to_the_end(spark, monkeypatch):
    # A ring, and a graph of steps along it: the walk has to go half way round, node by node.
    angle = 2 * np.pi * np.arange(64) / 64
    ring = [(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angle)]
    points, _, width = ann.prepared(spark.createDataFrame([*ring, (900, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>"), "vec_id", "embedding", 3)
    assert width == 2 and points.count() == 64
    for name in ("ENTRIES", "LONGEST", "STARTS", "EXPANDED"):
        monkeypatch.setattr(ann, name, 1)
    graph = spark.createDataFrame([(i, (i + d) % 64, 0.0) for i in range(64) for d in (1, -1)], "id long, other long, sim float")
    asked = ann.query_codes(spark.createDataFrame([(1000, [-1.0, 0.0]), (1001, [1.0, 0.0])], "id long, vector array<double>"), 2)
    found = ann.walk(asked, ann.coded(points, 2), graph, 3).toPandas()
    for q, want in ((1000, {31, 32, 33}), (1001, {63, 0, 1})):
        assert set(found[found.id == q].nlargest(3, "sim").other) == want


@pytest.mark.parametrize("norms", ["one long", "spread"])
def test_graph_search_recall_with_unequal_norms(spark, norms):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "spread":
        x *= np.exp(1.5 * rng.standard_normal((4000, 1)))
    else:
        x[7] *= 10_000
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(docs, F.col("id") % 40 == 0, 20).toPandas()
    hits = 0
    for q in range(0, 4000, 40):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(set(got[got.query_id == q].vec_id) & set(np.argsort(-scores)[:20]))
    assert hits >= 0.9 * 20 * 100, hits / 2000


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_against_sql(spark, sf_dir, name):
    assert differences(queries.QUERIES[name](spark, sf_dir).toPandas(), connect(sf_dir).execute(queries.SQL[name]).df()) is None


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = dict(corpus_pipeline.STAGES)
    kept = last["language ID"](spark, docs, sf_dir)
    assert kept.columns == docs.columns and kept.count() >= 0.95 * docs.count()
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert set(out.doc_id) <= {r.doc_id for r in docs.select("doc_id").collect()} and len(out)
    assert out.groupby("sequence_id").length.sum().max() <= 2048


def test_deep_pages_comments_and_unclosed_markup():
    lines = [f"words of line {i:05d} here" for i in range(20_000)]
    assert extraction.main_text("<article>" + "".join(f"<div><p>{line}" for line in lines)) == "\n".join(lines)
    article, long = "The whole text of the article is here, and it is long.", "A reader liked this very much and says so at length, " * 5
    for name in ("comments", "user-comments", "reader-comments-list", "replies"):
        assert extraction.main_text(f"<main><p>{article}</p><div id='{name}'><p>{long}</p></div></main>") == article
    kept = f"<article><p>{article}</p><section id='comments-on-the-method'><p>{long.strip()}</p></section></article>"
    assert extraction.main_text(kept) == f"{article}\n{long.strip()}"
    assert extraction.main_text(f"<article><p>{article}</p></article><!-- never closed <p>markup") == article


def test_a_word_is_encoded_once_whatever_marks_close_it():
    import random

    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    words = packing.WordTokenizer(path)
    words.ids(["bravo### bravo$$$ bravo!! é.\" 7,%"])
    assert {"bravo", "###", "$$$", "!!", "é", "7"} <= words._words.keys()
    whole, rnd = Tokenizer.from_file(path), random.Random(5)
    letters = "ab'sétÀßª½3²9.,!?#$%<|>_-\"'́İΣς漢"
    texts = [" ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 6))) for _ in range(8)) for _ in range(1500)]
    for text, got in zip(texts, words.ids(texts)):
        assert got.tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_latin_texts_are_not_searched_for_scripts_without_blanks(monkeypatch):
    text = "Über den Fluß\ncafé ½ naïve"
    assert linededup._spaced(text) == text.lower() and linededup._spaced("ab漢字") == "ab 漢字 "
    monkeypatch.setattr(linededup, "_UNSPACED", None)
    assert linededup._spaced(text) == text.lower()


def test_second_search_reads_only_lines_with_a_wanted_cell(spark):
    def unread(text):
        raise AssertionError("this line has no word in a wanted cell")

    docs = spark.createDataFrame([(i, "one two three four five six\n" * 2, []) for i in range(3)], "doc_id long, text string, p array<int>")
    levels, words = linededup.rarity(docs)
    none = np.zeros(1 << (linededup.CELL_BITS - 3), np.uint8)
    found = linededup.candidates(docs, levels, words, (4, 5), False, "doc_id", "text", "p", reader=linededup.Reader(unread), cells=none)
    assert found.count() == 0


def test_second_search_finds_the_lines_of_a_full_one(spark):
    rng = np.random.default_rng(7)
    # Few different words in long lines too: their cells are digests of the whole set.
    extra = [" ".join(rng.choice(["ab", "cd", "ef"], rng.integers(1, 12))) for _ in range(40)]
    rows = [(i, t + "\n" + extra[i % 40]) for i, t in noisy_lines()]
    docs = spark.createDataFrame([(i, t, [n for n in range(5) if (i + n) % 4 == 0]) for i, t in rows], "doc_id long, text string, p array<int>")
    levels, words = linededup.rarity(docs)
    cells = linededup.probed_cells(docs, levels, (4, 5), "doc_id", "text", "p", 1)

    def found(cells):
        rows_ = linededup.candidates(docs, levels, words, (4, 5), False, "doc_id", "text", "p", min_words=1, cells=cells)
        return {tuple(r) for r in rows_.select("doc", "line", "other_doc", "other_line").collect()}

    want = found(None)
    assert len(want) > 100 and any(line == 4 for _, line, _, _ in want) and found(cells) == want


def test_entries_are_in_order_of_their_places():
    rng = np.random.default_rng(8)
    for doc in (rng.integers(0, 50, 2000), rng.choice([-1 << 63, -1, 0, (1 << 63) - 1], 2000)):
        rows = {"cell": np.sort(rng.integers(0, 300, 2000)).astype(np.uint64), "doc": doc, "line": rng.integers(0, 9, 2000).astype(np.int32)}
        got, want = linededup._by_place(rows), np.lexsort((rows["line"], doc, rows["cell"]))
        assert all(np.array_equal(rows[c][got], rows[c][want]) for c in rows)
    assert not len(linededup._by_place({c: np.zeros(0, np.int64) for c in ("cell", "doc", "line")}))


def test_words_do_not_differ_by_case():
    low, up = (linededup.words_of(["ab cd\n" + x, "é ab"])[0] for x in ("xyz", "XYZ"))
    assert np.array_equal(low, up) and low[0] == linededup.words_of(["É AB"])[0][1] and len(set(low.tolist())) == 4
