import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from perkwise.functions.stemming import porter_stem
from perkwise.operators import calls, evaluation as ev, registry


def bleu(spark, pairs):
    rows = [(i, g, r) for i, (g, r) in enumerate(pairs)]
    frame = spark.createDataFrame(rows, "pair_id int, generated string, reference string")
    return [r["bleu"] for r in ev.sentence_bleu(frame).orderBy("pair_id").collect()]


def slow_bleu(generated, reference):
    """Straight from the definition, on texts whose tokens are separated by blanks."""
    g, r = generated.split(), reference.split()
    halvings, logs = 0, []
    matches = 0
    for n in range(1, 5):
        a = Counter(tuple(g[i : i + n]) for i in range(len(g) - n + 1))
        b = Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
        total = sum(a.values())
        if total == 0:
            break
        hit = sum((a & b).values())
        matches += hit
        if hit == 0:
            halvings += 1
            logs.append(math.log(1 / (2**halvings * total)))
        else:
            logs.append(math.log(hit / total))
    if not matches:
        return 0.0
    brevity = 1.0 if len(g) >= len(r) else math.exp(1 - len(r) / len(g))
    return brevity * math.exp(sum(logs) / len(logs))


def test_bleu_of_equal_disjoint_short_and_empty_texts(spark):
    got = bleu(spark, [("hello world offer", "hello world offer"), ("abc def ghi", "xyz uvw rst"), ("a", "a"), ("", "x"), ("", "")])
    assert got == [pytest.approx(1.0), 0.0, pytest.approx(1.0), 0.0, 0.0]


def test_bleu_agrees_with_the_definition(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("a b c d e".split(), k=rng.randint(1, 30))) for _ in range(40)]
    pairs = list(zip(texts[::2], texts[1::2]))
    assert bleu(spark, pairs) == [pytest.approx(slow_bleu(g, r), abs=1e-12) for g, r in pairs]


def test_scores_stay_in_the_row(spark):
    frame = spark.range(10).select(F.col("id").alias("pair_id"), F.lit("a b").alias("generated"), F.lit("a c").alias("reference"))
    assert "Exchange" not in ev.bleu_counts(frame)._jdf.queryExecution().executedPlan().toString()
    copies = frame.select("pair_id", F.col("generated").alias("body"), "reference", F.lit(None).cast("string").alias("judge_raw"))
    plan = ev.evaluate_copies(copies)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_repeated_ids_are_scored_apart(spark):
    frame = spark.createDataFrame([(1, "one two three four", "one two three four", None), (1, "one two", "zwei", None), (1, None, "x", None)],
        "pair_id int, body string, reference string, judge_raw string")
    assert sorted(r["bleu"] for r in ev.sentence_bleu(frame, generated="body").collect()) == [0.0, 0.0, 1.0]
    assert sorted((r["bleu"], r["rouge_l"], r["aggregate"]) for r in ev.evaluate_copies(frame).collect()) == [(0.0, 0.0, 0.45), (0.0, 0.0, 0.45), (1.0, 1.0, 0.85)]


def test_tokens(spark):
    text = 'Save 20%-30%, now!\nPay $1,000.50 &amp; "win" well-\nknown U.S. items; e-mail 5-star'
    got = spark.createDataFrame([(text,)], "t string").select(ev.metric_tokens(F.col("t")).alias("x")).first()["x"]
    assert got == ['Save', '20', '%', '-30', '%', ',', 'now', '!', 'Pay', '$', '1,000.50', '&', '"', 'win', '"', 'wellknown', 'U', '.', 'S', '.', 'items', ';', 'e-mail', '5', '-', 'star']


def slow_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_rouge_against_dynamic_programming(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("ab cd ef gh ij".split(), k=rng.randint(0, 90))) for _ in range(60)]
    rows = [(i, g, r) for i, (g, r) in enumerate(zip(texts[::2], texts[1::2]))]
    frame = spark.createDataFrame(rows, "pair_id int, generated string, reference string")
    for row in ev.rouge_l(frame).collect():
        _, g, r = rows[row["pair_id"]]
        g, r = g.split(), r.split()
        n = slow_lcs(g, r)
        want = 2 * n / (len(g) + len(r)) if n else 0.0
        assert row["rouge_l"] == pytest.approx(want, abs=1e-12)


def test_rouge_stems_and_ignores_case_and_signs(spark):
    frame = spark.createDataFrame([(1, "Earning STARS, quickly!", "earned star quickly")], "pair_id int, generated string, reference string")
    assert ev.rouge_l(frame).first()["rouge_l"] == pytest.approx(1.0)
    assert ev.rouge_l(frame, stem=False).first()["rouge_l"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("word, stem", [
    # Examples from the published description.
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cats", "cat"), ("agreed", "agre"), ("feed", "feed"),
    ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"),
    ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("failing", "fail"), ("filing", "file"),
    ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"),
    ("vietnamization", "vietnam"), ("operator", "oper"), ("feudalism", "feudal"), ("decisiveness", "decis"),
    ("hopefulness", "hope"), ("formaliti", "formal"), ("sensibiliti", "sensibl"), ("triplicate", "triplic"),
    ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"), ("adjustment", "adjust"),
    ("adoption", "adopt"), ("replacement", "replac"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"),
    ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("dying", "die"), ("news", "news"), ("by", "by"),
])
def test_stems(word, stem):
    assert porter_stem(word) == stem


def test_keywords(spark):
    def score(text, words):
        return spark.createDataFrame([(text,)], "t string").select(ev.keyword_relevance(F.col("t"), words)).first()[0]

    assert score("SUBJECT body offer_code", ["subject", "Body", "offer_code"]) == 1.0
    assert score("nothing", ["subject", "body"]) == 0.0
    assert score("subject only", ["subject", "x", "z"]) == pytest.approx(1 / 3)
    assert score("anything", []) == 1.0


def test_gate(spark):
    frame = spark.createDataFrame([(0.5,), (1.0,)], "score double")
    assert tuple(ev.gate(frame).first()) == (0.75, 0.75, True, 2)
    assert tuple(ev.gate(frame.limit(0)).first()) == (0.0, 0.75, False, 0)


def test_judge_is_all_or_nothing(spark):
    raws = ['{"coherence": 5, "brand_alignment": 4, "cta_strength": "3"}', '{"coherence": 5, "brand_alignment": 4}', "oops",
            '{"coherence": 5, "brand_alignment": "x", "cta_strength": 3}', None]
    got = [tuple(r[0]) for r in spark.createDataFrame([(r,) for r in raws], "r string").select(ev.judge_scores(F.col("r"))).collect()]
    assert got == [(1.0, 0.8, 0.6)] + [(0.75, 0.75, 0.75)] * 4


def test_judge_backend_errors_give_the_default(spark):
    class Judge:
        def generate(self, messages):
            if "bad" in messages[0]["content"]:
                raise RuntimeError("network error")
            return '{"coherence": 5, "brand_alignment": 5, "cta_strength": 5}'

    copies = spark.createDataFrame([("a", "H", "bad", "C"), ("b", "H", "good", "C")], "pair_id string, headline string, body string, cta string")
    rated = ev.judge_answers(copies, Judge, "Rate {headline} / {body} / {cta}")
    got = {r["pair_id"]: r["s"]["coherence"] for r in rated.select("pair_id", ev.judge_scores(F.col("judge_raw")).alias("s")).collect()}
    assert got == {"a": 0.75, "b": 1.0}


def test_evaluation_run(spark, tmp_path):
    from perkwise.sources.tables import read_eval_history

    body = "A free slice of cake comes with your third visit. Just show the app."
    frame = spark.createDataFrame([("a", body, body, None), ("b", body, "other words here", '{"coherence": 5, "brand_alignment": 5, "cta_strength": 5}')],
        "pair_id string, body string, reference string, judge_raw string")
    scores = ev.evaluate_copies(frame)
    got = {r["pair_id"]: r for r in scores.collect()}
    assert got["a"]["bleu"] == 1.0 and got["a"]["rouge_l"] == 1.0 and got["a"]["aggregate"] == 0.85
    assert got["b"]["aggregate"] == pytest.approx(0.2 * got["b"]["bleu"] + 0.2 * got["b"]["rouge_l"] + 0.6, abs=1e-3)
    for stamp in ("20260101T000000Z", "20260102T000000Z"):
        ev.write_run(scores, str(tmp_path), stamp)
    (tmp_path / "eval_20250101T000000Z.json").write_text('{\n "mean_score": 0.5\n}')
    history = read_eval_history(spark, f"{tmp_path}/eval_*").collect()
    assert [h["run"][5:9] for h in history] == ["2026", "2026", "2025"]
    assert history[0]["n"] == 2 and history[0]["timestamp"] == "20260102T000000Z"
    runs = read_eval_history(spark, f"{tmp_path}/eval_*")
    assert ev.latest_run(runs).first()["timestamp"] == "20260102T000000Z"
    assert tuple(ev.latest_run(runs.filter("false")).first()) == ("\u2014", 0.0, False)
    assert tuple(history[2])[1:] == ("eval_20250101T000000Z", 0.5, False, 0)


def test_histogram_is_cumulative(spark):
    frame = spark.createDataFrame([("m", 50.0), ("m", 50.1), ("m", 9999.0)], "model string, latency_ms double")
    got = {r["le"]: r["calls"] for r in calls.latency_histogram(frame).collect()}
    assert got == {"50": 1, "100": 2, "250": 2, "500": 2, "1000": 2, "2500": 2, "5000": 2, "+Inf": 3}


def test_registry_state(spark):
    log = spark.createDataFrame([("p", "v1", None, 1, 1), ("p", "v2", "v1", 2, 2), ("q", "v1", None, 1, 3)],
        "name string, version string, previous string, activated_at int, entry int")
    got = {r["name"]: tuple(r)[1:] for r in registry.registry_state(log).collect()}
    assert got == {"p": ("v2", "v1", 2, True), "q": ("v1", None, 1, False)}
    versions = spark.createDataFrame([("p", "v1"), ("p", "v2"), ("p", "v3")], "name string, version string")
    status = {r["version"]: (r["activated_at"], r["status"]) for r in registry.version_list(versions, log).collect()}
    assert status == {"v1": (1, "archived"), "v2": (2, "active"), "v3": (None, "archived")}


def test_tokens_of_a_batch_are_not_in_memory_at_once():
    import tracemalloc

    import pyarrow as pa

    def peak(rows):
        column = pa.array([[f"w{i}-{j}" for j in range(100)] for i in range(rows)])
        tracemalloc.start()
        assert sum(len(a) + len(b) for a, b in ev._token_rows(column, column)) == 200 * rows
        try:
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    small = peak(1000)
    assert peak(4000) < 1.2 * small and small < 20e6
    assert list(ev._token_rows(pa.array([["a"], []]), pa.array([[], ["b", "c"]]))) == [(["a"], []), ([], ["b", "c"])]
