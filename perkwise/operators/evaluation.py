"""Quality scores of generated copy and the gates built on them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from perkwise.functions.compute import compute_once
from perkwise.functions.numbers import round_exact
from perkwise.functions.stemming import porter_stem
from perkwise.functions.jsontext import string_map
from perkwise.operators.prompts import render_template

# Gate, judge dimensions and their fallback, weights of the aggregate.
PASS_THRESHOLD = 0.75
JUDGE_DIMENSIONS = ["coherence", "brand_alignment", "cta_strength"]
JUDGE_DEFAULT = 0.75
WEIGHTS = {"bleu": 0.2, "rouge_l": 0.2, "judge": 0.6}
# Rows whose tokens are Python objects at once.
TOKEN_ROWS = 256


def keyword_relevance(text: Column, keywords: list[str]) -> Column:
    """Share of the keywords found in the text, ignoring case; 1 without keywords."""
    if not keywords:
        return F.lit(1.0)
    lowered = F.lower(text)
    hits = None
    for word in keywords:
        hit = F.coalesce(F.contains(lowered, F.lit(word.lower())), F.lit(False)).cast("int")
        hits = hit if hits is None else hits + hit
    return hits / F.lit(float(len(keywords)))


def gate(scores: DataFrame, score: str = "score", threshold: float = PASS_THRESHOLD) -> DataFrame:
    """Mean score against the threshold; an empty batch has mean 0."""
    return scores.agg(
        F.coalesce(F.avg(score), F.lit(0.0)).alias("mean_score"), F.count(F.lit(1)).alias("n")
    ).select(
        "mean_score", F.lit(threshold).alias("threshold"),
        (F.col("mean_score") >= threshold).alias("passed"), "n",
    )


def metric_tokens(text: Column) -> Column:
    """Tokens by the public mteval-13a rules, as an array."""
    out = F.regexp_replace(text, "<skipped>", "")
    out = F.regexp_replace(out, "-\n", "")
    out = F.regexp_replace(out, "\n", " ")
    for entity, sign in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    # The four substitutions of mteval-13a.
    for pattern, replacement in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
        (r"([^0-9])([\.,])", "$1 $2 "),
        (r"([\.,])([^0-9])", " $1 $2"),
        (r"([0-9])(-)", "$1 $2 "),
    ):
        out = F.regexp_replace(out, pattern, replacement)
    return F.filter(F.split(out, r"\s+"), lambda token: token != "")


def _token_rows(*columns: pa.Array) -> Iterator[tuple[list, ...]]:
    """Token arrays row by row. As Python objects the tokens of a batch would take many times its bytes, so only
    ``TOKEN_ROWS`` rows of it are at any time."""
    for start in range(0, len(columns[0]), TOKEN_ROWS):
        for row in zip(*(c.slice(start, TOKEN_ROWS).to_pandas() for c in columns)):
            yield tuple(map(list, row))


def _counts(max_order: int):
    """Of two token arrays per row: clipped matches and totals of each order, and the second's length."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def count(generated: pa.Array, reference: pa.Array) -> pa.Array:
        def of(ours: list, theirs: list) -> list[int]:
            matches, totals = [], []
            for n in range(max_order):
                grams, known = (Counter(zip(*(tokens[i:] for i in range(n + 1)))) for tokens in (ours, theirs))
                matches.append(sum(min(found, known[gram]) for gram, found in grams.items() if gram in known))
                totals.append(max(len(ours) - n, 0))
            return [*matches, *totals, len(theirs)]

        return pa.array([of(a, b) for a, b in _token_rows(generated, reference)], pa.list_(pa.int32()))

    return count


def with_bleu_counts(
    pairs: DataFrame, generated: str = "generated", reference: str = "reference", max_order: int = 4,
) -> DataFrame:
    """Every row with its clipped n-gram matches, n-gram totals and lengths; rows stay where they are.

    A missing text counts as empty.
    """
    def tokens(text: str) -> Column:
        return metric_tokens(F.coalesce(F.col(text), F.lit("")))

    rows = compute_once(pairs, _gen=tokens(generated), _ref=tokens(reference))
    orders = range(1, max_order + 1)
    # The score refers to the counts many times; a generator keeps them from being counted for each.
    rows = compute_once(rows.withColumn("_counts", _counts(max_order)("_gen", "_ref")).drop("_gen", "_ref"), _all=F.col("_counts"))
    return rows.select(
        *pairs.columns,
        *[F.col("_all")[n - 1].alias(f"correct_{n}") for n in orders],
        *[F.col("_all")[max_order + n - 1].alias(f"total_{n}") for n in orders],
        F.col("_all")[2 * max_order].alias("reference_length"),
    )


def bleu_counts(
    pairs: DataFrame, key: str = "pair_id", generated: str = "generated",
    reference: str = "reference", max_order: int = 4,
) -> DataFrame:
    """Clipped n-gram matches, n-gram totals and lengths of every pair; repeated ids stay apart."""
    orders = range(1, max_order + 1)
    return with_bleu_counts(pairs.select(key, generated, reference), generated, reference, max_order).select(
        key, *[f"correct_{n}" for n in orders], *[f"total_{n}" for n in orders], "reference_length")


def bleu_from_counts(max_order: int = 4) -> Column:
    """Sentence BLEU in [0, 1]: effective order, exponential smoothing of empty matches."""
    log_sum, used, halvings = F.lit(0.0), F.lit(0), F.lit(0)
    alive = F.lit(True)
    for n in range(1, max_order + 1):
        correct, total = F.col(f"correct_{n}"), F.col(f"total_{n}")
        alive = alive & (total > 0)
        empty = alive & (correct == 0)
        halvings = halvings + empty.cast("int")
        precision = F.when(empty, F.lit(1.0) / (F.pow(F.lit(2.0), halvings) * total)).otherwise(correct / total)
        log_sum = log_sum + F.when(alive, F.log(precision)).otherwise(0.0)
        used = used + alive.cast("int")
    length, reference = F.col("total_1"), F.col("reference_length")
    brevity = F.when(length >= reference, F.lit(1.0)).otherwise(F.exp(F.lit(1.0) - reference / length))
    any_match = F.lit(False)
    for n in range(1, max_order + 1):
        any_match = any_match | (F.col(f"correct_{n}") > 0)
    return F.when(~any_match, F.lit(0.0)).otherwise(brevity * F.exp(log_sum / used))


def sentence_bleu(pairs: DataFrame, key: str = "pair_id", **columns) -> DataFrame:
    """BLEU of every row, in one pass without a shuffle."""
    return bleu_counts(pairs, key, **columns).select(key, bleu_from_counts().alias("bleu"))


def word_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda token: token != "")


def _common_length(a: list, b: list) -> int:
    """Longest common subsequence by the bit-parallel method (Hyyro 2004)."""
    where: dict = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        match = row & where.get(token, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


@F.arrow_udf(T.IntegerType())
def _lcs(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array([_common_length(a, b) for a, b in _token_rows(left, right)], pa.int32())


@F.arrow_udf(T.IntegerType())
def _lcs_of_stems(left: pa.Array, right: pa.Array) -> pa.Array:
    known: dict[str, str] = {}

    def stems(tokens) -> list[str]:
        for token in tokens:
            if token not in known:
                known[token] = porter_stem(token) if len(token) > 3 else token
        return [known[token] for token in tokens]

    return pa.array([_common_length(stems(a), stems(b)) for a, b in _token_rows(left, right)], pa.int32())


def with_rouge_l(pairs: DataFrame, generated: str = "generated", reference: str = "reference", stem: bool = True) -> DataFrame:
    """Every row with ``rouge_l``; a missing text counts as empty.

    Stems keep the number of tokens, so lengths are taken before: one function call a row, tokens travel once.
    """
    def tokens(text: str) -> Column:
        return word_tokens(F.coalesce(F.col(text), F.lit("")))

    rows = compute_once(pairs, _gen=tokens(generated), _ref=tokens(reference))
    rows = rows.withColumn("_lcs", (_lcs_of_stems if stem else _lcs)("_gen", "_ref"))
    precision, recall = F.col("_lcs") / F.size("_gen"), F.col("_lcs") / F.size("_ref")
    score = F.when(F.col("_lcs") > 0, F.lit(2.0) * precision * recall / (precision + recall)).otherwise(0.0)
    return rows.withColumn("rouge_l", score).drop("_gen", "_ref", "_lcs")


def rouge_l(
    pairs: DataFrame, key: str = "pair_id", generated: str = "generated",
    reference: str = "reference", stem: bool = True,
) -> DataFrame:
    """ROUGE-L F-measure per pair."""
    return with_rouge_l(pairs.select(key, generated, reference), generated, reference, stem).select(key, "rouge_l")


def judge_answers(copies: DataFrame, make_backend, template: str) -> DataFrame:
    """Add ``judge_raw``: a backend's answer to the template filled with headline, body and cta.

    A failing call leaves null, which scores as the default.
    """
    fields = {c: F.col(c) for c in ("headline", "body", "cta")}
    asked = copies.withColumn("_prompt", render_template(template, fields))
    schema = copies.select("*", F.lit(None).cast("string").alias("judge_raw")).schema

    def run(batches):
        backend = make_backend()

        def answer(prompt: str) -> str | None:
            try:
                return backend.generate([{"role": "user", "content": prompt}])
            except Exception:
                return None

        for batch in batches:
            answers = [answer(p) for p in batch["_prompt"]]
            yield batch.drop(columns="_prompt").assign(judge_raw=pd.Series(answers, batch.index, dtype=object))

    return asked.mapInPandas(run, schema)


def judge_scores(raw: Column) -> Column:
    """Judge answer as a struct of three scores in [0, 1]; any fault gives the default for all."""
    fields = string_map(raw)
    values = [fields[d].try_cast("double") for d in JUDGE_DIMENSIONS]
    sound = F.lit(True)
    for value in values:
        sound = sound & value.isNotNull()
    return F.struct(*[
        F.when(sound, value / F.lit(5.0)).otherwise(F.lit(JUDGE_DEFAULT)).alias(d)
        for d, value in zip(JUDGE_DIMENSIONS, values)
    ])


def aggregate_score(bleu: Column, rouge: Column, dimensions: list[Column]) -> Column:
    total = dimensions[0]
    for d in dimensions[1:]:
        total = total + d
    mean = total / F.lit(float(len(dimensions)))
    return round_exact(
        F.lit(WEIGHTS["bleu"]) * bleu + F.lit(WEIGHTS["rouge_l"]) * rouge + F.lit(WEIGHTS["judge"]) * mean, 4
    )


def evaluate_copies(copies: DataFrame, stem: bool = True) -> DataFrame:
    """All scores per copy: columns pair_id, body, reference and the judge's raw answer.

    BLEU and ROUGE-L look at the body only. One row in, one row out, without a shuffle or join; ids may repeat.
    """
    rows = copies.select("pair_id", "body", "reference", judge_scores(F.col("judge_raw")).alias("_judge"))
    counted = with_rouge_l(with_bleu_counts(rows, "body", "reference"), "body", "reference", stem)
    scored = counted.withColumn("bleu", bleu_from_counts())
    dims = [F.col(f"_judge.{d}") for d in JUDGE_DIMENSIONS]
    return scored.select(
        "pair_id",
        round_exact(F.col("bleu"), 4).alias("bleu"),
        round_exact(F.col("rouge_l"), 4).alias("rouge_l"),
        *[d.alias(name) for name, d in zip(JUDGE_DIMENSIONS, dims)],
        aggregate_score(F.col("bleu"), F.col("rouge_l"), dims).alias("aggregate"),
    )


def run_report(
    scores: DataFrame, timestamp: str, threshold: float = PASS_THRESHOLD, groups: list[str] = []
) -> DataFrame:
    """Summary of a run; the verdict uses the unrounded mean. The scores themselves stay a table."""
    return scores.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg("aggregate").alias("_mean")
    ).select(
        *groups,
        F.lit(timestamp).alias("timestamp"), "n", F.lit(threshold).alias("threshold"),
        round_exact(F.col("_mean"), 4).alias("mean_aggregate_score"),
        (F.col("_mean") >= threshold).alias("passed"),
    )


def write_run(scores: DataFrame, path: str, timestamp: str, threshold: float = PASS_THRESHOLD) -> None:
    """One run: the summary under ``eval_<time>`` and its scores, one per line, under ``scores_<time>``."""
    run_report(scores, timestamp, threshold).coalesce(1).write.json(f"{path}/eval_{timestamp}")
    scores.write.json(f"{path}/scores_{timestamp}")


def latest_run(history: DataFrame) -> DataFrame:
    """The newest entry of a run history; without any, a failed run of score 0."""
    newest = F.max_by(F.struct("timestamp", "mean_score", "passed"), "run")
    nothing = F.struct(
        F.lit("\u2014").alias("timestamp"), F.lit(0.0).alias("mean_score"), F.lit(False).alias("passed")
    )
    return history.agg(F.coalesce(newest, nothing).alias("_run")).select("_run.*")
