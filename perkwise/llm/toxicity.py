"""Toxicity scores: gradient-boosted trees over dense features of a text, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkwise.llm.common import FOLDS, held_out, row_key, windows
from perkwise.session import stage

# Bound of the training sample, in labelled rows; the ones of the smallest digests.
TRAINING_ROWS = 20_000
LEXICON_WORDS = 1_000
PREFIXES = (4, 5)
TREES, DEPTH = 24, 4
CALIBRATION_FOLD = FOLDS - 1
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"(?<!\S)[^\W\d_]+[\d@$*#!|+]+[^\W_][\w@$*#!|+]*")
_CAPITALS = re.compile("[A-Z\u00c0-\u00d6\u00d8-\u00de]+")
_REPEATED = re.compile(r"(.)\1{3,}")
_UNMASK = str.maketrans("013457@$!|+", "oieastasiit")
_YOU = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner deinen euch ihr tú tu te ti tus vos vosotros usted ustedes "
    "vous votre vos toi ton ta tes".split())
NAMES = ("density", "hits", "weight", "strongest", "unmasked_density", "unmasked_hits", "near_you", "you", "capitals",
         "loud_words", "exclamations", "punctuation", "masked", "repeats", "length")


def _fold(word: str) -> str:
    """A masked word with its look-alikes as letters and without other marks."""
    return "".join(c for c in word.lower().translate(_UNMASK) if c.isalpha())


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """The dense features of a whole text, in the order of NAMES."""
    words = chars = letters = capitals = loud = exclaimed = marks = masked = you = hits = unmasked = repeats = 0
    weight = strongest = nearest = 0.0
    get = lexicon.get
    for part in windows(text):
        tokens = _WORD.findall(part)
        low = [w.lower() for w in tokens]
        marked = [(i, v) for i, w in enumerate(low) if (v := get(w) or get(w[:5] + "-") or get(w[:4] + "-"))]
        found = [i for i, _ in marked]
        pronouns = [i for i, w in enumerate(low) if w in _YOU]
        words += len(low)
        hits += len(found)
        you += len(pronouns)
        for _, v in marked:
            weight += v
            strongest = max(strongest, v)
        if found and pronouns:
            places = np.array(pronouns)
            at = np.searchsorted(places, found)
            gap = np.minimum(np.abs(places[np.minimum(at, len(places) - 1)] - found), np.abs(places[np.maximum(at - 1, 0)] - found))
            nearest = max(nearest, 1.0 / (1.0 + float(gap.min())))
        disguised = _MASKED.findall(part)
        masked += len(disguised)
        unmasked += sum(_fold(w) in lexicon for w in disguised)
        size = sum(map(len, tokens))
        chars += len(part)
        letters += size
        capitals += sum(map(len, _CAPITALS.findall(part)))
        loud += sum(1 for w in tokens if len(w) > 2 and w.isupper())
        exclaimed += part.count("!")
        marks += len(part) - size - part.count(" ") - part.count("\n")
        repeats += len(_REPEATED.findall(part))
    n = max(1, words)
    return [hits / n, np.log1p(hits), weight / n, strongest, unmasked / n, np.log1p(unmasked), nearest, you / n,
            capitals / max(1, letters), loud / n, exclaimed / n, marks / max(1, chars), masked / n, repeats / n, np.log1p(words)]


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    prior: float


def _featured(rows: DataFrame, lexicon: dict[str, float], text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``features``, an array in the order of NAMES."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)
    names = [*keep, "features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [features(t or "", shared.value) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.list_(pa.float64()))], names=names)

    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.select(text_col, *keep).mapInArrow(run, f"{fields}features array<double>")


def learn_lexicon(sample: DataFrame, text_col: str, prior: float, limit: int = LEXICON_WORDS) -> dict[str, float]:
    """Words and beginnings of words ("stem-") that stand in toxic texts far more often than chance.

    With each goes the share of its texts that are toxic. What counts as chance rises with the number of
    words that are tried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, marks = [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set()
                for part in windows(text):
                    own.update(_WORD.findall(part.lower()))
                own |= {w[:n] + "-" for w in own for n in PREFIXES if len(w) > n}
                words += own
                marks += [toxic] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(marks, pa.int32())], names=["word", "toxic"])

    counts = stage(sample.select(text_col, "toxic").mapInArrow(run, "word string, toxic int")
                   .groupBy("word").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")).filter("n >= 3"), "toxicity-words")
    least = 3.5 + 0.5 * float(np.log10(max(1, counts.count())))
    excess = (F.col("a") - F.col("n") * prior) / F.sqrt(F.col("n") * prior * (1 - prior))
    chosen = (counts.filter((excess >= least) & (F.col("a") >= 0.3 * F.col("n")))
              .orderBy(excess.desc(), "word").limit(limit).select("word", (F.col("a") / F.col("n")).alias("share")))
    return {r["word"]: r["share"] for r in chosen.collect()}


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> ToxicityModel:
    """Lexicon and trees from three of the learning folds, calibration from the fourth.

    At most about ``rows`` labelled rows are used. An id labelled more than once is toxic if one label says
    so; null ids and labels are left out. Without both labels the score is their mean, or 0.
    """
    known = (labels.filter(~held_out(id_col) & F.col(label_col).isNotNull())
             .groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")))
    total = known.count()
    place = F.shiftrightunsigned(row_key("__id"), 11) / F.lit(float(1 << 53))
    chosen = known.filter(place < min(1.0, rows / max(1, total)))
    # Bounded by ``rows``, so it may be copied to all tasks.
    sample = stage(docs.select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("__id"))
                   .filter(F.col(text_col).isNotNull())
                   .select(text_col, "toxic", (F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS).alias("fold")), "toxicity-sample")
    used, prior = sample.agg(F.count("*"), F.avg("toxic")).first()
    if not used or prior in (0.0, 1.0):
        return ToxicityModel({}, None, None, prior or 0.0)
    lexicon = learn_lexicon(sample.filter(F.col("fold") != CALIBRATION_FOLD), text_col, prior)
    table = stage(_featured(sample, lexicon, text_col, ["toxic", "fold"])
                  .select(array_to_vector("features").alias("features"), F.col("toxic").cast("double").alias("label"), "fold"), "toxicity-features")
    learning, holding = table.filter(F.col("fold") != CALIBRATION_FOLD), table.filter(F.col("fold") == CALIBRATION_FOLD)
    if learning.select("label").distinct().count() < 2:
        return ToxicityModel(lexicon, None, None, prior)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=42, maxBins=64, featuresCol="features").fit(learning)
    if holding.select("label").distinct().count() < 2:
        holding = table
    raw = trees.transform(holding).select(vector_to_array("rawPrediction")[1].alias("raw"), "label")
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(raw)
    return ToxicityModel(lexicon, trees, calibration, prior)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, raw, score) of every row, score from 0 to 1; a null text is scored as an empty one."""
    rows = _featured(docs, model.lexicon, text_col, [id_col])
    if model.trees is None:
        return rows.select(id_col, F.lit(0.0).alias("raw"), F.lit(model.prior).alias("score"))
    scored = model.trees.transform(rows.withColumn("features", array_to_vector("features")))
    scored = scored.select(id_col, vector_to_array("rawPrediction")[1].alias("raw"))
    out = model.calibration.transform(scored)
    return out.select(id_col, "raw", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("score"))
