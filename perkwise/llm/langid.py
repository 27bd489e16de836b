"""Language identification by the nearest of several centroids per language.

A text is a normalised TF-IDF vector of hashed byte n-grams (two and three bytes of the lower-cased letters).
Each language of the training rows is clustered by spherical k-means; a text takes the language of the
centroid with the largest cosine, and is rejected where even that one is farther away than nearly all
training texts of the language are from theirs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkwise.llm.common import give_back, held_out, lean, let_go, row_key, windows
from perkwise.session import small_batches, stage

DIMENSIONS = 4096
CENTROIDS = 4
# Bound of the training sample: about so many rows of each language, the ones of the smallest digests.
ROWS_PER_LANGUAGE = 2000
ROUNDS = 12
REJECT_QUANTILE = 0.001
REJECT_SHARE = 0.5
UNKNOWN = "und"
# So many texts at once that the counts of their n-grams take a few megabytes.
TEXTS_AT_ONCE = 64
_LETTER = re.compile(r"[^\W\d_]")
# ASCII letters stay, everything else of ASCII becomes a blank; bytes of other characters stay.
_LETTERS_ONLY = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def gram_counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in the whole text."""
    out = np.zeros(DIMENSIONS)
    for part in windows(text):
        raw = b" ".join([b"", *part.lower().encode("utf-8", "replace").translate(_LETTERS_ONLY).split(), b""])
        b = np.frombuffer(raw, np.uint8).astype(np.uint32)
        if len(b) < 3:
            continue
        two = b[:-1] << np.uint32(8) | b[1:]
        three = two[:-1] << np.uint32(8) | b[2:]
        for grams in (two + np.uint32(1 << 24), three):
            # The multiplication mixes the bits; the top 12 of them choose one of 4096 places.
            out += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def vectors(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(counts) * weights)


def spherical_clusters(rows: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows; starts from rows far from each other, so it draws nothing."""
    chosen = [int(np.argmax(rows @ _unit(rows.sum(axis=0, keepdims=True))[0]))]
    nearest = rows @ rows[chosen[0]]
    while len(chosen) < min(count, len(rows)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    centroids = rows[chosen]
    for _ in range(rounds):
        own = np.argmax(rows @ centroids.T, axis=1)
        # Added up one by one: a copy of a cluster's rows may be as large as all of them.
        sums = np.zeros_like(centroids)
        for i, row in zip(own, rows):
            sums[i] += row
        centroids = _unit(np.where(np.isin(np.arange(len(centroids)), own)[:, None], sums, centroids))
    return centroids


def sample_rows(sample: pa.Table, weights: np.ndarray) -> np.ndarray:
    """The vectors of (places, values), in an order of their own; made row by row, so that there is one array of them."""
    cells = [(p, v) for batch in sample.to_batches() for p, v in zip(
        batch.column("places").to_numpy(zero_copy_only=False), batch.column("values").to_numpy(zero_copy_only=False))]
    counts = np.zeros((1, DIMENSIONS), np.float32)

    def vector(i: int) -> np.ndarray:
        counts[:] = 0
        counts[0, cells[i][0]] = cells[i][1]
        return vectors(counts, weights)[0]

    # The order of rows in a group follows the shuffle; the clusters must not.
    order = np.lexsort(np.round([vector(i)[:64] for i in range(len(cells))], 9).T)
    out = np.empty((len(cells), DIMENSIONS))
    for to, i in enumerate(order):
        out[to] = vector(i)
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray
    centroids: np.ndarray
    owners: np.ndarray
    limits: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine to its nearest centroid and whether the text is rejected."""
        letters = np.array([has_letter(t) for t in texts], bool)
        names, scores, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        if self.languages and letters.any():
            where = np.flatnonzero(letters)
            near = vectors(np.stack([gram_counts(texts[i]) for i in where]), self.weights) @ self.centroids.T
            best = near.argmax(axis=1)
            scores[where] = np.clip(near[np.arange(len(where)), best], 0, 1)
            owner = self.owners[best]
            rejected[where] = scores[where] < self.limits[owner]
            for i, o in zip(where, owner):
                names[i] = self.languages[o]
        return names, scores, rejected


def _training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    rows = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return rows.select(lang_col, text_col)
    # A digest is below this share of its range for about per_language rows of a language.
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    place = F.shiftrightunsigned(row_key(id_col), 11) / F.lit(float(1 << 53))
    return rows.filter(place < share[F.col(lang_col)]).select(lang_col, text_col)


def fit(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE, centroids: int = CENTROIDS,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Centroids from at most about ``per_language`` labelled rows of each language outside the held-out fold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, places, values = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if has_letter(text):
                    counts = gram_counts(text)
                    places.append(np.flatnonzero(counts).astype(np.int32))
                    values.append(counts[places[-1]].astype(np.float32))
                    langs.append(lang)
            yield pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
                names=["lang", "places", "values"])

    rows = _training_rows(docs, id_col, text_col, lang_col, per_language)
    with small_batches(docs.sparkSession):
        sample = stage(rows.mapInArrow(lean(count), "lang string, places array<int>, values array<float>"), "language-sample")
    total = sample.count()
    seen = np.zeros(DIMENSIONS)
    for place, n in sample.select(F.explode("places").alias("p")).groupBy("p").count().collect():
        seen[place] = n
    weights = np.log((1 + total) / (1 + seen)) + 1

    def cluster(group: pa.Table) -> pa.Table:
        let_go()
        unit = sample_rows(group, weights)
        found = spherical_clusters(unit, centroids)
        limit = REJECT_SHARE * float(np.quantile((unit @ found.T).max(axis=1), REJECT_QUANTILE))
        lang = group.column("lang")[0].as_py()
        del unit
        give_back()
        return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "limit": pa.array([limit] * len(found)),
                         "centroid": pa.array(found.tolist(), pa.list_(pa.float64()))})

    found = (sample.groupBy("lang").applyInArrow(cluster, "lang string, limit double, centroid array<double>")
             .toPandas().sort_values("lang", kind="stable"))
    languages = sorted(found["lang"].unique())
    owners = np.array([languages.index(x) for x in found["lang"]], np.int64)
    limits = np.array([found.loc[found["lang"] == x, "limit"].iloc[0] for x in languages])
    matrix = np.stack([np.asarray(c) for c in found["centroid"]]) if len(found) else np.zeros((0, DIMENSIONS))
    return LanguageModel(languages, weights, matrix, owners, limits)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """All columns of the documents with ``lang_pred``, ``lang_score`` (cosine, 0 to 1) and ``rejected``.

    A text that is null or has no letter gets ``und``, score 0 and is rejected; so does every text when
    there was nothing to learn from. Columns of these three names that are there already are replaced.
    """
    new = ("lang_pred", "lang_score", "rejected")
    kept = docs.drop(*new)
    names_out = [*kept.columns, *new]
    text_at = kept.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(start, TEXTS_AT_ONCE)
                names, scores, rejected = shared.value.predict(batch.column(text_at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)],
                    names=names_out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(lean(run), f"{fields}, lang_pred string, lang_score double, rejected boolean")
