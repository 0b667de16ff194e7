"""Quality classifier: histogram gradient-boosted trees over document statistics.

The model is trained on the driver from a bounded sample of labelled rows. Its
trees are complete, so a model is three arrays, and a batch of documents goes
down all of them in numpy, level by level. Scoring is one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hashes, spread, texts_of
from .tokens import text_batches
from .words import data_of

#: Labelled rows that the model is trained on at most: those with the least hashes of doc_id.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, SMOOTH = 60, 4, 64, 0.2, 1.0
_ASCII = np.arange(256)
_KINDS = [
    (_ASCII >= 65) & (_ASCII <= 90), (_ASCII >= 97) & (_ASCII <= 122), (_ASCII >= 48) & (_ASCII <= 57), _ASCII >= 128,
    np.isin(_ASCII, [9, 10, 11, 12, 13, 32]), np.isin(_ASCII, [ord(c) for c in ".,;:?'\"()-"]),
    _ASCII == ord("!"), _ASCII == ord("|"), np.isin(_ASCII, [ord(c) for c in "#$%&*@^~<>{}[]\\/=+_`"]),
]
N_FEATURES = len(_KINDS) + 13


def statistics(text: str, data: np.ndarray) -> list[float]:
    """Numbers that describe a text; an empty one has zeros."""
    if not len(data):
        return [0.0] * N_FEATURES
    counts = np.bincount(data, minlength=256)
    share = counts / len(data)
    words = text.split()
    n = max(len(words), 1)
    distinct: dict[str, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = [s for s in text.split("\n") if s.strip()]
    some = share[share > 0]
    adjacent = sum(map(str.__eq__, words, words[1:]))
    return [
        *(float(share[k].sum()) for k in _KINDS), float(np.log1p(len(data))), float(np.log1p(len(words))), float(sizes.mean()), float(sizes.std()),
        float(sizes.max()), len(distinct) / n, max(distinct.values(), default=0) / n, adjacent / n, -float((some * np.log2(some)).sum()),
        float(np.log1p(len(lines))), 1 - len(set(lines)) / max(len(lines), 1), len(data) / max(len(lines), 1), sum(v for v in distinct.values() if v > 2) / n,
    ]


def statistics_of(texts: pa.Array) -> np.ndarray:
    data, at = data_of(texts)
    rows = [statistics(t, data[a:b]) for t, a, b in zip(texts.to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return np.array(rows, dtype=np.float64).reshape(-1, N_FEATURES)


class Model(NamedTuple):
    """Trees as arrays: split feature and threshold by tree and inner node, value by
    tree and leaf, and the sum that a row starts with."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost trees on the logistic loss. Without rows the score is a half; with one
    label only it is that label's smoothed share."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    features, thresholds, values = [], [], []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        total = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            grad, hess = y - p, p * (1 - p)
            feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
            for depth in range(DEPTH):
                first, width = 2**depth - 1, 2**depth
                gain, best = np.zeros(width), [(0, np.inf, BINS)] * width
                for j, cut in enumerate(cuts):
                    key = (node - first) * BINS + binned[:, j]
                    g = np.bincount(key, grad, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    h = np.bincount(key, hess, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    whole_g, whole_h = g[:, -1:], h[:, -1:]
                    score = g**2 / (h + SMOOTH) + (whole_g - g) ** 2 / (whole_h - h + SMOOTH) - whole_g**2 / (whole_h + SMOOTH)
                    score[:, len(cut) :] = -1
                    top = score.argmax(axis=1)
                    for k in range(width):
                        if score[k, top[k]] > gain[k] + 1e-12:
                            gain[k], best[k] = score[k, top[k]], (j, cut[top[k]], int(top[k]))
                for k, (j, cut, _) in enumerate(best):
                    feature[first + k], threshold[first + k] = j, cut
                split_bin = np.array([b for _, _, b in best])[node - first]
                node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > split_bin)
            g = np.bincount(node - inner, grad, leaves)
            h = np.bincount(node - inner, hess, leaves)
            leaf = RATE * g / (h + SMOOTH)
            total += leaf[node - inner]
            features.append(feature)
            thresholds.append(threshold)
            values.append(leaf)
    shape = (len(features), inner)
    return Model(np.array(features, np.int64).reshape(shape), np.array(thresholds).reshape(shape), np.array(values).reshape(len(features), leaves), base)


def fold(doc_id) -> F.Column:
    """0, 1 or 2; rows of fold 1 are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3, F.lit(1))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in text_batches(batch):
            x = statistics_of(texts)
            values = pa.ListArray.from_arrays(pa.array(range(0, x.size + 1, N_FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("quality"), values], names=["doc_id", "quality", "x"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on at most TRAIN_ROWS labelled documents outside fold 1."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    usable = usable.where(F.col("quality").isin(0, 1) & (fold("doc_id") != 1))
    sample = least_hashes(usable, "doc_id", TRAIN_ROWS, usable.count(), "quality")
    # The sample is bounded, so it may be broadcast. Of documents with equal doc_id one counts, so what is collected is bounded too.
    found = texts_of(docs).join(F.broadcast(sample), "doc_id").mapInArrow(_features, "doc_id long, quality int, x array<double>")
    rows = found.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas()
    x = np.array(rows.x.tolist(), dtype=np.float64).reshape(-1, N_FEATURES)
    order = np.lexsort((*x.T, rows.quality.to_numpy(dtype=np.int64)))
    return train(x[order], rows.quality.to_numpy(dtype=np.float64)[order])


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row a document: doc_id, held_out, score, predicted.

    Null and empty texts are scored by the statistics of an empty text; repeated
    rows are scored each; a null doc_id counts as held out. Without labels the
    score is a half.
    """
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_batches(batch):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(model.score(statistics_of(texts)))], names=["doc_id", "score"])

    scored = texts_of(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model scores at a half or more, with all their columns.

    Null and empty texts are scored by the statistics of an empty text; repeated
    rows are scored each, and rows with a null doc_id by their text like any other.
    Without labels the score is a half, and all stay; an empty table stays empty.
    """
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_batches(batch):
                yield rows.filter(pa.array(model.score(statistics_of(pc.fill_null(texts, ""))) >= 0.5))

    return spread(docs).mapInArrow(run, docs.schema)
