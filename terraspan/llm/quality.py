"""Quality scores by a regularised quadratic discriminant.

A text becomes a vector of transformed statistics (logarithms of counts, angular
transforms of shares). Each class gets its mean and a covariance shrunk towards the
pooled one and towards its own diagonal; the score is the logistic of the
difference of the two Gaussian log-densities, by Mahalanobis distances from
Cholesky factors that are computed once and travel with the function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, materialize, values

FEATURES = (
    "log_words", "mean_length", "deviation_of_length", "capitals", "digits", "stops_and_commas", "signs", "line_ends", "spaces", "beyond_ascii",
    "entropy", "different_words", "different_pairs", "most_common", "one_letter", "long_words", "capital_words",
)
_CLASS = np.zeros(256, np.int64)
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(97, 123)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[*b".,;:?'\"-()"]] = 4
_CLASS[[*b"!#$%&*+/<=>@[\\]^_`{|}~"]] = 5
_CLASS[10] = 6
_CLASS[[9, 11, 12, 13, 32]] = 7
_CLASS[128:] = 8


def _angle(share: float) -> float:
    return float(np.arcsin(np.sqrt(min(1.0, max(0.0, share)))))


def statistics(text: bytes) -> list[float]:
    """The vector of a whole text; zeros for one without words."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kind = np.bincount(_CLASS, weights=byte, minlength=9)
    size = len(text)
    seen = byte[byte > 0] / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        float(np.log1p(n)), float(np.log(lengths.mean())), float(np.log1p(lengths.std())), _angle(kind[1] / max(1, kind[1] + kind[2])), _angle(kind[3] / size),
        _angle(kind[4] / size), _angle(kind[5] / size), _angle(kind[6] / size), _angle(kind[7] / size), _angle(kind[8] / size),
        float(-(seen * np.log(seen)).sum()), _angle(len(count) / n), _angle(pairs / max(1, n - 1)), _angle(max(count.values()) / n),
        _angle(float((lengths == 1).mean())), _angle(float((lengths > 15).mean())), _angle(sum(w.isupper() for w in words) / n),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.float64())
    for batch in batches:
        texts = values(batch.column(1).cast(pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([statistics(t or b"") for t in texts], kind)], names=["doc_id", "stats"])


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row; null text counts as empty."""
    return docs.select("doc_id", "text").mapInArrow(_measure, "doc_id long, stats array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a batch, long: (label, place, value); place 0 is the count, then means' sums, then products'."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.array(batch.column(1).to_pylist(), dtype=np.float64)
        y = np.array(batch.column(0).to_pylist())
        for label in (0, 1):
            own = x[y == label]
            value = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(value), pa.int32()), pa.array(range(len(value)), pa.int32()), pa.array(value)], names=["label", "place", "value"])


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log-determinants of both classes, and the log prior odds; or, with one class only, a constant."""

    means: np.ndarray
    factors: np.ndarray
    offset: float
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        squared = [np.square((x - self.means[c]) @ self.factors[c].T).sum(axis=1) for c in (0, 1)]
        odds = self.offset + 0.5 * (squared[0] - squared[1])
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -30, 30)))


def discriminant(moments: dict[int, np.ndarray], pooled: float = 0.3, diagonal: float = 0.05, floor: float = 1e-3) -> Discriminant:
    """From each class's sums: S_c is shrunk to (1 - pooled - diagonal) S_c + pooled S + diagonal diag(S_c) + floor I."""
    d = len(FEATURES)
    n = np.array([moments[c][0] if c in moments else 0.0 for c in (0, 1)])
    if not n.all():
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), 0.0, 0.5 if not n.any() else float(n[1] > 0))
    means = np.array([moments[c][1 : d + 1] / n[c] for c in (0, 1)])
    own = [moments[c][d + 1 :].reshape(d, d) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    both = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    factors, logs = [], []
    for c in (0, 1):
        s = (1 - pooled - diagonal) * own[c] + pooled * both + diagonal * np.diag(np.diag(own[c])) + floor * np.eye(d)
        low = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(low))
        logs.append(2 * np.log(np.diag(low)).sum())
    return Discriminant(means, np.array(factors), float(np.log(n[1] / n[0]) + 0.5 * (logs[0] - logs[1])))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_of_id(doc_id) % 3 == 1, F.lit(False))


def fit(measured: DataFrame, labels: DataFrame) -> Discriminant:
    """All labelled rows that aren't held out; where a doc_id has several labels, their majority (1 on a tie). Null labels don't count."""
    one = labels.filter(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    sums = measured.join(one, "doc_id").select("label", "stats").mapInArrow(_moments, "label int, place int, value double")
    rows = sums.groupBy("label", "place").agg(F.sum("value").alias("value")).collect()  # 2 x (1 + d + d x d) at most
    out: dict[int, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["label"], np.zeros(1 + len(FEATURES) + len(FEATURES) ** 2))[r["place"]] = r["value"]
    return discriminant(out)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    score: the chance of quality 1, from 0 to 1; empty and null texts get the
    score of the zero vector. Without labels every score is 0.5. Rows that
    share a doc_id are scored one by one; an empty table gives an empty one.
    Very long texts are read whole: a task holds one text's different words and
    pairs of words at a time. Other columns are ignored, whatever their names.
    """
    measured = materialize(measure(docs), "statistics")
    model = fit(measured, labels)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    scored = measured.mapInArrow(judge, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
