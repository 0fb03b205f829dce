"""Language identification by nearest centroids of character n-grams.

A text becomes a vector of hashed byte trigrams and quadgrams of its letters, weighted
by ln(1 + tf) x idf and scaled to length 1. Each language gets several
centroids by spherical k-means over its training texts, and a text goes to the
language of the centroid with the highest cosine. A text is rejected if it lies
further from that centroid than the language's own training texts do. Cosines
grow with the number of different cells, so the bound is a curve over that
number: ``slack`` times a low quantile of the training cosines in each
half-octave of cell counts, with straight lines in between.

The model is fitted on a bounded sample, at most ``sample_per_language`` texts of
each language and ``sample_texts`` in all, chosen by a hash; everything else
covers every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, values

#: Hashed n-gram cells.
CELLS = 1 << 13
#: Byte -> byte: A-Z lower-cased, what is no letter a space (digits and ASCII signs); bytes of letters beyond ASCII stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are turned into cells at a time.
PIECE = 1 << 20
#: Half-octaves of cell counts, up to all cells.
BANDS = 2 * 13 + 1
#: The quantile of a band's training cosines, and the texts that a band needs for it: one odd text doesn't set it.
LOW, BAND_TEXTS = 0.05, 20
#: Share of a language's texts that a centroid stands for at least.
LEAST_SHARE = 0.02


def counts(text: bytes) -> np.ndarray:
    """Counts of the hashed trigrams and quadgrams, words apart by one space; whole text, a piece at a time."""
    out = np.zeros(CELLS, np.float64)
    clean = b" " + b" ".join(text.translate(LETTERS).split()) + b" "
    for start in range(0, len(clean) - 2, PIECE):
        b = np.frombuffer(clean[start : start + PIECE + 3], np.uint8).astype(np.uint32)
        tri = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
        end = min(PIECE, len(tri))
        cells = (tri[:end] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
        out += np.bincount(cells, minlength=CELLS)
        if len(b) > 3:
            quad = (tri[:-1] * np.uint32(0x85EBCA6B)) ^ (b[3:] * np.uint32(0xC2B2AE35))
            out += np.bincount((quad[:PIECE] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13), minlength=CELLS)
    return out


def vector(text: bytes, idf: np.ndarray | None = None) -> np.ndarray:
    v = np.log1p(counts(text))
    if idf is not None:
        v = v * idf
    norm = np.sqrt(v @ v)
    return (v / norm if norm else v).astype(np.float32)


def band_of(cells: np.ndarray) -> np.ndarray:
    """Half-octave of each cell count."""
    return np.minimum((2 * np.log2(np.maximum(cells, 1))).astype(np.int64), BANDS - 1)


def low_quantiles(near: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The low quantile of the cosines ``near`` in each half-octave of ``cells``; NaN where there are too few texts."""
    band = band_of(cells)
    return np.array([np.quantile(own, LOW) if len(own := near[band == b]) >= BAND_TEXTS else np.nan for b in range(BANDS)])


def bound_curve(own: np.ndarray, pooled: np.ndarray, fallback: tuple[int, float], slack: float) -> np.ndarray:
    """The least cosine at the middle of each half-octave: of the language's own texts, else of all languages'.

    Between known bands it follows straight lines; below the first one it falls
    with the square root of the cells, as the cosine of a part of a text with the
    whole does; above the last it stays. ``fallback`` is a band and its
    quantile for samples in which no band is known.
    """
    low = np.where(np.isnan(own), pooled, own)
    known = np.flatnonzero(~np.isnan(low))
    if not len(known):
        known, low = np.array([fallback[0]]), np.full(BANDS, fallback[1])
    at = np.arange(BANDS)
    return slack * np.interp(at, known, low[known]) * np.minimum(1.0, 2.0 ** ((at - known[0]) / 4))


@dataclass(frozen=True)
class Model:
    """Centroids (rows of length 1), the language of each, the idf, and for each language the least cosines of its texts at the middles of the half-octaves of cells."""

    langs: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    least: np.ndarray
    idf: np.ndarray

    def bound(self, lang: int, cells: int) -> float:
        """The least cosine with which a text of that many different cells is taken for that language."""
        return float(np.interp(2 * np.log2(max(cells, 1)), np.arange(BANDS) + 0.5, self.least[lang], left=0.0)) if cells > 1 else 0.0

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language or und, score from 0 to 1, rejected); among equal cosines the first centroid counts."""
        if not text or not any(c.isalpha() for c in text):
            return "und", 0.0, True
        if not self.langs:
            return "und", 0.0, True
        v = vector(text.encode("utf-8", "replace"), self.idf)
        cos = self.centroids @ v
        best = int(np.argmax(cos))
        lang = int(self.owner[best])
        top = float(cos[best])
        return self.langs[lang], min(1.0, max(0.0, top)), top < self.bound(lang, int(np.count_nonzero(v)))


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: rows of length 1, started at rows far from one another.

    Clusters of less than LEAST_SHARE of the rows, or of a single one, are odd
    texts rather than a kind of the language and get no centroid, unless all are such.
    """
    centres = [x.mean(axis=0)]
    for _ in range(1, min(k, len(x))):
        centres.append(x[int(np.argmin(np.max(x @ np.array(centres).T, axis=1)))])
    c = np.array(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        nearest = np.argmax(x @ c.T, axis=1)
        c = np.array([x[nearest == j].mean(axis=0) if (nearest == j).any() else c[j] for j in range(len(c))])
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    large = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c)) >= max(2, LEAST_SHARE * len(x))
    return (c[large] if large.any() else c).astype(np.float32)


def sample_rows(docs: DataFrame, sample_per_language: int, sample_texts: int, max_languages: int) -> DataFrame:
    """(lang, text): about ``sample_per_language`` training texts of each of the commonest languages, ``sample_texts`` in all, chosen by a hash."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ((crc_of_id(F.col("doc_id")) % 4 != 2) | F.col("doc_id").isNull()))
    commonest = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(max_languages).collect()
    each = min(sample_per_language, sample_texts // max(1, len(commonest)))
    per = docs.sparkSession.createDataFrame([(r["lang"], each / r["n"]) for r in commonest], "lang string, _share double")
    rows = rows.select("doc_id", "lang", "text").join(F.broadcast(per), "lang")  # max_languages rows at most
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1_000_000.0
    return rows.filter(chance < F.col("_share")).select("lang", "text")


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, cells = [], []
        for lang, text in zip(batch.column(0).to_pylist(), values(batch.column(1).cast(pa.binary())), strict=True):
            raw = np.minimum(counts(text), 65535).astype(np.uint16)
            if raw.any():
                at = np.flatnonzero(raw).astype(np.uint16)
                langs.append(lang)
                cells.append(at.tobytes() + raw[at].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(cells, pa.binary())], names=["lang", "cells"])


def fit(docs: DataFrame, *, sample_per_language: int = 1500, sample_texts: int = 8192, max_languages: int = 500, centroids: int = 4, slack: float = 0.6) -> Model:
    """Fit on the training rows of ``docs`` (text, lang, doc_id): those with a text and a lang that aren't held out.

    What reaches the driver is bounded by ``sample_texts`` (about, as rows are
    chosen by a hash), each of at most 8192 cells in 32 KB: 256 MB. They are
    shared among the ``max_languages`` commonest values of ``lang``, at most
    ``sample_per_language`` for each; rarer ones aren't learned. The same rows
    give the same model, however they are partitioned. An empty table gives a
    model without languages, for which every text is ``und`` and rejected.
    """
    sample: dict[str, list[bytes]] = {}
    for r in sample_rows(docs, sample_per_language, sample_texts, max_languages).mapInArrow(_vectors, "lang string, cells binary").toLocalIterator():
        sample.setdefault(r["lang"], []).append(bytes(r["cells"]))
    seen, rows = np.zeros(CELLS, np.int64), 0
    for packed in sample.values():
        packed.sort()
        rows += len(packed)
        for p in packed:
            seen[np.frombuffer(p, np.uint16).reshape(2, -1)[0]] += 1
    idf = (np.log((1 + rows) / (1 + seen)) + 1).astype(np.float32)
    langs, owner, out, near, cells = sorted(sample), [], [], [], []
    for j, lang in enumerate(langs):  # one language's sample unpacked at a time
        own = np.zeros((len(sample[lang]), CELLS), np.float32)
        cells.append(np.zeros(len(own), np.int64))
        for i, p in enumerate(sample.pop(lang)):
            pair = np.frombuffer(p, np.uint16).reshape(2, -1)
            own[i, pair[0]] = np.log1p(pair[1].astype(np.float32)) * idf[pair[0]]
            cells[j][i] = pair.shape[1]
        own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
        c = cluster(own, centroids)
        near.append((own @ c.T).max(axis=1))
        owner += [j] * len(c)
        out.append(c)
    if not langs:
        return Model([], np.zeros(0, np.int64), np.zeros((0, CELLS), np.float32), np.zeros((0, BANDS)), idf)
    every = np.concatenate(near)
    sizes = np.concatenate(cells)
    pooled, fallback = low_quantiles(every, sizes), (int(band_of(np.median(sizes))), float(np.quantile(every, LOW)))
    least = np.array([bound_curve(low_quantiles(n, c), pooled, fallback, slack) for n, c in zip(near, cells, strict=True)])
    return Model(langs, np.array(owner, np.int64), np.concatenate(out), least, idf)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every whole text.

    ``lang_pred`` is always the nearest language, ``rejected`` tells that even
    that one is too far. Null texts, empty ones and those without a letter are
    ``und`` with score 0 and rejected. Short texts are judged like any other, by
    the bound for their number of cells. Very long ones are counted a megabyte
    at a time. Rows that share a doc_id are judged one by one; other columns
    are ignored, whatever their names; an empty table gives an empty one.
    The model, of at most languages x centroids x 8192 floats, goes along with the function.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.judge(t) for t in values(batch.column(1))]
            columns = [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_of_id(doc_id) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that are rejected; columns unchanged, whatever their names.

    The text passes Python once, and rows aren't joined. Null, empty and letterless
    texts go; very long ones are judged whole; repeated rows each by
    themselves; an empty table gives an empty one.
    """
    model = fit(docs, **options)
    at, names = docs.columns.index("text"), docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not model.judge(t)[2] for t in values(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema).toDF(*names)
