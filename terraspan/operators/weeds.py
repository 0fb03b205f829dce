"""Weed candidates: colour distance to a reference, a supervised forest with held-out groups, patches and their filters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraspan.storage import stored

from .patches import components

# Regularisation of the colour covariance; the accepted false positives, mean and worst, and the least recall to publish.
RIDGE, MAX_FP_MEAN, MAX_FP_WORST, LEAST_RECALL = (1e-5, 1e-5, 5e-5), 0.03, 0.10, 0.35
THRESHOLDS = [round(0.60 + 0.02 * i, 2) for i in range(20)]


@dataclass(frozen=True)
class ColourModel:
    mean: np.ndarray
    inverse: np.ndarray
    cutoff: float

    def distance(self, *bands: Column) -> Column:
        """Squared Mahalanobis distance, as an expression."""
        d = [b - F.lit(float(m)) for b, m in zip(bands, self.mean, strict=True)]
        out = F.lit(0.0)
        for i in range(len(d)):
            for j in range(len(d)):
                out = out + float(self.inverse[i, j]) * d[i] * d[j]
        return out


def fit_colour(pixels: DataFrame, bands: list[str], quantile: float = 0.9) -> ColourModel:
    """Mean, sample covariance (regularised) and the distance that ``quantile`` of the reference pixels lie within."""
    pairs = [(i, j) for i in range(len(bands)) for j in range(i, len(bands))]
    row = pixels.agg(*[F.avg(b) for b in bands], *[F.covar_samp(bands[i], bands[j]) for i, j in pairs]).first()
    cov = np.zeros((len(bands), len(bands)))
    for (i, j), v in zip(pairs, row[len(bands) :], strict=True):
        cov[i, j] = cov[j, i] = v
    model = ColourModel(np.array(row[: len(bands)], float), np.linalg.inv(cov + np.diag(RIDGE[: len(bands)])), 0.0)
    cutoff = pixels.agg(F.percentile(model.distance(*[F.col(b) for b in bands]), quantile)).first()[0]
    return ColourModel(model.mean, model.inverse, float(cutoff))


PATCHES = "label long, pixels long, row0 long, col0 long, row1 long, col1 long, score_sum double, elongation double, solidity double"


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of pixel squares, in order."""
    p = np.unique(np.concatenate([points + c for c in ((0, 0), (0, 1), (1, 0), (1, 1))]), axis=0)
    p = p[np.lexsort((p[:, 1], p[:, 0]))]

    def half(order):
        out: list[np.ndarray] = []
        for q in order:
            while len(out) > 1 and np.linalg.det(np.stack([out[-1] - out[-2], q - out[-2]])) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]), float)


def _sides(hull: np.ndarray) -> tuple[float, float]:
    """(longer, shorter) side of the smallest rectangle, at any angle, around a convex hull; it lies along one of the hull's edges."""
    edges = np.roll(hull, -1, axis=0) - hull
    along = edges / np.linalg.norm(edges, axis=1, keepdims=True)
    across = np.stack([-along[:, 1], along[:, 0]], axis=1)
    a, b = np.ptp(hull @ along.T, axis=0), np.ptp(hull @ across.T, axis=0)
    best = int(np.argmin(a * b))
    return float(max(a[best], b[best])), float(min(a[best], b[best]))


def measured(patch: pd.DataFrame) -> pd.DataFrame:
    """Size, box, score and shape of one patch: the ratio of its smallest rectangle's sides, and its share of its convex hull."""
    points = patch[["row", "col"]].to_numpy()
    hull = _hull(points)
    (longer, shorter), (x, y) = _sides(hull), hull.T
    area = abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2
    (r0, c0), (r1, c1) = points.min(axis=0), points.max(axis=0)
    row = (patch["label"].iloc[0], len(points), r0, c0, r1, c1, float(patch["score"].sum()), longer / shorter, len(points) / area)
    return pd.DataFrame([row], columns=[c.split()[0] for c in PATCHES.split(", ")])


def patches(scored: DataFrame, tile: int = 512, most: int = 1_000_000) -> DataFrame:
    """Connected candidates of a raster (row, col, score, hit), closed by a cross of one pixel: size, box, score, elongation and solidity.

    Patches are found across tiles. Those of more than ``most`` pixels are no
    candidates of any filter here and get their size, box and score alone, by
    aggregation, with no shape: no task holds one.
    """
    hits = scored.filter("hit").select("row", "col")
    closed = closing(hits)
    labelled = stored(components(closed, tile).join(scored.select("row", "col", "score"), ["row", "col"], "left").na.fill(0.0, ["score"]), "labelled")
    sizes = labelled.groupBy("label").agg(
        F.count(F.lit(1)).alias("pixels"), F.min("row").alias("row0"), F.min("col").alias("col0"), F.max("row").alias("row1"), F.max("col").alias("col1"), F.sum("score").alias("score_sum")
    )
    small = labelled.join(sizes.filter(F.col("pixels") <= most).select("label"), "label", "left_semi")
    large = sizes.filter(F.col("pixels") > most).withColumns({"elongation": F.lit(None).cast("double"), "solidity": F.lit(None).cast("double")})
    return small.groupBy("label").applyInPandas(measured, PATCHES).unionByName(large)


def closing(pixels: DataFrame) -> DataFrame:
    """Pixels (row, col) grown by a cross of one pixel and shrunk again, over the whole raster."""
    cross = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))])
    spread = lambda df: df.withColumn("_o", F.explode(cross)).select((F.col("row") + F.col("_o.r")).alias("row"), (F.col("col") + F.col("_o.c")).alias("col"))
    grown = spread(pixels.distinct()).distinct()
    # a pixel stays where its whole cross has grown
    return spread(grown).groupBy("row", "col").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 5").select("row", "col")


def acceptable(found: DataFrame, pixel_area: float, least: float = 0.03, most: float = 1.5, elongation: float = 2.5, solidity: float = 0.55) -> DataFrame:
    area = F.col("pixels") * pixel_area
    return found.filter((area >= least) & (area <= most) & (F.col("elongation") <= elongation) & (F.col("solidity") >= solidity)).withColumn("area_m2", area)


def balanced(samples: DataFrame, group: str) -> DataFrame:
    """With ``weight``: each group counts the same, mean 1."""
    counts = samples.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    whole = counts.agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("g")).first()
    return samples.join(counts, group).withColumn("weight", F.lit(whole["n"] / max(1, whole["g"])) / F.col("_n")).drop("_n")


def leave_one_group_out(samples: DataFrame, features: list[str], group: str, label: str, trees: int = 120, depth: int = 12) -> DataFrame:
    """``samples`` with ``score`` from a forest that never saw their group. One forest a group: groups are hand-drawn polygons, a few dozen."""
    data = VectorAssembler(inputCols=features, outputCol="_features").transform(balanced(samples, group))
    forest = RandomForestClassifier(featuresCol="_features", labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=8, featureSubsetStrategy="0.7", seed=42)
    out = None
    for g in sorted(r[0] for r in samples.select(group).distinct().collect()):
        model = forest.fit(data.filter(F.col(group) != g))
        part = model.transform(data.filter(F.col(group) == g)).withColumn("score", vector_to_array("probability")[1]).select(*samples.columns, "score")
        out = part if out is None else out.unionByName(part)
    return out


def choose_threshold(scored: DataFrame, group: str, label: str) -> tuple[float, float]:
    """(threshold, recall): the highest mean recall of positive groups among thresholds with acceptable false positives, else the last one."""
    swept = scored.withColumn("t", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])))
    rates = swept.groupBy("t", group, label).agg(F.avg(F.when(F.col("score") >= F.col("t"), 1.0).otherwise(0.0)).alias("rate"))
    of = lambda f, y: F.coalesce(f(F.when(F.col(label) == y, F.col("rate"))), F.lit(0.0))
    rows = rates.groupBy("t").agg(of(F.avg, 1).alias("recall"), of(F.avg, 0).alias("mean"), of(F.max, 0).alias("worst")).orderBy("t").collect()
    good = [r for r in rows if r["mean"] <= MAX_FP_MEAN and r["worst"] <= MAX_FP_WORST and r["t"] >= 0.80]
    best = max(good, key=lambda r: (r["recall"], -r["t"])) if good else rows[-1]
    return best["t"], best["recall"]


def publishable(recall: float) -> bool:
    return recall >= LEAST_RECALL
