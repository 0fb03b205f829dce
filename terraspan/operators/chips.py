"""Label chips: a small grid around each annotated shape, with its mask and the image there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.functions import kernels as k
from terraspan.functions.affine import Affine

from . import neighbours

# Pixels on a side and their size in metres; what a mask holds where there is a label and where nothing is known.
SIZE, RES, LABELLED, UNKNOWN = 200, 0.025, 1, 255
SCHEMA = "id string, size int, transform array<double>, mask binary"


def centre(rings: list[np.ndarray]) -> tuple[float, float]:
    """Centre of gravity; rings inside an odd number of others are holes."""
    whole, moment = 0.0, np.zeros(2)
    for i, ring in enumerate(rings):
        own = ring - rings[0][0]  # near the origin, where products keep their digits
        after = np.roll(own, -1, axis=0)
        cross = own[:, 0] * after[:, 1] - after[:, 0] * own[:, 1]
        x, y = ring[0]
        depth = sum(bool(k.inside_ring(np.array(x), np.array(y), [r])) for j, r in enumerate(rings) if j != i)
        sign = (-1) ** depth * np.sign(cross.sum())
        whole += sign * cross.sum() / 2
        moment += sign * ((own + after) * cross[:, None]).sum(axis=0) / 6
    x, y = rings[0][0] + moment / whole if whole else np.concatenate(rings).mean(axis=0)
    return float(x), float(y)


def label_chips(samples: DataFrame, size: int = SIZE, res: float = RES) -> DataFrame:
    """(id, size, transform, mask) of samples (id, rings): a grid around the shape's centre, LABELLED where a pixel's centre lies inside, UNKNOWN elsewhere. Shapes without rings give no chip."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for name, shape in zip(frame["id"], frame["rings"], strict=True):
                x, y = centre(rings := [np.array([(p["x"], p["y"]) for p in r], float) for r in shape])
                west, north, step = x - size * res / 2, y + size * res / 2, (np.arange(size) + 0.5) * res
                inside = k.inside_ring((west + step)[None, :], (north - step)[:, None], rings)
                out.append((name, size, [res, 0.0, west, 0.0, -res, north], np.where(inside, LABELLED, UNKNOWN).astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["id", "size", "transform", "mask"])

    return samples.select(F.col("id").cast("string").alias("id"), "rings").filter("size(rings) > 0").mapInPandas(run, SCHEMA)


def images(found: DataFrame, pixels: DataFrame, bands: list[str], t: Affine) -> DataFrame:
    """(id, chip_row, chip_col, bands) of chips, from the pixels of a raster with the transform ``t``, between its pixels."""
    line = F.sequence(F.lit(0), F.col("size") - 1)
    spread = found.select("id", "size", "transform", F.explode(line).alias("chip_row")).withColumn("chip_col", F.explode(line))
    m = [F.col("transform")[i] for i in range(6)]
    right, down = F.col("chip_col") + 0.5, F.col("chip_row") + 0.5
    x, y = m[0] * right + m[1] * down + m[2] - t.c, m[3] * right + m[4] * down + m[5] - t.f
    det = t.a * t.e - t.b * t.d
    places = spread.select("id", "chip_row", "chip_col", ((y * t.a - x * t.d) / det).alias("row"), ((x * t.e - y * t.b) / det).alias("col"))
    return neighbours.bilinear(places, pixels, ["id", "chip_row", "chip_col"], bands)


def manifest(found: DataFrame, name: str, srid: int, source: str) -> DataFrame:
    """One row a chip, as a training set's list has it."""
    stem = F.concat(F.lit(f"{name}_"), F.lpad("id", 2, "0"))
    return found.select(
        F.concat(stem, F.lit(".png")).alias("image"), F.concat(stem, F.lit("_mask.png")).alias("mask"), F.col("id").alias("user_id"), F.lit(LABELLED).alias("class"),
        F.lit(name).alias("class_name"), F.lit(f"EPSG:{srid}").alias("crs"), "transform", F.lit(source).alias("source"),
    )
