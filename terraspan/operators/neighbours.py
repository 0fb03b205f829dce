"""Neighbourhoods on pixel tables (row, col and one column a band): smoothing over tiles with their surroundings, and values between pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraspan.functions import kernels as k


def smoothed(pixels: DataFrame, value: str, sigma: float, height: int, width: int, tile: int = 512) -> DataFrame:
    """``pixels`` with ``smooth``: a Gaussian over the whole raster, mirrored at its edges; missing pixels and null values count as 0.

    A pixel goes to its own tile and to those whose surroundings (four sigmas)
    hold it. All columns travel, so the table should be narrow.
    """
    reach = int(4 * sigma + 0.5)
    schema = T.StructType([*pixels.schema.fields, T.StructField("smooth", T.DoubleType())])

    def run(key: tuple[int, int], group: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = max(0, key[0] * tile - reach), max(0, key[1] * tile - reach)
        grid = np.zeros((min(height, (key[0] + 1) * tile + reach) - r0, min(width, (key[1] + 1) * tile + reach) - c0))
        grid[group["row"] - r0, group["col"] - c0] = group[value].fillna(0).astype(float)
        own = group[(group["row"] // tile == key[0]) & (group["col"] // tile == key[1])]
        return own.assign(smooth=k.gaussian(grid, sigma)[own["row"] - r0, own["col"] - c0])[schema.names] if len(own) else pd.DataFrame([], columns=schema.names)

    def tiles(c: str, n: int):
        at = lambda v: F.floor(v / tile)
        return F.explode(F.sequence(F.greatest(at(F.col(c) - reach), F.lit(0)), F.least(at(F.col(c) + reach), F.lit((n - 1) // tile))))

    inside = pixels.filter(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    return inside.withColumn("_r", tiles("row", height)).withColumn("_c", tiles("col", width)).groupBy("_r", "_c").applyInPandas(run, schema)


def bilinear(places: DataFrame, pixels: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """(keys, bands) at places (keys, row and col as fractions, a pixel's centre at +0.5), between the four nearest pixels.

    Pixels that are missing or null give their share to the others; a place without any has no row.
    """
    top, left = F.floor(F.col("row") - 0.5), F.floor(F.col("col") - 0.5)
    down, right = F.col("row") - 0.5 - top, F.col("col") - 0.5 - left
    corner = lambda r, c: F.struct((top + r).alias("r"), (left + c).alias("c"), ((down if r else 1 - down) * (right if c else 1 - right)).alias("w"))
    met = places.select(*keys, F.explode(F.array(*[corner(r, c) for r in (0, 1) for c in (0, 1)])).alias("_p")).filter("_p.w > 0")
    met = met.select(*keys, F.col("_p.r").alias("row"), F.col("_p.c").alias("col"), F.col("_p.w").alias("_w")).join(pixels.select("row", "col", *bands), ["row", "col"])
    share = lambda b: F.try_divide(F.sum(F.col("_w") * F.col(b)), F.sum(F.when(F.col(b).isNotNull(), F.col("_w"))))
    return met.groupBy(*keys).agg(*[share(b).alias(b) for b in bands])
