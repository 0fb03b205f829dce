"""Connected pixels of a whole raster: labelled tile by tile, then joined across the tiles' borders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.functions import kernels as k
from terraspan.storage import stored


def connected(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex that each vertex of ``edges`` (a, b) reaches.

    Vertices take the smallest root among their neighbours' and their own, and
    then their root's root, until nothing changes; both steps are joins of narrow rows.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "neighbours")
    smallest = both.groupBy("a").agg(F.min("b").alias("m"))
    found = stored(smallest.select(F.col("a").alias("v"), F.least("a", "m").alias("root")), "roots")
    while True:
        around = both.join(found.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        step = found.join(around, "v").select("v", "root", F.least("root", "near").alias("next"))
        up = step.select(F.col("v").alias("next"), F.col("next").alias("top"))
        after = stored(step.join(up, "next").select("v", F.least("next", "top").alias("root"), (F.least("next", "top") != F.col("root")).alias("moved")), "roots")
        moved, found = not after.filter("moved").isEmpty(), after.select("v", "root")
        if not moved:
            return found


def components(pixels: DataFrame, tile: int, diagonal: bool = False) -> DataFrame:
    """(row, col, label) of the given pixels (row, col): touching ones share a label, over the whole raster.

    Tiles of ``tile`` x ``tile`` are labelled by themselves; labels that touch
    over a border are joined on the cluster. A label is its smallest pixel's number.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows, cols = group["row"].to_numpy(), group["col"].to_numpy()
        mask = np.zeros((np.ptp(rows) + 1, np.ptp(cols) + 1), bool)
        mask[rows - rows.min(), cols - cols.min()] = True
        labels, n = k.components(mask, diagonal)
        own = labels[rows - rows.min(), cols - cols.min()]
        number = rows.astype(np.int64) * (1 << 31) + cols
        first = np.full(n + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, own, number)
        return pd.DataFrame({"row": rows, "col": cols, "part": first[own]})

    at = lambda c: F.floor(F.col(c) / tile)
    parts = pixels.select(F.col("row").cast("long"), F.col("col").cast("long")).distinct().withColumns({"_r": at("row"), "_c": at("col")})
    parts = stored(parts.groupBy("_r", "_c").applyInPandas(run, "row long, col long, part long"), "parts")
    edge = lambda c: F.col(c) % tile == 0
    steps = [(-1, 0, edge("row")), (0, -1, edge("col"))]
    if diagonal:
        steps += [(-1, -1, edge("row") | edge("col")), (-1, 1, edge("row") | ((F.col("col") + 1) % tile == 0))]
    edges = None
    for dr, dc, border in steps:
        here = parts.filter(border).select((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.col("part").alias("a"))
        met = here.join(parts.withColumnRenamed("part", "b"), ["row", "col"]).filter("a != b").select("a", "b").distinct()
        edges = met if edges is None else edges.unionByName(met)
    roots = connected(edges)
    out = parts.join(roots, F.col("part") == F.col("v"), "left")
    return out.select("row", "col", F.coalesce("root", "part").alias("label"))
