"""A raster on another grid: coarser, finer, shifted or rotated, in the same reference system."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.functions.affine import Affine
from terraspan.functions.kernels import sample

SCHEMA = "path string, row_off int, col_off int, h int, w int, bands array<binary>, valid binary"


def matrix(t: Affine) -> np.ndarray:
    return np.array([[t.a, t.b, t.c], [t.d, t.e, t.f], [0, 0, 1]], float)


def regrid(tiles: DataFrame, source: Affine, target: Affine, width: int, height: int, size: int, nearest: bool = False) -> DataFrame:
    """Tiles (path, row_off, col_off, h, w, bands) sampled at the pixel centres of a target grid of ``width`` x ``height``.

    Bilinear unless ``nearest``. ``valid`` marks target pixels whose centre
    lies on the source's pixels; others are 0. Each source tile goes only to
    the target tiles that its box, grown by a pixel, can touch, so a task sees
    one target tile and the source around it. A target tile without source has no row.
    """
    there = np.linalg.inv(matrix(target)) @ matrix(source)  # source (col, row) corners to target ones
    back = np.linalg.inv(there)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ty, tx = int(group["_ty"].iloc[0]) * size, int(group["_tx"].iloc[0]) * size
        h, w = min(size, height - ty), min(size, width - tx)
        r0, c0 = int(group["row_off"].min()), int(group["col_off"].min())
        shape = (int((group["row_off"] + group["h"]).max()) - r0, int((group["col_off"] + group["w"]).max()) - c0)
        image, known = np.zeros((len(group["bands"].iloc[0]), *shape)), np.zeros(shape, bool)
        for p in group.itertuples(index=False):
            at = (slice(p.row_off - r0, p.row_off - r0 + p.h), slice(p.col_off - c0, p.col_off - c0 + p.w))
            known[at] = True
            for band, b in zip(image, p.bands, strict=True):
                band[at] = np.frombuffer(b, "<f8").reshape(p.h, p.w)
        y, x = np.meshgrid(ty + np.arange(h) + 0.5, tx + np.arange(w) + 0.5, indexing="ij")
        sx = back[0, 0] * x + back[0, 1] * y + back[0, 2] - c0
        sy = back[1, 0] * x + back[1, 1] * y + back[1, 2] - r0
        inside = (sx >= 0) & (sy >= 0) & (sx < shape[1]) & (sy < shape[0])
        inside[inside] = known[np.floor(sy[inside]).astype(int), np.floor(sx[inside]).astype(int)]
        at = np.clip(sy - 0.5, 0, shape[0] - 1), np.clip(sx - 0.5, 0, shape[1] - 1)  # centres of pixels are whole numbers here
        bands = [np.where(inside, sample(b, *at, nearest), 0.0).astype("<f8").tobytes() for b in image]
        rows = [(group["path"].iloc[0], ty, tx, h, w, bands, inside.astype(np.uint8).tobytes())] if inside.any() else []
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    grown = lambda name, extent: ((F.col(f"{name}_off") - 1).cast("double"), (F.col(f"{name}_off") + F.col(extent) + 1).cast("double"))
    corners = [(c, r) for c in grown("col", "w") for r in grown("row", "h")]
    u = [c * float(there[0, 0]) + r * float(there[0, 1]) + float(there[0, 2]) for c, r in corners]
    v = [c * float(there[1, 0]) + r * float(there[1, 1]) + float(there[1, 2]) for c, r in corners]
    # limited to the target grid; an empty range is no row
    low = lambda p: F.greatest(F.floor(F.least(*p) / size), F.lit(0))
    high = lambda p, n: F.least(F.floor(F.greatest(*p) / size), F.lit((n - 1) // size))
    span = lambda p, n: F.when(low(p) <= high(p, n), F.sequence(low(p), high(p, n)))
    sent = tiles.select("path", "row_off", "col_off", "h", "w", "bands", F.explode(span(u, width)).alias("_tx"), span(v, height).alias("_rows"))
    sent = sent.withColumn("_ty", F.explode("_rows")).drop("_rows")
    return sent.groupBy("path", "_ty", "_tx").applyInPandas(run, SCHEMA)
