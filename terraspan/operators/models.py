"""Detection over rasters with any scorer. Weights aren't shipped: a scorer is a function from an image to boxes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.functions.affine import Affine, pixel_to_coords
from terraspan.functions.detections import corners
from terraspan.functions.kernels import components

from .nms import BOX, suppress

#: An image (height, width, 3) -> (class, confidence, x1, y1, x2, y2) in its pixels.
Scorer = Callable[[np.ndarray], list[tuple[str, float, float, float, float, float]]]

BOXES = "path string, class string, conf double, x1 double, y1 double, x2 double, y2 double"


def three_bands(bands: list[np.ndarray]) -> np.ndarray:
    """The first three bands, the first one three times where there are fewer, channels last."""
    chosen = bands[:3] if len(bands) >= 3 else [bands[0]] * 3
    return np.stack(chosen, axis=-1)


def bright_spots(image: np.ndarray, least: float = 200.0) -> list[tuple[str, float, float, float, float, float]]:
    """A scorer for tests: a box around each bright component."""
    labels, n = components(image[..., 0] >= least)
    out = []
    for i in range(1, n + 1):
        ys, xs = np.nonzero(labels == i)
        out.append(("planta", float(min(1.0, image[ys, xs, 0].mean() / 255)), float(xs.min()), float(ys.min()), float(xs.max() + 1), float(ys.max() + 1)))
    return out


def predict_tiles(tiles: DataFrame, scorer: Scorer, conf: float = 0.25) -> DataFrame:
    """Boxes of all tiles (path, row_off, col_off, h, w, bands) in the raster's pixels; overlapping tiles may repeat them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for t in frame.itertuples(index=False):
                image = three_bands([np.frombuffer(b, "<f8").reshape(t.h, t.w) for b in t.bands])
                rows += [(t.path, c, p, x1 + t.col_off, y1 + t.row_off, x2 + t.col_off, y2 + t.row_off) for c, p, x1, y1, x2, y2 in scorer(image) if p >= conf]
            yield pd.DataFrame(rows, columns=["path", "class", "conf", *BOX])

    return tiles.mapInPandas(run, BOXES)


def predict_raster(tiles: DataFrame, scorer: Scorer, t: Affine, conf: float = 0.25, iou: float = 0.45, cell: float = 512.0) -> DataFrame:
    """Boxes after suppression, with the world position of their centres (x, y) and corners (bbox_geo)."""
    found = predict_tiles(tiles, scorer, conf).withColumn("id", F.xxhash64("path", "class", "conf", *BOX)).dropDuplicates(["id"])
    kept = suppress(found, iou, cell)
    x, y = pixel_to_coords((F.col("y1") + F.col("y2")) / 2, (F.col("x1") + F.col("x2")) / 2, t)
    return kept.withColumns({"x": x, "y": y, "bbox_geo": corners(*[F.col(c) for c in BOX], t)})
