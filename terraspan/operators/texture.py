"""Colour and texture of every pixel, for supervised weed candidates: tiles meet their neighbours, so values don't depend on the tiling."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.functions.kernels import gaussian

#: Planes that every feature is made of, from red, green and blue as parts of one.
PLANES = {
    "r": lambda r, g, b: r,
    "g": lambda r, g, b: g,
    "b": lambda r, g, b: b,
    "r_share": lambda r, g, b: r / (r + g + b + 1e-6),
    "b_share": lambda r, g, b: b / (r + g + b + 1e-6),
    "greenness": lambda r, g, b: (2 * g - r - b) / (r + g + b + 1e-6),
    "light": lambda r, g, b: (r + g + b + 1e-6) / 3,
    "saturation": lambda r, g, b: 1 - np.minimum(np.minimum(r, g), b) / (np.maximum(np.maximum(r, g), b) + 1e-6),
    "plant": lambda r, g, b: (PLANES["greenness"](r, g, b) > GREEN).astype(float),
}

#: Fixed value: greenness that counts as plant.
GREEN = 0.12


@dataclass(frozen=True)
class Feature:
    """``measure`` of a plane within ``width`` pixels: its value, mean, spread, contrast to the mean, or how far lines agree in direction."""

    plane: str
    measure: str = "value"
    width: float = 0

    @property
    def name(self) -> str:
        return f"{self.plane}_{self.measure}_{self.width:g}" if self.width else self.plane

    def reach(self) -> int:
        """Pixels around that it depends on: four widths, and those of the gradient."""
        return int(4 * self.width) + (6 if self.measure == "alignment" else 1)

    def of(self, planes: Planes) -> np.ndarray:
        own = planes[self.plane]
        if self.measure == "value":
            return own
        if self.measure == "alignment":
            across, power = planes.lines(self.plane)
            field = gaussian(across.real, self.width) + 1j * gaussian(across.imag, self.width)
            return np.abs(field) / (gaussian(power, self.width) + 1e-6)
        mean = planes.mean(self.plane, self.width)
        if self.measure == "mean":
            return mean
        if self.measure == "contrast":
            return own - mean
        return np.sqrt(np.maximum(gaussian(own * own, self.width) - mean * mean, 0))


class Planes(dict):
    """The planes of an image [3, row, col] of 0 to 255, each made when it is asked for, and what features share."""

    def __init__(self, rgb: np.ndarray):
        super().__init__()
        self.rgb, self.means = rgb.astype(np.float64) / 255, {}

    def __missing__(self, name: str) -> np.ndarray:
        self[name] = PLANES[name](*self.rgb)
        return self[name]

    def mean(self, name: str, width: float) -> np.ndarray:
        if (name, width) not in self.means:
            self.means[name, width] = gaussian(self[name], width)
        return self.means[name, width]

    def lines(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """The squared gradient of the smoothed plane as a complex number, and its power."""
        down, right = np.gradient(self.mean(name, 1))
        return (right + 1j * down) ** 2, right**2 + down**2


# Widths in pixels of the fine texture, of the alignment and of the context.
FINE, ALIGNMENT, WIDE = (1, 3, 6), 5, (10, 20)
#: The features of every pixel, and those of its context.
OWN = (
    *(Feature(p) for p in ("light", "greenness", "saturation", "r", "g", "b", "r_share", "b_share")),
    *(Feature(p, m, w) for m in ("mean", "spread") for p in ("greenness", "light") for w in FINE),
    Feature("greenness", "alignment", ALIGNMENT),
)
CONTEXT = tuple(Feature(p, m, w) for p, m in (("plant", "mean"), ("greenness", "mean"), ("greenness", "contrast"), ("light", "contrast"), ("greenness", "alignment")) for w in WIDE)


def table(context: bool = False) -> tuple[Feature, ...]:
    return OWN + CONTEXT if context else OWN


def features(rgb: np.ndarray, context: bool = False) -> np.ndarray:
    """[feature, row, col], in the order of ``table``."""
    planes = Planes(rgb)
    return np.stack([f.of(planes) for f in table(context)])


SCHEMA = "path string, row_off int, col_off int, h int, w int, features array<binary>"


def tile_features(tiles: DataFrame, size: int, context: bool = False) -> DataFrame:
    """Features of tiles (path, row_off, col_off, h, w, bands), each a float32 grid, as if the raster were one image.

    Tiles lie on a grid of ``size``; each is sent to its eight neighbours, so a task sees nine tiles at once.
    """
    halo = max(f.reach() for f in table(context))
    if size < halo:
        raise ValueError(f"tiles of {halo} pixels at least are needed")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = group[(group["row_off"] == group["to_row"]) & (group["col_off"] == group["to_col"])]
        if not len(own):  # neighbours of a tile that isn't there
            return pd.DataFrame([], columns=names)
        t = own.iloc[0]
        r0, c0 = max(group["row_off"].min(), t.row_off - halo), max(group["col_off"].min(), t.col_off - halo)
        r1 = min((group["row_off"] + group["h"]).max(), t.row_off + t.h + halo)
        c1 = min((group["col_off"] + group["w"]).max(), t.col_off + t.w + halo)
        image = np.zeros((3, r1 - r0, c1 - c0))
        for p in group.itertuples(index=False):
            bands = [np.frombuffer(b, "<f8").reshape(p.h, p.w) for b in p.bands]
            top, left, bottom, right = max(r0, p.row_off), max(c0, p.col_off), min(r1, p.row_off + p.h), min(c1, p.col_off + p.w)
            if top < bottom and left < right:
                part = np.stack([bands[min(i, len(bands) - 1)] for i in range(3)])
                image[:, top - r0 : bottom - r0, left - c0 : right - c0] = part[:, top - p.row_off : bottom - p.row_off, left - p.col_off : right - p.col_off]
        inner = features(image, context)[:, t.row_off - r0 : t.row_off - r0 + t.h, t.col_off - c0 : t.col_off - c0 + t.w]
        return pd.DataFrame([(t.path, t.row_off, t.col_off, t.h, t.w, [f.astype("<f4").tobytes() for f in inner])], columns=names)

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    around = F.array(*[F.struct(F.lit(r * size).alias("r"), F.lit(c * size).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1)])
    sent = tiles.select("path", "row_off", "col_off", "h", "w", "bands", F.explode(around).alias("_to"))
    sent = sent.withColumns({"to_row": F.col("row_off") + F.col("_to.r"), "to_col": F.col("col_off") + F.col("_to.c")}).drop("_to")
    return sent.filter("to_row >= 0 and to_col >= 0").groupBy("path", "to_row", "to_col").applyInPandas(run, SCHEMA)
