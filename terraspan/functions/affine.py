"""Affine pixel transforms x = a*col + b*row + c, y = d*col + e*row + f, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Affine:
    a: float
    b: float
    c: float
    d: float
    e: float
    f: float

    def xy(self, col: Column, row: Column) -> tuple[Column, Column]:
        return self.a * col + self.b * row + self.c, self.d * col + self.e * row + self.f

    def inverse(self) -> Affine:
        det = self.a * self.e - self.b * self.d
        if det == 0:
            raise ValueError("the transform can't be inverted")
        a, b, d, e = self.e / det, -self.b / det, -self.d / det, self.a / det
        return Affine(a, b, -(a * self.c + b * self.f), d, e, -(d * self.c + e * self.f))


def pixel_to_coords(row: Column, col: Column, t: Affine) -> tuple[Column, Column]:
    """World coordinates of a pixel's centre."""
    return t.xy(col + 0.5, row + 0.5)


def coords_to_pixel(x: Column, y: Column, t: Affine) -> tuple[Column, Column]:
    """(row, col) of the pixel that holds a point: floor of the inverse, no half-pixel shift."""
    col, row = t.inverse().xy(x, y)
    return F.floor(row), F.floor(col)
