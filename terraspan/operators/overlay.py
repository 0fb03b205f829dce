"""Overlays of polygon layers: intersection, difference, union, buffers and repair, dealt by grid cells.

A layer has ``rings`` (array of rings of x, y; even-odd, so holes and several
parts are rings like any other). Results that join pieces of different
polygons come cell by cell: their areas add up, and no task sees more than
the polygons of one cell. ``cell`` should be about the size of a polygon.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraspan.functions import polygons as pg

from .spatial import _cells, verify_crs

RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))


def to_shape(rings) -> pg.Shape:
    """Rings of a row as arrays; null is an empty shape."""
    return [np.array([(p["x"], p["y"]) for p in r], float).reshape(-1, 2) for r in rings] if rings is not None else []


def from_shape(shape: pg.Shape) -> list:
    return [[{"x": x, "y": y} for x, y in r.tolist()] for r in shape]


def ring_bounds(rings: Column) -> tuple[Column, Column, Column, Column]:
    """(x1, y1, x2, y2) of all rings."""
    flat = F.flatten(rings)
    x, y = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)


def _with_shape(schema: T.StructType, drop: tuple[str, ...] = ("rings",)) -> T.StructType:
    own = [f for f in schema.fields if f.name not in (*drop, "area")]
    return T.StructType([*own, T.StructField("rings", RINGS), T.StructField("area", T.DoubleType())])


def reshape(layer: DataFrame, change: Callable[[pg.Shape], pg.Shape]) -> DataFrame:
    """``layer`` with ``rings`` changed row by row and their ``area``; rows left with nothing stay, with no rings and area 0."""
    schema = _with_shape(layer.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            shapes = [change(to_shape(r)) for r in frame["rings"]]
            yield frame.assign(rings=[from_shape(s) for s in shapes], area=[pg.area(s) for s in shapes])[schema.names]

    return layer.mapInPandas(run, schema)


def buffered(layer: DataFrame, distance: float) -> DataFrame:
    """Grown or shrunk by ``distance`` in the layer's own units; attributes are kept."""
    return reshape(layer, lambda s: pg.buffer(s, distance))


def repaired(layer: DataFrame) -> DataFrame:
    """Self-crossing rings rebuilt as simple ones that enclose the same places; a ring that encloses nothing is an error in the caller's sight (area 0)."""
    return reshape(layer, pg.repair)


def intersections(left: DataFrame, right: DataFrame, cell: float, crs: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """A row for each pair of polygons that share area, with the attributes of both, the shared ``rings`` and ``area``.

    Names on both sides get _1 and _2. A pair that shares several cells is met in that of its boxes' common lower corner only.
    """
    verify_crs(*crs)
    both = (set(left.columns) & set(right.columns)) - {"rings"}
    a = left.select(*[F.col(c).alias(f"{c}_1" if c in both else c) for c in left.columns])
    b = right.select(*[F.col(c).alias(f"{c}_2" if c in both else c) for c in right.columns if c != "rings"], F.col("rings").alias("_rings"))
    box = lambda c: F.struct(*[v.alias(n) for v, n in zip(ring_bounds(F.col(c)), ("x1", "y1", "x2", "y2"), strict=True)])
    corners = lambda c: tuple(F.col(f"{c}.{n}") for n in ("x1", "y1", "x2", "y2"))
    a, b = _cells(a.withColumn("_a", box("rings")), corners("_a"), cell), _cells(b.withColumn("_b", box("_rings")), corners("_b"), cell)
    x, y = F.greatest("_a.x1", "_b.x1"), F.greatest("_a.y1", "_b.y1")
    pairs = a.join(b, ["_cx", "_cy"]).filter((F.floor(x / cell) == F.col("_cx")) & (F.floor(y / cell) == F.col("_cy")))
    pairs = pairs.filter((x < F.least("_a.x2", "_b.x2")) & (y < F.least("_a.y2", "_b.y2"))).drop("_cx", "_cy", "_a", "_b")
    schema = _with_shape(pairs.schema, ("rings", "_rings"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            shapes = [pg.intersection(to_shape(p), to_shape(q)) for p, q in zip(frame["rings"], frame["_rings"], strict=True)]
            out = frame.assign(rings=[from_shape(s) for s in shapes], area=[pg.area(s) for s in shapes])
            yield out[out["area"] > 0][schema.names]

    return pairs.mapInPandas(run, schema)


def _dealt(layer: DataFrame, cell: float) -> DataFrame:
    return _cells(layer, ring_bounds(F.col("rings")), cell)


def _square(group: pd.DataFrame, cell: float) -> pg.Shape:
    x, y = group["_cx"].iloc[0] * cell, group["_cy"].iloc[0] * cell
    return [np.array([(x, y), (x + cell, y), (x + cell, y + cell), (x, y + cell)], float)]


def dissolved(layer: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """The union of each key's polygons as a piece a cell: keys, rings, area."""
    schema = T.StructType([*[layer.schema[k] for k in keys], T.StructField("rings", RINGS), T.StructField("area", T.DoubleType())])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        square = _square(group, cell)
        shape = pg.combine([square, *map(to_shape, group["rings"])], lambda inside: inside[0] & inside[1:].any(axis=0))
        out = pd.DataFrame([(*[group[k].iloc[0] for k in keys], from_shape(shape), pg.area(shape))], columns=schema.names)
        return out[out["area"] > 0]

    # equal polygons are one in a union
    rows = _dealt(layer.select(*keys, "rings").distinct(), cell)
    return rows.groupBy(*keys, "_cx", "_cy").applyInPandas(run, schema)


def differences(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """What is left of each polygon outside all of ``right``, as a piece a cell, with the attributes of ``left``."""
    schema = _with_shape(left.schema)

    def run(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame([], columns=schema.names)
        square, cut = _square(own, cell), [to_shape(r) for r in others["rings"]]
        shapes = [pg.combine([square, to_shape(r), *cut], lambda inside: inside[0] & inside[1] & ~inside[2:].any(axis=0)) for r in own["rings"]]
        out = own.assign(rings=[from_shape(s) for s in shapes], area=[pg.area(s) for s in shapes])
        return out[out["area"] > 0][schema.names]

    a, b = _dealt(left, cell), _dealt(right.select("rings").distinct(), cell)
    return a.groupBy("_cx", "_cy").cogroup(b.groupBy("_cx", "_cy")).applyInPandas(run, schema)
