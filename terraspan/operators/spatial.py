"""Spatial joins and overlays as equi-joins on grid cells with an exact test behind them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraspan.functions import geometry as g
from terraspan.functions import kernels as k


#: Rows of one place that travel as one through a join of pairs.
PACK = 1024


class CrsMismatchError(ValueError):
    """Two layers have different reference systems."""


def verify_crs(left: str | None, right: str | None) -> None:
    if left != right:
        raise CrsMismatchError(f"layers in {left} and {right} can't be joined")


def _cells(df: DataFrame, box: tuple[Column, Column, Column, Column], cell: float) -> DataFrame:
    """A row for each grid cell that a box touches: columns _cx, _cy."""
    at = lambda v: F.floor(v / cell)
    return df.withColumn("_cx", F.explode(F.sequence(at(box[0]), at(box[2])))).withColumn("_cy", F.explode(F.sequence(at(box[1]), at(box[3]))))


def _packed(df: DataFrame, place: list[str], name: str) -> DataFrame:
    """Rows that agree in ``place`` as one, with their other columns as structs in the array ``name``; those without a place go.

    Beyond PACK rows a place is several rows, so that none grows with the input and a join can spread them.
    """
    there = df.filter(" and ".join(f"{c} is not null" for c in place))
    pack = F.floor((F.row_number().over(Window.partitionBy(*place).orderBy(*place)) - 1) / PACK)
    others = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in place])
    return there.select(*place, others.alias(name), pack.alias("_pack")).groupBy(*place, "_pack").agg(F.collect_list(name).alias(name)).drop("_pack")


def _unpacked(pairs: DataFrame, sides: list[tuple[DataFrame, list[str], str]], more: list[str]) -> DataFrame:
    """Pairs of packed rows as pairs of rows: all columns of each side as they were, then ``more``."""
    columns = [F.col(c) if c in place else F.col(name)[c].alias(c) for df, place, name in sides for c in df.columns]
    for _, _, name in sides:
        pairs = pairs.withColumn(name, F.explode(name))
    return pairs.select(*columns, *more)


def points_within(points: DataFrame, polygons: DataFrame, cell: float, x: str = "x", y: str = "y", ring: str = "ring") -> DataFrame:
    """Inner join: a row for each point strictly inside a polygon (twice for a point in two). Both sides' columns must differ in name.

    ``cell`` should be about the size of a polygon: a polygon then takes few
    rows, and each point meets only those of its own cell. A crowded cell is
    split by adaptive execution, as its join is a plain equi-join.
    """
    tiles = _cells(polygons, g.bounds(F.col(ring)), cell)
    placed = points.withColumn("_cx", F.floor(F.col(x) / cell)).withColumn("_cy", F.floor(F.col(y) / cell))
    return placed.join(tiles, ["_cx", "_cy"]).filter(g.within(F.col(x), F.col(y), F.col(ring))).drop("_cx", "_cy")


def count_points(points: DataFrame, polygons: DataFrame, id_col: str, cell: float, crs: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """(id as string, n) for every polygon, 0 without points; polygons that share an id share its total.

    With no points or no polygons the reference systems needn't agree.
    """
    if crs[0] != crs[1] and not points.isEmpty() and not polygons.isEmpty():
        verify_crs(*crs)
    key = F.col(id_col).cast("string").alias("id")
    found = points_within(points, polygons.select(F.col(id_col), "ring"), cell).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return polygons.select(key).distinct().join(found, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def overlay_boxes(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """Pairs of boxes (x1, y1, x2, y2 and rx1, ry1, rx2, ry2) that share area, with their intersection ix1..iy2 and its area.

    Two boxes may share many cells; the pair counts only in the cell of their intersection's lower corner.
    Equal boxes are compared once, whatever their number.
    """
    sides = [(left, ["x1", "y1", "x2", "y2"], "_a"), (right, ["rx1", "ry1", "rx2", "ry2"], "_b")]
    a, b = (_cells(_packed(*side), tuple(F.col(c) for c in side[1]), cell) for side in sides)
    pairs = a.join(b.hint("merge"), ["_cx", "_cy"])  # as in _near
    low = [F.greatest("x1", "rx1"), F.greatest("y1", "ry1")]
    pairs = pairs.filter((F.floor(low[0] / cell) == F.col("_cx")) & (F.floor(low[1] / cell) == F.col("_cy")))
    pairs = pairs.withColumns({"ix1": low[0], "iy1": low[1], "ix2": F.least("x2", "rx2"), "iy2": F.least("y2", "ry2")})
    pairs = pairs.filter("ix1 < ix2 and iy1 < iy2").withColumn("overlap", (F.col("ix2") - F.col("ix1")) * (F.col("iy2") - F.col("iy1")))
    return _unpacked(pairs, sides, ["ix1", "iy1", "ix2", "iy2", "overlap"])


def near(points: DataFrame, others: DataFrame, distance: float) -> DataFrame:
    """Pairs of points (x, y) and (ox, oy) less than ``distance`` apart: others are dealt to the nine cells around theirs.

    Places are compared once each, whatever the number of rows there.
    """
    sides = [(points, ["x", "y"], "_a"), (others, ["ox", "oy"], "_b")]
    return _unpacked(_near(*(_packed(*side) for side in sides), distance), sides, ["distance"])


def _near(points: DataFrame, others: DataFrame, distance: float) -> DataFrame:
    at = lambda v: F.floor(F.col(v) / distance)
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    spread = others.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
    spread = spread.withColumn("_cx", at("ox") + F.col("_dx")).withColumn("_cy", at("oy") + F.col("_dy")).drop("_dx", "_dy")
    # Spark's estimate of a table's size doesn't know of the nine copies, so it would broadcast what the driver can't hold
    pairs = points.withColumn("_cx", at("x")).withColumn("_cy", at("y")).join(spread.hint("merge"), ["_cx", "_cy"])
    return pairs.withColumn("distance", F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))).filter(F.col("distance") < distance).drop("_cx", "_cy")


def split_by_area(polygons: DataFrame, max_area: float) -> DataFrame:
    """Boxes (id, x1, y1, x2, y2) cut into a grid of pieces of at most ``max_area``, row-major, labelled id.k; small ones keep their label."""
    side = max_area**0.5
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    big = w * h > max_area
    nx, ny = F.when(big, F.ceil(w / side)).otherwise(1), F.when(big, F.ceil(h / side)).otherwise(1)
    out = polygons.withColumns({"nx": nx.cast("int"), "ny": ny.cast("int")})
    out = out.withColumn("iy", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    k = F.col("iy") * F.col("nx") + F.col("ix") + 1
    label = F.when(F.col("nx") * F.col("ny") > 1, F.concat_ws(".", F.col("id").cast("string"), k.cast("string"))).otherwise(F.col("id").cast("string"))
    dw, dh = (F.col("x2") - F.col("x1")) / F.col("nx"), (F.col("y2") - F.col("y1")) / F.col("ny")
    return out.select(
        "id", label.alias("piece"), (F.col("x1") + F.col("ix") * dw).alias("px1"), (F.col("y1") + F.col("iy") * dh).alias("py1"),
        (F.col("x1") + (F.col("ix") + 1) * dw).alias("px2"), (F.col("y1") + (F.col("iy") + 1) * dh).alias("py2"),
    )


def covered_area(labels: DataFrame, boxes: DataFrame, key: str, cell: float) -> DataFrame:
    """(key, covered): the area of each label (rx1, ry1, rx2, ry2) that lies in the union of ``boxes`` (x1, y1, x2, y2); labels without any have no row.

    Shared pieces are cut at the borders of grid cells, so that a task sees one
    label's pieces of one cell at a time; their areas add up.
    """
    own = _cells(labels.select(key, "rx1", "ry1", "rx2", "ry2"), tuple(F.col(c) for c in ("rx1", "ry1", "rx2", "ry2")), cell)
    others = _cells(boxes.select("x1", "y1", "x2", "y2").distinct(), tuple(F.col(c) for c in ("x1", "y1", "x2", "y2")), cell)
    west, south = F.col("_cx") * cell, F.col("_cy") * cell
    pieces = own.join(others, ["_cx", "_cy"]).select(
        key, "_cx", "_cy", F.greatest("rx1", "x1", west).alias("x1"), F.greatest("ry1", "y1", south).alias("y1"), F.least("rx2", "x2", west + cell).alias("x2"), F.least("ry2", "y2", south + cell).alias("y2")
    )
    met = pieces.filter("x1 < x2 and y1 < y2").groupBy(key, "_cx", "_cy").agg(*[F.collect_list(F.col(c).cast("double")).alias(c) for c in ("x1", "y1", "x2", "y2")])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "covered": [union_of_boxes(*(np.array(v) for v in r)) for r in zip(frame["x1"], frame["y1"], frame["x2"], frame["y2"], strict=True)]})

    kind = labels.schema[key].dataType.simpleString()
    return met.mapInPandas(run, f"`{key}` {kind}, covered double").groupBy(key).agg(F.sum("covered").alias("covered"))


def union_of_boxes(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> float:
    """Area that some box covers: boxes marked on the grid of all their borders."""
    xs, ys = np.unique(np.concatenate([x1, x2])), np.unique(np.concatenate([y1, y2]))
    marks = np.zeros((len(xs) + 1, len(ys) + 1), np.int64)
    a, b, c, d = np.searchsorted(xs, x1), np.searchsorted(xs, x2), np.searchsorted(ys, y1), np.searchsorted(ys, y2)
    for i, j, sign in ((a, c, 1), (b, c, -1), (a, d, -1), (b, d, 1)):
        np.add.at(marks, (i, j), sign)
    covered = marks.cumsum(axis=0).cumsum(axis=1)[: len(xs) - 1, : len(ys) - 1] > 0
    return float(np.diff(xs) @ covered @ np.diff(ys))


def nearest(points: DataFrame, others: DataFrame, key: str, limit: float) -> DataFrame:
    """``points`` (key, x, y and more) with ``distance`` to the nearest of ``others`` (ox, oy) less than ``limit`` away; null where there is none.

    Only different places are compared, then their distances go to the rows there; rows that share a key share the least distance.
    """
    places = _near(points.select("x", "y").distinct(), others.select("ox", "oy").distinct(), limit).groupBy("x", "y").agg(F.min("distance").alias("distance"))
    # merge joins: a shuffled table looks small by its compressed bytes, and would be broadcast
    found = points.select(key, "x", "y").join(places.hint("merge"), ["x", "y"]).groupBy(F.col(key).alias("_k")).agg(F.min("distance").alias("distance"))
    return points.join(found.hint("merge"), F.col(key) == F.col("_k"), "left").drop("_k")


def rasterised(polygons: DataFrame, key: str, size: float) -> DataFrame:
    """(key, row, col) of the pixels of a grid whose centres lie strictly inside a polygon (ring); row and col count up with y and x."""
    low, high = (lambda v: F.floor(v / size - 0.5).cast("long")), (lambda v: F.ceil(v / size - 0.5).cast("long"))
    x1, y1, x2, y2 = g.bounds(F.col("ring"))
    cells = polygons.select(key, "ring", F.sequence(low(x1), high(x2)).alias("_cols"), F.explode(F.sequence(low(y1), high(y2))).alias("row")).withColumn("col", F.explode("_cols"))
    return cells.filter(g.within((F.col("col") + 0.5) * size, (F.col("row") + 0.5) * size, F.col("ring"))).select(key, "row", "col")


def lines_within(lines: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """A row for each part of a line (path: array of x, y) inside a polygon (ring), with both sides' columns, the part's ``path`` and ``length``."""
    box = lambda c: F.struct(*[v.alias(n) for v, n in zip(g.bounds(F.col(c)), ("x1", "y1", "x2", "y2"), strict=True)])
    corners = lambda c: tuple(F.col(f"{c}.{n}") for n in ("x1", "y1", "x2", "y2"))
    a, b = _cells(lines.withColumn("_a", box("path")), corners("_a"), cell), _cells(polygons.withColumn("_b", box("ring")), corners("_b"), cell)
    x, y = F.greatest("_a.x1", "_b.x1"), F.greatest("_a.y1", "_b.y1")
    pairs = a.join(b, ["_cx", "_cy"]).filter((F.floor(x / cell) == F.col("_cx")) & (F.floor(y / cell) == F.col("_cy"))).drop("_cx", "_cy", "_a", "_b")
    schema = T.StructType([*[f for f in pairs.schema.fields if f.name not in ("path", "length", "ring")], pairs.schema["path"], T.StructField("length", T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        arrays = lambda points: np.array([(p["x"], p["y"]) for p in points], float)
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                for p in k.clip_path(arrays(row["path"]), [arrays(row["ring"])]):
                    rows.append(row | {"path": [{"x": x, "y": y} for x, y in p.tolist()], "length": k.path_length(p)})
            yield pd.DataFrame(rows, columns=schema.names)

    return pairs.mapInPandas(run, schema)
