"""Planar geometry on rings: array<struct<x double, y double>>, closed or not, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring(*points: tuple[Column, Column]) -> Column:
    return F.array(*[point(x, y) for x, y in points])


def _edges(r: Column) -> Column:
    """Segments of a ring, the closing one included (of no length if the ring repeats its first point)."""
    after = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    return F.zip_with(r, after, lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def signed_area(r: Column) -> Column:
    return _sum(F.transform(_edges(r), lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"])) / 2


def area(r: Column) -> Column:
    """Null rings have area 0."""
    return F.coalesce(F.abs(signed_area(r)), F.lit(0.0))


def perimeter(r: Column) -> Column:
    return F.coalesce(_sum(F.transform(_edges(r), lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))), F.lit(0.0))


def centroid(r: Column) -> Column:
    cross = lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]
    six = 6 * signed_area(r)
    x = F.try_divide(_sum(F.transform(_edges(r), lambda e: (e["x1"] + e["x2"]) * cross(e))), six)
    y = F.try_divide(_sum(F.transform(_edges(r), lambda e: (e["y1"] + e["y2"]) * cross(e))), six)
    return F.struct(x.alias("x"), y.alias("y"))


def bounds(r: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def within(x: Column, y: Column, r: Column) -> Column:
    """Whether a point lies strictly inside: the even-odd rule, points on an edge or a vertex excluded."""
    edges = _edges(r)
    on = F.exists(
        edges,
        lambda e: ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"]))
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])),
    )
    crosses = lambda e: F.when(
        ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]), 1
    ).otherwise(0)
    odd = F.aggregate(F.transform(edges, crosses), F.lit(0), lambda a, b: a + b) % 2 == 1
    return odd & ~on


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def box_overlap(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Area that two boxes (x1, y1, x2, y2) share."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    return w * h


def iou(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    size = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    both = box_overlap(a, b)
    return F.coalesce(F.try_divide(both, size(a) + size(b) - both), F.lit(0.0))


def angle_between(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """Unsigned angle of two directions in degrees, from 0 to 90."""
    dot = F.abs(F.try_divide(ux * vx + uy * vy, F.hypot(ux, uy) * F.hypot(vx, vy)))
    return F.degrees(F.acos(F.least(F.lit(1.0), F.coalesce(dot, F.lit(1.0)))))


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of a point's UTM zone; coordinates are clamped to the globe, zones have no exceptions."""
    lon = F.least(F.lit(180.0), F.greatest(F.lit(-180.0), lon))
    lat = F.least(F.lit(90.0), F.greatest(F.lit(-90.0), lat))
    zone = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60))
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("int")


def utm_xy(lon: Column, lat: Column, epsg: Column) -> Column:
    """Easting and northing on WGS84 by the Krueger series to the third order."""
    a, flat, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = flat / (2 - flat)
    rect = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    ecc = 2 * math.sqrt(n) / (1 + n)
    zone = epsg % 100
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - ecc * F.atanh(ecc * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    south = F.when((epsg >= 32700), 10_000_000.0).otherwise(0.0)
    return F.struct((500_000.0 + k0 * rect * east).alias("x"), (south + k0 * rect * north).alias("y"))


def project_ring(r: Column, epsg: Column) -> Column:
    """A lon/lat ring in UTM."""
    return F.transform(r, lambda p: utm_xy(p["x"], p["y"], epsg))


def metric_ring(r: Column) -> Column:
    """A lon/lat ring in the UTM zone of its own centroid."""
    c = centroid(r)
    return project_ring(r, utm_epsg(c["x"], c["y"]))


def ellipsoid_area(outer: Column, holes: Column | None = None) -> Column:
    """Square metres on the WGS84 ellipsoid of a lon/lat ring less its holes: the shoelace in the equal-area plane."""
    a, flat = 6378137.0, 1 / 298.257223563
    e = math.sqrt(flat * (2 - flat))

    def plane(r: Column) -> Column:
        def at(p: Column) -> Column:
            s = F.sin(F.radians(p["y"]))
            q = (1 - e * e) * (s / (1 - e * e * s * s) + F.atanh(e * s) / e)
            return F.struct(F.radians(p["x"]).alias("x"), (a * a / 2 * q).alias("y"))

        return F.transform(r, at)

    total = area(plane(outer))
    return total if holes is None else total - F.aggregate(F.transform(holes, lambda h: area(plane(h))), F.lit(0.0), lambda x, y: x + y)


def is_simple(r: Column) -> Column:
    """Whether no two edges that aren't neighbours meet; null rings aren't."""
    edges = F.filter(_edges(r), lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))
    numbered = F.transform(edges, lambda e, i: F.struct(e["x1"].alias("x1"), e["y1"].alias("y1"), e["x2"].alias("x2"), e["y2"].alias("y2"), i.alias("i")))
    side = lambda e, x, y: F.signum((e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]))

    def meet(p: Column, q: Column) -> Column:
        apart = (
            (F.greatest(p["x1"], p["x2"]) < F.least(q["x1"], q["x2"])) | (F.greatest(q["x1"], q["x2"]) < F.least(p["x1"], p["x2"]))
            | (F.greatest(p["y1"], p["y2"]) < F.least(q["y1"], q["y2"])) | (F.greatest(q["y1"], q["y2"]) < F.least(p["y1"], p["y2"]))
        )
        return ~apart & (side(p, q["x1"], q["y1"]) * side(p, q["x2"], q["y2"]) <= 0) & (side(q, p["x1"], p["y1"]) * side(q, p["x2"], p["y2"]) <= 0)

    n = F.size(numbered)
    crossing = F.exists(numbered, lambda p: F.exists(numbered, lambda q: (q["i"] > p["i"] + 1) & ~((p["i"] == 0) & (q["i"] == n - 1)) & meet(p, q)))
    return F.coalesce((n >= 3) & ~crossing, F.lit(False))
