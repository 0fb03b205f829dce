"""Polygon algebra for one or a few shapes: overlays, unions, buffers, repair, outlines of masks.

A shape is a list of rings (arrays of x, y, not closed) under the even-odd
rule. Any combination of shapes is built in one way: all edges are cut where
they meet, a piece of edge belongs to the outline if the result holds on just
one side of it, and the outline is walked with the inside on its left. Outer
rings come out anticlockwise, holes clockwise.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np

from .kernels import inside_ring

Shape = list[np.ndarray]
#: Corners of a full circle in buffers.
CIRCLE = 64
#: Of the extent: points closer than this are one point, and sides of an edge are looked at this far from it.
SNAP, ASIDE = 1e-10, 1e-8


def ring_area(ring: np.ndarray) -> float:
    """Signed; positive if anticlockwise."""
    x, y = (ring - ring[0]).T
    return float(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2


def area(rings: Shape) -> float:
    """Of rings as this module makes them: holes count negative."""
    return sum(ring_area(r) for r in rings)


def _edges(shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the edges."""
    rings = [np.asarray(r, float) for r in shape if len(r) >= 3]
    if not rings:
        return np.zeros((0, 2)), np.zeros((0, 2))
    p, q = np.concatenate(rings), np.concatenate([np.roll(r, -1, axis=0) for r in rings])
    keep = (p != q).any(axis=1)
    return p[keep], q[keep]


def _cut(p: np.ndarray, q: np.ndarray, snap: float) -> tuple[np.ndarray, np.ndarray]:
    """The edges as pieces that meet at their ends only; no piece twice."""
    points: list[list[np.ndarray]] = [[a, b] for a, b in zip(p, q, strict=True)]
    low, high, d = np.minimum(p, q) - snap, np.maximum(p, q) + snap, q - p
    length = np.hypot(*d.T)
    for i in range(len(p)):
        near = i + 1 + np.flatnonzero(((low[i + 1 :] <= high[i]) & (high[i + 1 :] >= low[i])).all(axis=1))
        if not len(near):
            continue
        # ends of one on the other
        for end in (p, q):
            for j in near[_on(end[near], p[i], d[i], length[i], snap)]:
                points[i].append(end[j])
            for j in near[_on(end[i], p[near], d[near], length[near], snap)]:
                points[j].append(end[i])
        # proper crossings, as one and the same point for both
        den = d[i, 0] * d[near, 1] - d[i, 1] * d[near, 0]
        gap = p[near] - p[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (gap[:, 0] * d[near, 1] - gap[:, 1] * d[near, 0]) / den
            s = (gap[:, 0] * d[i, 1] - gap[:, 1] * d[i, 0]) / den
        away_t, away_s = snap / length[i], snap / length[near]
        for k in np.flatnonzero((den != 0) & (t > away_t) & (t < 1 - away_t) & (s > away_s) & (s < 1 - away_s)):
            x = p[i] + t[k] * d[i]
            points[i].append(x)
            points[near[k]].append(x)
    names: dict[tuple[int, int], int] = {}
    where: list[np.ndarray] = []

    def name(x: np.ndarray) -> int:
        cx, cy = int(np.floor(x[0] / snap / 4)), int(np.floor(x[1] / snap / 4))
        for key in ((cx + a, cy + b) for a in (0, -1, 1) for b in (0, -1, 1)):
            if key in names and np.abs(where[names[key]] - x).max() <= 2 * snap:
                return names[key]
        names[cx, cy] = len(where)
        where.append(x)
        return len(where) - 1

    pieces = set()
    for i, own in enumerate(points):
        order = sorted(own, key=lambda x, i=i: float((x - p[i]) @ d[i]))
        ids = [name(x) for x in order]
        pieces |= {(min(a, b), max(a, b)) for a, b in zip(ids, ids[1:], strict=False) if a != b}
    return np.array(where).reshape(-1, 2), np.array(sorted(pieces), np.int64).reshape(-1, 2)


def _on(x: np.ndarray, p: np.ndarray, d: np.ndarray, length: np.ndarray, snap: float) -> np.ndarray:
    """Which of the points lie on which edges, ends included."""
    v = x - p
    along = (v * d).sum(axis=-1) / length
    off = np.abs(v[..., 0] * d[..., 1] - v[..., 1] * d[..., 0]) / length
    return (off <= snap) & (along >= -snap) & (along <= length + snap)


def walk(where: np.ndarray, directed: np.ndarray) -> Shape:
    """Rings of edges (from, to) that have the inside on their left; at a shared corner the sharpest left turn is taken."""
    out: dict[int, list[int]] = defaultdict(list)
    angle = np.arctan2(*(where[directed[:, 1]] - where[directed[:, 0]]).T[::-1]) if len(directed) else np.zeros(0)
    for k, (a, _) in enumerate(directed):
        out[int(a)].append(k)
    used, rings = np.zeros(len(directed), bool), []
    for first in range(len(directed)):
        k, ring = first, []
        while k is not None and not used[k]:
            used[k] = True
            ring.append(directed[k, 0])
            free = [n for n in out[int(directed[k, 1])] if not used[n]]
            k = min(free, key=lambda n, k=k: (angle[k] + np.pi - angle[n]) % (2 * np.pi) or 2 * np.pi) if free else None
        if len(ring) >= 3:
            rings.append(_straight(where[ring]))
    return [r for r in rings if len(r) >= 3]


def _straight(ring: np.ndarray) -> np.ndarray:
    """Without corners in the middle of a straight line."""
    a, b = ring - np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0) - ring
    cross = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0])
    return ring[cross > 1e-12 * np.hypot(*a.T) * np.hypot(*b.T)]


def combine(shapes: list[Shape], rule: Callable[[np.ndarray], np.ndarray]) -> Shape:
    """Where ``rule`` holds; it turns an array [shape, point] of memberships into one [point]."""
    edges = [_edges(s) for s in shapes]
    p, q = (np.concatenate([e[side] for e in edges]) for side in (0, 1))
    if not len(p):
        return []
    origin = p.min(axis=0)  # far from 0 the tolerances would be below the floats' own
    extent = max(float((p - origin).max()), 1e-300)
    where, pieces = _cut(p - origin, q - origin, extent * SNAP)
    a, b = where[pieces[:, 0]], where[pieces[:, 1]]
    left = np.stack([a[:, 1] - b[:, 1], b[:, 0] - a[:, 0]], axis=1)
    left *= extent * ASIDE / np.hypot(*left.T)[:, None]
    local = [[np.asarray(r, float) - origin for r in s if len(r) >= 3] for s in shapes]
    sides = []
    for at in ((a + b) / 2 + left, (a + b) / 2 - left):
        sides.append(rule(np.stack([inside_ring(at[:, 0], at[:, 1], s) for s in local])))
    ahead, back = sides[0] & ~sides[1], sides[1] & ~sides[0]
    return [r + origin for r in walk(where, np.concatenate([pieces[ahead], pieces[back][:, ::-1]]))]


def intersection(*shapes: Shape) -> Shape:
    return combine(list(shapes), lambda inside: inside.all(axis=0))


def union(*shapes: Shape) -> Shape:
    return combine(list(shapes), lambda inside: inside.any(axis=0))


def difference(shape: Shape, *others: Shape) -> Shape:
    return combine([shape, *others], lambda inside: inside[0] & ~inside[1:].any(axis=0))


def repair(shape: Shape) -> Shape:
    """Simple rings that enclose the same places under the even-odd rule; an empty list if nothing is enclosed."""
    return combine([shape], lambda inside: inside[0])


def buffer(shape: Shape, distance: float) -> Shape:
    """Grown by ``distance``, or shrunk if it is negative; corners are arcs of a circle of 64 corners."""
    if distance == 0:
        return repair(shape)
    r, (p, q) = abs(distance), _edges(shape)
    turn = 2 * np.pi * np.arange(CIRCLE) / CIRCLE
    circle = r * np.stack([np.cos(turn), np.sin(turn)], axis=1)
    side = np.stack([p[:, 1] - q[:, 1], q[:, 0] - p[:, 0]], axis=1)
    side *= r / np.hypot(*side.T)[:, None]
    rim = [[np.array([a + s, a - s, b - s, b + s])] for a, b, s in zip(p, q, side, strict=True)] + [[c + circle] for c in np.unique(p, axis=0)]
    return union(shape, *rim) if distance > 0 else difference(shape, *rim)


def polygons(rings: Shape) -> list[Shape]:
    """Rings as this module makes them, apart: each outer ring with the holes inside it."""
    outer = sorted((r for r in rings if ring_area(r) > 0), key=ring_area)
    out = [[r] for r in outer]
    for hole in (r for r in rings if ring_area(r) <= 0):
        a, b = hole[0], hole[1]
        step = np.array([a[1] - b[1], b[0] - a[0]])  # to the left of a clockwise hole's edge lies the polygon
        at = (a + b) / 2 + step * 1e-9
        for own, r in zip(out, outer, strict=True):
            if inside_ring(at[:1], at[1:], [r])[0]:
                own.append(hole)
                break
    return out


def outline(mask: np.ndarray) -> Shape:
    """Rings around the set pixels, in (col, row) of pixel corners; areas are pixel counts."""
    m = np.pad(mask.astype(bool), 1)
    width = m.shape[1] + 1
    edges = []
    # along a row's upper border the inside is below, which with y growing is to the left going right
    for inside, outside, ends in (
        (m, np.roll(m, 1, axis=0), ((0, 0), (0, 1))), (m, np.roll(m, -1, axis=0), ((1, 1), (1, 0))),
        (m, np.roll(m, 1, axis=1), ((1, 0), (0, 0))), (m, np.roll(m, -1, axis=1), ((0, 1), (1, 1))),
    ):
        r, c = np.nonzero(inside & ~outside)
        edges.append(np.stack([(r + dr) * width + c + dc for dr, dc in ends], axis=1))
    directed = np.concatenate(edges)
    corners, ids = np.unique(directed, return_inverse=True)
    where = np.stack([corners % width - 1, corners // width - 1], axis=1).astype(float)
    return walk(where, ids.reshape(-1, 2))
