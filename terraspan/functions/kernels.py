"""Neighbourhood operations on arrays: what DataFrame expressions can't say. Each runs inside one tile, piece or instance."""

from __future__ import annotations

import heapq

import numpy as np


def gaussian1d(a: np.ndarray, sigma: float, axis: int = -1, mode: str = "symmetric") -> np.ndarray:
    """Gaussian of four sigmas' reach along an axis; edges mirrored, or wrapped round."""
    if sigma <= 0:
        return a.astype(np.float64)
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    w /= w.sum()
    a = np.moveaxis(a.astype(np.float64), axis, -1)
    n = a.shape[-1]
    padded = np.pad(a, [(0, 0)] * (a.ndim - 1) + [(reach, reach)], mode=mode)
    size = 1 << int(np.ceil(np.log2(n + 4 * reach + 1)))
    product = np.fft.rfft(padded, size) * np.fft.rfft(w, size)  # one transform a line, whatever the reach
    return np.moveaxis(np.fft.irfft(product, size)[..., 2 * reach : 2 * reach + n], -1, axis)


def gaussian(a: np.ndarray, sigma: float | tuple[float, float]) -> np.ndarray:
    sy, sx = sigma if isinstance(sigma, tuple) else (sigma, sigma)
    return gaussian1d(gaussian1d(a, sy, 0), sx, 1)


def sample(a: np.ndarray, y: np.ndarray, x: np.ndarray, nearest: bool = False) -> np.ndarray:
    """Values at fractional places, bilinear or nearest; 0 outside."""
    h, w = a.shape
    if nearest:
        iy, ix = np.floor(y + 0.5).astype(np.int64), np.floor(x + 0.5).astype(np.int64)
        ok = (iy >= 0) & (iy < h) & (ix >= 0) & (ix < w)
        return np.where(ok, a[np.clip(iy, 0, h - 1), np.clip(ix, 0, w - 1)], 0)
    ok = (y >= 0) & (y <= h - 1) & (x >= 0) & (x <= w - 1)
    y0, x0 = np.clip(np.floor(y).astype(np.int64), 0, max(0, h - 2)), np.clip(np.floor(x).astype(np.int64), 0, max(0, w - 2))
    fy, fx = y - y0, x - x0
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    top = a[y0, x0] * (1 - fx) + a[y0, x1] * fx
    return np.where(ok, top * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy, 0.0)


def spans(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of true as half-open intervals."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask.astype(bool), [False]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def components(mask: np.ndarray, diagonal: bool = False) -> tuple[np.ndarray, int]:
    """Labels from 1 of connected true pixels (four neighbours, or eight) and their number: runs of each line joined to those above."""
    parent: list[int] = [0]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out, above = np.zeros(mask.shape, np.int64), []
    grow = int(diagonal)
    for y in range(mask.shape[0]):
        here, k = [], 0
        for a, b in spans(mask[y]):
            own = 0
            while k < len(above) and above[k][1] + grow <= a:
                k += 1
            j = k
            while j < len(above) and above[j][0] < b + grow:
                root = find(above[j][2])
                if own and own != root:
                    parent[max(own, root)] = min(own, root)
                own = min(own, root) if own else root
                j += 1
            if not own:
                own = len(parent)
                parent.append(own)
            here.append((a, b, own))
            out[y, a:b] = own
        above = here
    roots = np.array([find(i) for i in range(len(parent))])
    kept, dense = np.unique(roots[1:], return_inverse=True)
    table = np.concatenate([[0], dense + 1]).astype(np.int64)
    return table[out], len(kept)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Background that doesn't reach the border becomes foreground."""
    labels, n = components(~mask)
    open_ = np.zeros(n + 1, bool)
    for edge in (labels[0], labels[-1], labels[:, 0], labels[:, -1]):
        open_[edge] = True
    open_[0] = False
    return ~open_[labels] | mask


def _spread(mask: np.ndarray, value: bool) -> np.ndarray:
    p = np.pad(mask, 1, constant_values=value)
    parts = (p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:])
    return np.logical_or.reduce(parts) if not value else np.logical_and.reduce(parts)


def close(mask: np.ndarray, times: int = 1) -> np.ndarray:
    """Binary closing by a cross."""
    out = np.pad(mask.astype(bool), times)
    for _ in range(times):
        out = _spread(out, False)
    for _ in range(times):
        out = _spread(out, True)
    return out[times : out.shape[0] - times, times : out.shape[1] - times]


def distance_to(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance in pixels to the nearest true pixel; infinite without any."""
    h, w = mask.shape
    if not mask.any():
        return np.full(mask.shape, np.inf)
    rows = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(mask, rows, -(10**9)), axis=0)
    below = np.minimum.accumulate(np.where(mask, rows, 10**9)[::-1], axis=0)[::-1]
    column = np.minimum(rows - above, below - rows).astype(np.float64) ** 2
    best = column.copy()
    for k in range(1, w):  # farther columns matter while their distance alone can win
        if k * k >= best.max():
            break
        best[:, k:] = np.minimum(best[:, k:], column[:, :-k] + k * k)
        best[:, :-k] = np.minimum(best[:, :-k], column[:, k:] + k * k)
    return np.sqrt(best)


def inside_ring(x: np.ndarray, y: np.ndarray, rings: list[np.ndarray]) -> np.ndarray:
    """Even-odd rule over all rings (holes included); ``rings``: arrays of (x, y)."""
    odd = np.zeros(np.broadcast(x, y).shape, bool)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, -1, axis=0), strict=True):
            if y1 != y2:
                odd ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return odd


def ranges_inside(path: np.ndarray, rings: list[np.ndarray]) -> list[tuple[float, float]]:
    """The stretches of a polyline inside the rings, as fractional vertex numbers: 2.25 is a quarter of the way from vertex 2 to 3."""
    a, d = path[:-1], np.diff(path, axis=0)
    marks = [np.arange(len(path), dtype=np.float64)]
    for ring in rings:
        for p, q in zip(ring, np.roll(ring, -1, axis=0), strict=True):
            e = q - p
            turn = d[:, 0] * e[1] - d[:, 1] * e[0]
            with np.errstate(divide="ignore", invalid="ignore"):
                t = ((p[0] - a[:, 0]) * e[1] - (p[1] - a[:, 1]) * e[0]) / turn
                s = ((p[0] - a[:, 0]) * d[:, 1] - (p[1] - a[:, 1]) * d[:, 0]) / turn
            at = np.flatnonzero((turn != 0) & (t > 0) & (t < 1) & (s >= 0) & (s <= 1))
            marks.append(at + t[at])
    cuts = np.unique(np.concatenate(marks))
    middle = along(path, (cuts[:-1] + cuts[1:]) / 2)
    return [(float(cuts[s]), float(cuts[e])) for s, e in spans(inside_ring(middle[:, 0], middle[:, 1], rings))]


def along(path: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Points at fractional vertex numbers."""
    i = np.clip(np.floor(at).astype(np.int64), 0, len(path) - 2)
    return path[i] + (at - i)[:, None] * (path[i + 1] - path[i])


def part(path: np.ndarray, start: float, end: float) -> np.ndarray:
    """The stretch of a polyline between two fractional vertex numbers."""
    return along(path, np.concatenate([[start], np.arange(np.floor(start) + 1, np.ceil(end)), [end]]))


def clip_path(path: np.ndarray, rings: list[np.ndarray]) -> list[np.ndarray]:
    """The parts of a polyline inside the rings, cut at the crossings."""
    return [part(path, s, e) for s, e in ranges_inside(path, rings)]


def path_length(path: np.ndarray) -> float:
    return float(np.hypot(*np.diff(path, axis=0).T).sum())


def peaks(a: np.ndarray, distance: int, prominence: float) -> np.ndarray:
    """Places of local maxima, the lower of two closer than ``distance`` dropped, then those that stand out too little."""
    top = [i for i in range(1, len(a) - 1) if a[i] > a[i - 1] and a[i] > a[np.argmax(a[i:] != a[i]) + i if (a[i:] != a[i]).any() else i]]
    kept: list[int] = []
    for i in sorted(top, key=lambda i: -a[i]):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)
    out = []
    for i in sorted(kept):
        left, right = a[:i][::-1], a[i + 1 :]
        base = [side[: np.argmax(side > a[i]) if (side > a[i]).any() else len(side)].min(initial=a[i]) for side in (left, right)]
        if a[i] - max(base) >= prominence:
            out.append(i)
    return np.array(out, np.int64)


def thin(mask: np.ndarray) -> np.ndarray:
    """Skeleton by two alternating passes that peel border pixels without breaking connections."""
    out = np.pad(mask.astype(np.uint8), 1)
    changed = True
    while changed:
        changed = False
        for half in (0, 1):
            n, e, s, w = out[:-2, 1:-1], out[1:-1, 2:], out[2:, 1:-1], out[1:-1, :-2]
            around = [n, out[:-2, 2:], e, out[2:, 2:], s, out[2:, :-2], w, out[:-2, :-2]]
            count = sum(x.astype(np.int64) for x in around)
            turns = sum(((p == 0) & (q == 1)).astype(np.int64) for p, q in zip(around, around[1:] + around[:1], strict=True))
            sides = ((n & e & s) | (e & s & w)) if half == 0 else ((n & e & w) | (n & s & w))
            peel = (out[1:-1, 1:-1] == 1) & (count >= 2) & (count <= 6) & (turns == 1) & (sides == 0)
            if peel.any():
                out[1:-1, 1:-1][peel] = 0
                changed = True
    return out[1:-1, 1:-1].astype(bool)


def longest_path(skeleton: np.ndarray) -> tuple[np.ndarray, float]:
    """(row, col) along the longest shortest path of a skeleton, by two sweeps over its 8-neighbour graph, and its length in pixels."""
    nodes = {(int(y), int(x)) for y, x in zip(*np.nonzero(skeleton), strict=True)}
    if not nodes:
        return np.zeros((0, 2)), 0.0

    def sweep(start: tuple[int, int]):
        far, back, queue = {start: 0.0}, {}, [(0.0, start)]
        while queue:
            d, (y, x) = heapq.heappop(queue)
            if d > far[y, x]:
                continue
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    q, step = (y + dy, x + dx), d + (2**0.5 if dy and dx else 1.0)
                    if q in nodes and (dy or dx) and step < far.get(q, np.inf):
                        far[q], back[q] = step, (y, x)
                        heapq.heappush(queue, (step, q))
        return far, back

    far, _ = sweep(min(nodes))
    far, back = sweep(max(far, key=lambda p: (far[p], p)))
    end = max(far, key=lambda p: (far[p], p))
    path = [end]
    while path[-1] in back:
        path.append(back[path[-1]])
    return np.array(path[::-1], float), far[end]
