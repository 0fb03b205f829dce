"""Gaps between sown segments that lie on one planting line."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "parcela_id string, ordinal long, x1 double, y1 double, x2 double, y2 double, long_m double"
SEED_ANGLE = 20.0


def clusters(lines: np.ndarray, lateral: float) -> list[np.ndarray]:
    """Indices of segments (x1, y1, x2, y2), in order, that follow a seed: the first one left takes all within 20 degrees whose middle lies near its line."""
    start, step = lines[:, :2], lines[:, 2:] - lines[:, :2]
    norm = np.hypot(*step.T)
    unit = np.where(norm[:, None] > 1e-9, step / np.maximum(norm, 1e-9)[:, None], np.array([1.0, 0.0]))
    middle, free, out = start + step / 2, np.ones(len(lines), bool), []
    while free.any():
        seed = int(np.argmax(free))
        angle = np.rad2deg(np.arccos(np.clip(np.abs(unit @ unit[seed]), 0, 1)))
        off = middle - start[seed]
        near = np.abs(off[:, 0] * unit[seed, 1] - off[:, 1] * unit[seed, 0]) <= lateral
        own = free & (angle <= SEED_ANGLE) & near
        own[seed] = True
        free &= ~own
        out.append(np.flatnonzero(own))
    return out


def gaps_along(lines: np.ndarray, axis: np.ndarray, least: float) -> list[tuple[float, ...]]:
    """(x1, y1, x2, y2, length) between consecutive segments along the axis."""
    ends = lines.reshape(-1, 2, 2)
    places = ends @ axis
    order = np.argsort(places[:, 0], kind="stable")
    out = []
    for i, j in zip(order, order[1:], strict=False):
        a, b = ends[i, places[i].argmax()], ends[j, places[j].argmin()]
        d = float(np.hypot(*(b - a)))
        if d >= least:
            out.append((*a, *b, d))
    return out


def infer_gaps(segments: DataFrame, min_gap_m: float, max_lateral_m: float) -> DataFrame:
    """Gaps of each parcel's segments (parcela_id, ordinal, x1, y1, x2, y2); a parcel's segments are one task's work."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        lines = group.sort_values("ordinal")[["x1", "y1", "x2", "y2"]].to_numpy(float)
        found = []
        for own in clusters(lines, max_lateral_m):
            if len(own) > 1:
                step = lines[own[0], 2:] - lines[own[0], :2]
                norm = float(np.hypot(*step))
                found += gaps_along(lines[own], step / norm if norm > 1e-9 else np.array([1.0, 0.0]), min_gap_m)
        rows = [(group["parcela_id"].iloc[0], i, *g) for i, g in enumerate(found, 1)]
        return pd.DataFrame(rows, columns=["parcela_id", "ordinal", "x1", "y1", "x2", "y2", "long_m"])

    return segments.groupBy("parcela_id").applyInPandas(run, SCHEMA)
