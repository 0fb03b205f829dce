"""Rows and gaps from a segmentation or key-point model: any function from an image to instances."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraspan.functions import detections, kernels as k
from terraspan.functions.affine import Affine

from .row_gaps import clusters, gaps_along
from .rows import RowOptions


@dataclass(frozen=True)
class Instance:
    """One line that a model sees: a mask, or the (x, y) of two ends in pixels."""

    name: str
    confidence: float
    mask: np.ndarray | None = None
    ends: np.ndarray | None = None


#: An image [row, col, 3] -> its instances.
Segmenter = Callable[[np.ndarray], list[Instance]]

INFERRED = "Posible falla (hueco entre detecciones)"
SCHEMA = "parcela_id string, piece long, nr long, class string, long_m double, estado string, geometry array<struct<x:double,y:double>>, inferred boolean, found boolean"


def world(points: np.ndarray, t: Affine) -> np.ndarray:
    """Positions of (col, row) pixel centres."""
    c, r = points.T + 0.5
    return np.stack([t.a * c + t.b * r + t.c, t.d * c + t.e * r + t.f], axis=1)


def line_of(seen: Instance, valid: np.ndarray, t: Affine, least: float) -> np.ndarray | None:
    """The instance as a line in the world: its skeleton's longest path, or the segment between its ends if one of them lies on valid pixels."""
    if seen.mask is not None:
        path, _ = k.longest_path(k.thin(seen.mask & valid))
        line = world(path[:, ::-1], t) if len(path) > 1 else None
    elif seen.ends is not None and len(seen.ends) >= 2 and np.isfinite(seen.ends[:2]).all():
        at = np.rint(seen.ends[:2]).astype(int)
        inside = (at >= 0).all(axis=1) & (at < valid.shape[::-1]).all(axis=1)
        line = world(seen.ends[:2], t) if any(valid[y, x] for x, y in at[inside]) else None
    else:
        line = None
    return line if line is not None and k.path_length(line) >= least else None


def segment_pieces(pieces: DataFrame, segmenter: Segmenter, options: RowOptions, conf: float = 0.25) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, gaps, warnings) of the pieces: parcela_id, piece (their order), h, w, image (uint8 bytes, three bands), valid (bytes), transform.

    Lines of a class whose name says that nothing was sown are gaps; so are
    the spaces of at least ``min_row_m`` between rows on one planting line of
    a piece. Rows and gaps are numbered apart, from 1 in order of the pieces.
    A piece where the model sees nothing gives a warning.
    """
    options = options.checked()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for p in frame.itertuples(index=False):
                image = np.frombuffer(p.image, np.uint8).reshape(3, p.h, p.w).transpose(1, 2, 0)
                valid, t, sown = np.frombuffer(p.valid, np.uint8).reshape(p.h, p.w) > 0, Affine(*p.transform), []
                seen = [s for s in segmenter(image) if s.confidence >= conf]
                lines = [(s, line) for s in seen if (line := line_of(s, valid, t, options.min_row_m)) is not None]
                geometry = lambda line: [{"x": x, "y": y} for x, y in line.tolist()]
                for nr, (s, line) in enumerate(lines, 1):
                    out.append((p.parcela_id, p.piece, nr, s.name, k.path_length(line), f"{s.name} ({s.confidence:.2f})", geometry(line), False, True))
                    sown.append((s.name, line))
                out += [(p.parcela_id, p.piece, nr, None, g[4], INFERRED, geometry(np.array(g[:4]).reshape(2, 2)), True, True) for nr, g in enumerate(between(sown, options), len(lines) + 1)]
                if not seen:
                    out.append((p.parcela_id, p.piece, 0, None, None, None, None, False, False))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")[:7]] + ["inferred", "found"])

    from terraspan.storage import stored

    found = stored(pieces.mapInPandas(run, SCHEMA), "segmented")  # the model runs once for all results
    gap = F.col("inferred") | detections.looks_unsown(F.col("class"))
    rows, gaps = numbered(found.filter(F.col("found") & ~gap)), numbered(found.filter(F.col("found") & gap))
    keep = ["parcela_id", "surco_id", F.lit(1).alias("sector"), "long_m"]
    warnings = found.filter(~F.col("found")).select(F.format_string("Parcela %s: el modelo no detectó líneas.", "parcela_id").alias("warning"))
    return rows.select(*keep, "estado", "geometry"), gaps.select(*keep, F.lit(options.min_row_m).alias("umbral_m"), "estado", "geometry"), warnings


def between(sown: list[tuple[str, np.ndarray]], options: RowOptions) -> list[tuple[float, ...]]:
    """Gaps between the sown lines of a piece, each taken as the segment from its first to its last point."""
    ends = np.array([[*line[0], *line[-1]] for name, line in sown if not unsown(name)], float).reshape(-1, 4)
    out = []
    for own in clusters(ends, options.spacing_m) if len(ends) else []:
        if len(own) > 1:
            step = ends[own[0], 2:] - ends[own[0], :2]
            norm = float(np.hypot(*step))
            out += gaps_along(ends[own], step / norm if norm > 1e-9 else np.array([1.0, 0.0]), options.min_row_m)
    return out


def unsown(name: str) -> bool:
    """``detections.looks_unsown`` for one name."""
    return any(word in name.lower() for word in detections.UNSOWN_KEYWORDS)


def numbered(found: DataFrame) -> DataFrame:
    """With ``surco_id`` from 1 in order of piece and nr: counts of pieces are summed, lines are ranked within their piece."""
    per = found.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    starts = per.select("piece", (F.sum("n").over(Window.orderBy("piece")) - F.col("n")).alias("start"))
    rank = F.row_number().over(Window.partitionBy("piece").orderBy("nr"))
    return found.withColumn("rank", rank).join(starts, "piece").withColumn("surco_id", F.col("start") + F.col("rank"))
