"""Vegetation between traced rows: isolated green patches beside the rows' centre lines, to be looked at as possible weeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraspan.functions import detections as d
from terraspan.storage import stored

from . import neighbours, patches, spatial, weeds

# Metres beside a row that still belong to it, the farthest place that is judged, and the smoothing of plants in pixels;
# the area of a patch in square metres, its least shares outside the rows and between them, and its greatest elongation.
OUTSIDE, FARTHEST, SIGMA = 0.14, 0.30, 10.0
LEAST, MOST, OUTSIDE_SHARE, SUPPORT, ELONGATION = 0.03, 1.5, 0.95, 0.60, 4.0


def line_pixels(lines: DataFrame) -> DataFrame:
    """(row, col) of the pixels along lines (path: array of x, y in pixels), each once: places at most a pixel apart on every segment."""
    follow = lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"))
    segments = lines.select(F.explode(F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path") - 1), follow)).alias("s")).select("s.*")
    steps = F.greatest(F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))), F.lit(1))
    walked = segments.withColumn("n", steps).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    at = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * F.col("i") / F.col("n"))
    return walked.select(at("y1", "y2").alias("row"), at("x1", "x2").alias("col")).distinct()


def observed(pixels: DataFrame, centres: DataFrame, res: float, height: int, width: int, tile: int = 512) -> DataFrame:
    """Valid pixels (row, col, vegetation) with ``distance`` in metres to the nearest pixel of a row's centre line (null beyond FARTHEST), ``coverage`` by plants around and ``eligible``: whether they lie between rows with open canopy."""
    numbered = pixels.select((F.col("row") * width + F.col("col")).alias("number"), F.col("row").cast("long"), F.col("col").cast("long"), F.coalesce("vegetation", F.lit(False)).alias("vegetation"))
    placed = numbered.withColumns({"x": F.col("col").cast("double"), "y": F.col("row").cast("double")})
    others = centres.select(F.col("col").cast("double").alias("ox"), F.col("row").cast("double").alias("oy"))
    near = spatial.nearest(placed, others, "number", FARTHEST / res + 1).withColumn("distance", F.col("distance") * res)
    near = near.select("row", "col", "vegetation", F.when(F.col("distance") <= FARTHEST, F.col("distance")).alias("distance"))
    around = neighbours.smoothed(near, "vegetation", SIGMA, height, width, tile).withColumnRenamed("smooth", "coverage")
    return around.withColumn("eligible", F.coalesce(d.is_between_rows(F.col("distance"), F.col("coverage")), F.lit(False)))


def patch_shares(seen: DataFrame, tile: int = 512) -> tuple[DataFrame, DataFrame]:
    """Whole vegetation patches of ``observed`` pixels: their pixels (row, col, label), and of each label the count of pixels and the shares outside the rows and between them."""
    plants = seen.filter("vegetation")
    labelled = stored(patches.components(plants.select("row", "col"), tile), "plants")
    outside = F.coalesce(F.col("distance") > OUTSIDE, F.lit(True))
    shares = labelled.join(plants, ["row", "col"]).groupBy("label").agg(
        F.count(F.lit(1)).alias("pixels"), F.avg(outside.cast("double")).alias("outside"), F.avg(F.col("eligible").cast("double")).alias("supported"), F.avg("coverage").alias("coverage")
    )
    return labelled, shares


def candidates(seen: DataFrame, res: float, tile: int = 512) -> DataFrame:
    """Patches that may be weeds, with size, box and shape: of a patch's area, off the rows, mostly in what is judged, and not drawn out.

    Only patches of at most MOST square metres are measured, so a task holds few pixels.
    """
    labelled, shares = patch_shares(seen, tile)
    area = F.col("pixels") * (res * res)
    good = stored(shares.filter(area.between(LEAST, MOST) & (F.col("outside") > OUTSIDE_SHARE) & (F.col("supported") > SUPPORT)).select("label"), "isolated")
    found = labelled.join(good, "label", "left_semi").withColumn("score", F.lit(1.0)).groupBy("label").applyInPandas(weeds.measured, weeds.PATCHES)
    return found.filter(F.col("elongation") <= ELONGATION).withColumn("area_m2", area).drop("score_sum")


def report(seen: DataFrame, found: DataFrame, res: float) -> DataFrame:
    """One row: how many patches, their square metres, and the square metres that were judged."""
    parts = found.select(F.lit(1).alias("n"), F.col("area_m2").alias("flagged"), F.lit(0.0).alias("judged")).unionByName(
        seen.filter("eligible").select(F.lit(0).alias("n"), F.lit(0.0).alias("flagged"), F.lit(res * res).alias("judged"))
    )
    whole = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return parts.agg(whole("n", "patches"), whole("flagged", "flagged_m2"), whole("judged", "evaluated_m2"))
