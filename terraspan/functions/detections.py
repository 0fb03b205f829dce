"""Expressions on detections and reports: shifts, georeferencing, coverage and density classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .affine import Affine, pixel_to_coords

NO_DATA_CLASS = "Sin datos"

#: Class names of weeds and crops, and keywords of unsown stretches.
WEED_LABELS = ("weed", "weeds", "maleza", "malezas")
CROP_LABELS = ("crop", "cultivo")
UNSOWN_KEYWORDS = ("no_sembr", "no sembr", "falla", "omitid", "vacio", "vacío", "gap")

#: Map colours of the classes.
COLOURS = {"Alta": "#d7191c", "Media": "#fdae61", "Baja": "#1a9641", NO_DATA_CLASS: "#bdbdbd"}


def corners(x1: Column, y1: Column, x2: Column, y2: Column, t: Affine) -> Column:
    """World corners of a pixel box, each taken as a pixel's centre (so half a pixel off, as the reports have it)."""
    at = lambda x, y: F.struct(*[c.alias(n) for n, c in zip("xy", pixel_to_coords(y, x, t), strict=True)])
    return F.array(at(x1, y1), at(x2, y1), at(x2, y2), at(x1, y2))


def density(count: Column, area: Column) -> Column:
    return F.try_divide(count, area)


def ranked_class(value: Column, order: Column, names: tuple[str, str, str], descending: bool) -> Column:
    """Thirds of the rank over all rows, nulls counted but ranked last and without a class; ``order`` breaks ties.

    The window has no partition: it is for one row a parcel, never for pixels.
    """
    whole = Window.partitionBy()
    first = value.desc_nulls_last() if descending else value.asc_nulls_last()
    share = F.row_number().over(Window.orderBy(first, order)) / F.count(F.lit(1)).over(whole)
    return F.when(value.isNull(), NO_DATA_CLASS).when(share <= 1 / 3, names[0]).when(share <= 2 / 3, names[1]).otherwise(names[2])


def infestation_class(ratio: Column) -> Column:
    return F.when(ratio.isNull(), NO_DATA_CLASS).when(ratio < 0.10, "Baja").when(ratio < 0.30, "Media").otherwise("Alta")


def is_weed_name(name: Column) -> Column:
    return F.lower(name).isin(*WEED_LABELS)


def is_crop_name(name: Column) -> Column:
    return F.lower(name).isin(*CROP_LABELS)


def weed_split(detections: DataFrame, name: str = "class") -> tuple[Column, bool]:
    """(whether a row is a weed, whether there are crops), decided by all names of the data set.

    Where any row has a weed's name, those rows are weeds and any other row is
    crop. Otherwise the rows that have no crop's name are weeds, and there are
    crops where both kinds occur. One row of flags reaches the driver.
    """
    weed, crop = is_weed_name(F.col(name)), is_crop_name(F.col(name))
    flag = lambda c: F.coalesce(F.max(F.coalesce(c, F.lit(False))), F.lit(False))
    seen = detections.agg(flag(weed).alias("weed"), flag(~weed).alias("other"), flag(crop).alias("crop"), flag(~crop).alias("rest")).first()
    if seen["weed"]:
        return F.coalesce(weed, F.lit(False)), bool(seen["other"])
    return ~F.coalesce(crop, F.lit(False)), bool(seen["crop"] and seen["rest"])


def weed_coverage(weeds: Column, crops: Column, area: Column, has_crop: bool) -> Column:
    """Weeds among all plants where there are crops, else weeds a square metre; null without plants or area."""
    return F.try_divide(weeds, weeds + crops) if has_crop else F.try_divide(weeds, area)


def as_points(found: DataFrame) -> DataFrame:
    """Georeferenced detections as points: class_id, class_name, confidence, x, y; rows without a place are an error."""
    place = F.when(F.col("x").isNull() | F.col("y").isNull(), F.raise_error(F.lit("a detection has no place"))).otherwise(F.col("x"))
    return found.select("class_id", "class_name", "confidence", place.cast("double").alias("x"), "y")


def as_boxes(found: DataFrame) -> DataFrame:
    """The same as polygons: class_id, class_name, confidence and the ring of bbox_geo."""
    ring = F.when(F.col("bbox_geo").isNull(), F.raise_error(F.lit("a detection has no box"))).otherwise(F.col("bbox_geo"))
    return found.select("class_id", "class_name", "confidence", ring.cast("array<struct<x:double,y:double>>").alias("ring"))


def is_between_rows(distance: Column, coverage: Column) -> Column:
    """Whether a place lies between rows: 0.18 to 0.30 from the nearest one, with less than 60 % plants around (fixed values)."""
    return distance.between(0.18, 0.30) & (coverage < 0.60)


def looks_unsown(name: Column) -> Column:
    lower = F.lower(name)
    out = F.lit(False)
    for word in UNSOWN_KEYWORDS:
        out = out | lower.contains(word)
    return out


def ground_sample_distance(altitude: Column, focal: Column, width_px: Column, sensor_mm: float = 17.3) -> Column:
    """Metres a pixel; null without focal length, altitude or width."""
    return F.try_divide(sensor_mm * altitude, focal * width_px)


def resampled_size(pixels: Column, gsd: Column, target: Column) -> Column:
    """At least one pixel; halves go to the even neighbour."""
    return F.greatest(F.lit(1), F.bround(F.try_divide(pixels * gsd, target), 0)).cast("long")


def coverage_result(percent: Column) -> Column:
    return F.when(percent == 0, "Omitida").when(percent < 50, "Parcial").otherwise("Mayormente cubierta")


def colour(name: Column) -> Column:
    pairs = [F.lit(x) for pair in COLOURS.items() for x in pair]
    return F.element_at(F.create_map(*pairs), name)


def layer_path(source: Column) -> Column:
    """What stands before the first pipe."""
    return F.substring_index(source, "|", 1)
