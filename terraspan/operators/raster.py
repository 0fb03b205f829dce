"""Band statistics, zonal statistics and tiles over pixel tables (row, col and one column a band)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraspan.functions import geometry as g
from terraspan.functions import indices

from .spatial import points_within


def band_statistics(pixels: DataFrame, band: str, nodata: float | None = None) -> DataFrame:
    """One row: min, max, mean, std (population), median of valid pixels; zeros if there are none."""
    v = F.nanvl(F.col(band).cast("double"), F.lit(None).cast("double"))
    valid = pixels.select(v.alias("v")).filter("v is not null")
    if nodata is not None and nodata == nodata:  # a NaN NoData value removes nothing by comparison
        valid = valid.filter(F.col("v") != nodata)
    zero = lambda c, n: F.coalesce(c, F.lit(0.0)).alias(n)
    return valid.agg(zero(F.min("v"), "min"), zero(F.max("v"), "max"), zero(F.avg("v"), "mean"), zero(F.stddev_pop("v"), "std"), zero(F.median("v"), "median"))


def zonal(pixels: DataFrame, parcels: DataFrame, value: Column, prefix: str, cell: float, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Per parcel (name, ring): {prefix}_mean, _min, _max, _std (population) and _clase; parcels without pixels have no data.

    ``pixels`` have the coordinates x, y of their centres. A parcel's pixels
    are aggregated before they are shuffled, so a large parcel is no hot key.
    """
    valued = pixels.withColumn("_v", value).select("x", "y", "_v").filter("_v is not null")
    inside = points_within(valued, parcels.select("name", "ring"), cell)
    stats = inside.groupBy("name").agg(*[f("_v").alias(f"{prefix}_{n}") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_pop))])
    out = parcels.select("name").join(stats, "name", "left")
    return out.withColumn(f"{prefix}_clase", indices.classify(F.col(f"{prefix}_mean"), thresholds or indices.THRESHOLDS.get(prefix)))


def zonal_rgb_index(pixels: DataFrame, parcels: DataFrame, index: str, cell: float, nodata: float | None = None) -> DataFrame:
    """Zonal statistics of exg or vari from the bands red, green and blue."""
    index = index.lower()
    if index not in ("exg", "vari"):
        raise ValueError(f"no RGB index {index}")
    bands = [F.col(c) for c in ("red", "green", "blue")]
    value = getattr(indices, index)(*bands)
    if nodata is not None:
        value = F.when(indices.valid_rgb(*bands, nodata), value)
    return zonal(pixels, parcels, value, index, cell)


def tile_offsets(spark, width: int, height: int, size: int, overlap: float, bounds: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(row_off, col_off, h, w) of the tiles of a raster or of a pixel window (row0, col0, row1, col1) of it; edge tiles are clipped."""
    r0, c0, r1, c1 = bounds or (0, 0, height, width)
    r0, c0, r1, c1 = max(0, r0), max(0, c0), min(height, r1), min(width, c1)
    stride = max(1, int(size * (1 - overlap)))
    if r1 <= r0 or c1 <= c0:
        return spark.createDataFrame([], "row_off long, col_off long, h long, w long")
    rows = spark.range(r0, r1, stride).withColumnRenamed("id", "row_off")
    out = rows.withColumn("col_off", F.explode(F.sequence(F.lit(c0).cast("long"), F.lit(c1 - 1).cast("long"), F.lit(stride).cast("long"))))
    return out.select("row_off", "col_off", F.least(F.lit(size), r1 - F.col("row_off")).alias("h"), F.least(F.lit(size), c1 - F.col("col_off")).alias("w"))


def valid_tiles(pixels: DataFrame, size: int, nodata: float, least: float = 0.5, band: str = "b1") -> DataFrame:
    """(tile_row, tile_col, valid_fraction) of the tiles with enough valid pixels."""
    tiles = pixels.groupBy(F.floor(F.col("row") / size).alias("tile_row"), F.floor(F.col("col") / size).alias("tile_col"))
    return tiles.agg(F.avg(F.when(F.col(band) != nodata, 1.0).otherwise(0.0)).alias("valid_fraction")).filter(F.col("valid_fraction") >= least)


def to_uint8(pixels: DataFrame, key: list[str], bands: list[str]) -> DataFrame:
    """Each band stretched to 0..255 as {band}_u8, truncated, between the 2nd and 98th percentile of all finite values of all bands of the group; a flat group gives 0."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    every = pixels.select(*key, F.explode(F.array(*[F.col(b).cast("double") for b in bands])).alias("_v")).filter(finite(F.col("_v")))
    limits = every.groupBy(*key).agg(F.percentile("_v", F.array(F.lit(0.02), F.lit(0.98))).alias("_p"))
    low, high = F.col("_p")[0], F.col("_p")[1]
    scaled = lambda b: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col(b) - low, high - low))) * 255
    return pixels.join(limits, key).withColumns({f"{b}_u8": F.coalesce(F.floor(scaled(b)), F.lit(0)).cast("int") for b in bands}).drop("_p")


def auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the area under the ROC curve by rank sums, ties at their mean rank.

    Ranks come from counts of each distinct score, so only distinct scores are ordered.
    """
    counts = scored.groupBy(score).agg(F.sum(label).cast("double").alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    below = F.sum("n").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    ranked = counts.withColumn("rank", F.coalesce(below, F.lit(0.0)) + (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select(F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))).alias("auc"))


def valid_mask(pixels: DataFrame, bands: list[str], nodata: float | None, alpha: str | None, parcels: DataFrame, cell: float) -> DataFrame:
    """Pixels (x, y, bands) that count: NoData in no band, finite, alpha above 0 where there is one, and strictly inside a parcel (name, ring)."""
    good = F.lit(True)
    for b in bands:
        good = good & F.col(b).isNotNull() & ~F.isnan(F.col(b).cast("double")) & (F.abs(F.col(b).cast("double")) != F.lit(float("inf")))
        good = good if nodata is None else good & (F.col(b) != nodata)
    good = good if alpha is None else good & (F.col(alpha) > 0)
    return points_within(pixels.filter(good), parcels.select("name", "ring"), cell).drop("ring")


POLYGONS = ("Polygon", "MultiPolygon")


def parcel_problems(layer: DataFrame) -> DataFrame:
    """(name, problem): what forbids an analysis of each parcel (name, kind, srid, ring): no reference system, a kind other than polygons, no geometry, a ring that crosses itself; null if nothing does."""
    problem = F.when(F.col("srid").isNull(), "sin CRS").when(F.col("ring").isNull() | (F.size("ring") == 0), "vacía")
    return layer.select("name", problem.when(~F.col("kind").isin(*POLYGONS), "no es un polígono").when(~g.is_simple(F.col("ring")), "no válida").alias("problem"))
