"""Vegetation indices and their classes. A zero denominator gives null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_DATA_CLASS, LOWEST_CLASS = "Sin datos", "Suelo/Agua"

#: Class thresholds of each index.
THRESHOLDS = {
    "ndvi": {"Vigorosa": 0.6, "Moderada": 0.3, "Estresada": 0.1},
    "ndre": {"Vigorosa": 0.6, "Moderada": 0.3, "Estresada": 0.1},
    "exg": {"Vigorosa": 0.20, "Moderada": 0.05, "Estresada": -0.05},
    "vari": {"Vigorosa": 0.20, "Moderada": 0.05, "Estresada": -0.10},
}


def _normalised(high: Column, low: Column) -> Column:
    return F.try_divide(high - low, high + low)


def ndvi(nir: Column, red: Column) -> Column:
    return _normalised(nir, red)


def ndre(nir: Column, red_edge: Column) -> Column:
    return _normalised(nir, red_edge)


def gndvi(nir: Column, green: Column) -> Column:
    """An extension: the same with green."""
    return _normalised(nir, green)


def exg(red: Column, green: Column, blue: Column) -> Column:
    """Excess green on chromatic coordinates."""
    return F.try_divide(2 * green - red - blue, red + green + blue)


def exg_offset(red: Column, green: Column, blue: Column) -> Column:
    """The variant that adds one to the sum of bands."""
    return (2 * green - red - blue) / (red + green + blue + 1)


def vari(red: Column, green: Column, blue: Column) -> Column:
    return F.try_divide(green - red, green + red - blue)


def valid_rgb(red: Column, green: Column, blue: Column, nodata: float) -> Column:
    """False only where all three bands are NoData."""
    return ~((red == nodata) & (green == nodata) & (blue == nodata))


def classify(value: Column, thresholds: dict[str, float] | None = None) -> Column:
    """The class whose threshold is the highest not above the value; null and NaN have no data. No thresholds mean those of NDVI."""
    out = F.when(value.isNull() | F.isnan(value), NO_DATA_CLASS)
    for name, least in sorted((thresholds or THRESHOLDS["ndvi"]).items(), key=lambda x: -x[1]):
        out = out.when(value >= least, name)
    return out.otherwise(LOWEST_CLASS)


def is_vegetation(red: Column, green: Column, blue: Column) -> Column:
    """Green enough for an inter-row weed candidate."""
    return (exg_offset(red, green, blue) > 0.12) & (green > 1.08 * red) & (green > 1.08 * blue)
