"""Vector layers as DataFrames of attributes and rings: GeoJSON, KML, annotation JSON, shapefile, GeoPackage."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
RINGS = f"array<array<{POINT}>>"
EXTENSIONS = (".shp", ".gpkg", ".geojson", ".kml")


class UnsupportedFormatError(ValueError):
    """No reader or writer knows the extension."""


def _name_column(df: DataFrame) -> DataFrame:
    """``Name`` becomes ``name`` where there is none."""
    return df.withColumnRenamed("Name", "name") if "Name" in df.columns and "name" not in df.columns else df


def _pairs(text: Column) -> Column:
    """Points of whitespace-apart "x,y[,z]" triples."""
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda p: p != "")
    number = lambda p, i: F.get(F.split(p, ","), F.lit(i)).try_cast("double")
    return F.transform(parts, lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y")))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, ring, srid): one row a Placemark with its first geometry: a polygon's outer ring, else a line, else a point.

    Rings of fewer than three points and lines of fewer than two don't count. A nameless Placemark is called "Placemark".
    """
    ring = "outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>"
    one = f"Polygon struct<{ring}>, LineString struct<coordinates:string>, Point struct<coordinates:string>"
    df = spark.read.format("xml").option("rowTag", "Placemark").option("ignoreNamespace", True).schema(f"name string, {one}").load(path)
    polygon, line, at = _pairs(F.col("Polygon.outerBoundaryIs.LinearRing.coordinates")), _pairs(F.col("LineString.coordinates")), _pairs(F.col("Point.coordinates"))
    kinds = [(polygon, 3, "Polygon"), (line, 2, "LineString"), (at, 1, "Point")]
    kind, coords = F.when(F.lit(False), ""), F.when(F.lit(False), at)
    for points, least, name in kinds:
        kind, coords = kind.when(F.size(points) >= least, name), coords.when(F.size(points) >= least, points)
    out = df.select(F.coalesce("name", F.lit("Placemark")).alias("name"), kind.alias("kind"), coords.alias("ring"), F.lit(4326).alias("srid"))
    return out.filter("kind is not null")


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Attributes of the given schema, ``kind`` and ``rings`` (of polygons, holes after the outer ring)."""
    schema = f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>"
    df = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    rings = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    points = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    df = df.filter("f.geometry is not null").select("f.properties.*", F.col("f.geometry.type").alias("kind"), F.when(F.col("f.geometry.type") == "Polygon", points).alias("rings"))
    return _name_column(df)


def parse_wkt(wkt: Column) -> Column:
    """Rings of POLYGON or MULTIPOLYGON text, all parts one after the other."""
    groups = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), 1)
    point = lambda p: F.struct(*[F.get(F.split(F.trim(p), r"\s+"), F.lit(i)).try_cast("double").alias(n) for i, n in enumerate("xy")])
    return F.transform(groups, lambda g: F.transform(F.split(g, ","), point))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(layer_id, id, wkt, rings) of an annotation export's items."""
    schema = "layer_id string, items array<struct<id:string,geometry:struct<wkt:string>>>"
    items = spark.read.schema(schema).option("multiLine", True).json(path).select("layer_id", F.explode("items").alias("i"))
    return items.select("layer_id", F.col("i.id").alias("id"), F.col("i.geometry.wkt").alias("wkt"), parse_wkt(F.col("i.geometry.wkt")).alias("rings"))


def shapes(data: bytes) -> Iterator[tuple[int, str, list[list[tuple[float, float]]]]]:
    """(number, kind, parts) of the records of a .shp file; points, lines and polygons, without their heights."""
    at, kinds = 100, {1: "Point", 3: "LineString", 5: "Polygon", 11: "Point", 13: "LineString", 15: "Polygon"}
    while at + 12 <= len(data):
        number, words = struct.unpack_from(">ii", data, at)
        kind = struct.unpack_from("<i", data, at + 8)[0]
        body = at + 12
        if kinds.get(kind) == "Point":
            yield number, "Point", [[struct.unpack_from("<dd", data, body)]]
        elif kind in kinds:
            parts, points = struct.unpack_from("<ii", data, body + 32)
            starts = [*struct.unpack_from(f"<{parts}i", data, body + 40), points]
            flat = struct.unpack_from(f"<{2 * points}d", data, body + 40 + 4 * parts)
            pairs = list(zip(flat[::2], flat[1::2], strict=True))
            yield number, kinds[kind], [pairs[a:b] for a, b in zip(starts, starts[1:], strict=False)]
        at += 8 + 2 * words


def wkb_rings(data: bytes) -> tuple[str, list[list[tuple[float, float]]]]:
    """Kind and rings of WKB points, lines, polygons and multi-polygons, either byte order, heights dropped."""
    at = 0

    def read(form: str):
        nonlocal at
        out = struct.unpack_from(order + form, data, at)
        at += struct.calcsize(order + form)
        return out

    def points(n: int, width: int) -> list[tuple[float, float]]:
        return [read("d" * width)[:2] for _ in range(n)]

    def geometry() -> tuple[str, list]:
        nonlocal order, at
        order = "<" if data[at] else ">"
        at += 1
        code = read("I")[0]
        width = 3 if code & 0x80000000 or 1000 <= code % 10000 < 3000 else 2
        base = (code & 0xFF) if code & 0xE0000000 else code % 1000
        if base == 1:
            return "Point", [points(1, width)]
        if base == 2:
            return "LineString", [points(read("I")[0], width)]
        if base == 3:
            return "Polygon", [points(read("I")[0], width) for _ in range(read("I")[0])]
        parts = [geometry() for _ in range(read("I")[0])]
        return f"Multi{parts[0][0]}" if parts else "Empty", [r for _, rings in parts for r in rings]

    order = "<"
    return geometry()


def _shp_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            rows = [(path, n, kind, [[{"x": x, "y": y} for x, y in part] for part in parts]) for n, kind, parts in shapes(content)]
            yield pd.DataFrame(rows, columns=["path", "id", "kind", "rings"])


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """(path, id, kind, rings) of the .shp files under a path; a file is one task's work."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_shp_rows, f"path string, id long, kind string, rings {RINGS}")


def _gpkg_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            db = sqlite3.connect(":memory:")
            db.deserialize(bytes(content))
            rows = []
            for layer, column, srid in db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns").fetchall():
                for rowid, blob in db.execute(f'SELECT rowid, "{column}" FROM "{layer}"'):
                    if blob:
                        head = 8 + (0, 32, 48, 48, 64)[(blob[3] >> 1) & 7]
                        kind, rings = wkb_rings(blob[head:])
                        rows.append((path, layer, rowid, srid, kind, [[{"x": x, "y": y} for x, y in r] for r in rings]))
            yield pd.DataFrame(rows, columns=["path", "layer", "id", "srid", "kind", "rings"])


def read_geopackage(spark: SparkSession, path: str) -> DataFrame:
    """(path, layer, id, srid, kind, rings) of the feature tables of the packages under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_gpkg_rows, f"path string, layer string, id long, srid int, kind string, rings {RINGS}")


def from_wkb(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``kind`` and ``rings`` decoded from WKB; rows without a geometry go."""

    @F.pandas_udf(f"struct<kind:string,rings:{RINGS}>")
    def decode(blobs: pd.Series) -> pd.DataFrame:
        out = [wkb_rings(bytes(b)) for b in blobs]
        return pd.DataFrame({"kind": [k for k, _ in out], "rings": [[[{"x": x, "y": y} for x, y in r] for r in rings] for _, rings in out]})

    rows = df.filter(F.col(column).isNotNull() & (F.octet_length(column) > 0)).withColumn("_g", decode(column))
    return rows.select(*df.columns, "_g.kind", "_g.rings")


def read_vector(spark: SparkSession, path: str, properties: str = "name:string") -> DataFrame:
    """By extension."""
    lower = path.lower()
    if lower.endswith(".kml"):
        return read_kml(spark, path)
    if lower.endswith(".geojson"):
        return read_geojson(spark, path, properties)
    if lower.endswith(".shp"):
        return read_shapefile(spark, path)
    if lower.endswith(".gpkg"):
        return read_geopackage(spark, path)
    raise UnsupportedFormatError(f"{path}: one of {', '.join(EXTENSIONS)} is needed")


def layer_metadata(layer: DataFrame, srid: int | None) -> DataFrame:
    """One row: features, bounds, area and perimeter of a layer (ring and attributes) in metres, its srid, the first kind if it has one, and its fields with their types.

    Rings in degrees (4326) are measured in the UTM zone of the middle of the layer's bounds.
    """
    from terraspan.functions import geometry as g

    boxed = layer.select(*[c.alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), g.bounds(F.col("ring")), strict=True)], "ring")
    whole = boxed.agg(F.min("x1").alias("minx"), F.min("y1").alias("miny"), F.max("x2").alias("maxx"), F.max("y2").alias("maxy"), F.count(F.lit(1)).alias("features"))
    ring = F.col("ring")
    if srid == 4326:
        rows = layer.select("ring").crossJoin(F.broadcast(whole.select(g.utm_epsg((F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2).alias("zone"))))  # one row
        ring = g.project_ring(F.col("ring"), F.col("zone"))
    else:
        rows = layer.select("ring")
    sums = rows.agg(F.sum(g.area(ring)).alias("area_m2"), F.sum(g.perimeter(ring)).alias("perimeter_m"))
    fields = F.create_map(*[F.lit(x) for f in layer.schema.fields if f.name not in ("ring", "rings") for x in (f.name, f.dataType.simpleString())])
    kind = layer.agg(F.first("kind", ignorenulls=True).alias("kind")) if "kind" in layer.columns else layer.agg(F.lit("Polygon").alias("kind"))
    return whole.crossJoin(sums).crossJoin(kind).withColumns({"srid": F.lit(srid), "area_ha": F.col("area_m2") / 10_000, "fields": fields})
