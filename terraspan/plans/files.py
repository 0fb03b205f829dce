"""Queries that write the tables as files of each format and read them back with this package's own readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terraspan import storage
from terraspan.functions import geometry as g
from terraspan.operators import spatial
from terraspan.sources import raster, sinks, text, vector

from .domain import view
from .queries import CELL, INSIDE, T, WEEDS, parcel_shapes, query, r9, weed_result


def folder(spark, name: str) -> str:
    return f"{storage.shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def local(path: str) -> str:
    """The path of a shared folder that is mounted: single files are written by the driver."""
    return path.removeprefix("file://")


SIDE, NODATA = 1000, -1.0


def written_raster(spark, sf_dir, bands) -> str:
    path = folder(spark, "raster")
    tiles = raster.tiles_of(view(spark, sf_dir, "pixels"), bands, SIDE, SIDE, 256, NODATA)
    raster.write_geotiff(tiles, f"{path}/field.tif", SIDE, SIDE, 256, len(bands), T, "float64", NODATA, 32720)
    return path


@query('SELECT "row", col, red, nir FROM pixels')
def geotiff_round_trip(spark, sf_dir):
    """Written tile by tile, read back block by block; pixels without data go."""
    tiles = raster.read_tiles(spark, written_raster(spark, sf_dir, ["red", "nir"]))
    return raster.pixels(tiles, 2).filter(F.col("b1") != NODATA).select("row", "col", F.col("b1").alias("red"), F.col("b2").alias("nir"))


@query('SELECT "row", col, edge AS value FROM pixels')
def geotiff_band(spark, sf_dir):
    """The second band of a raster."""
    return raster.read_band(raster.read_tiles(spark, written_raster(spark, sf_dir, ["red", "edge"])), 2).filter(F.col("value") != NODATA).select("row", "col", "value")


@query("""SELECT 'field.tif' AS name, 1000 AS width, 1000 AS height, 3 AS count, 'EPSG:32720' AS crs, CAST(0.5 AS DOUBLE) AS res_x, CAST(0.5 AS DOUBLE) AS res_y, CAST(500000 AS DOUBLE) AS minx,
    CAST(8199500 AS DOUBLE) AS miny, CAST(500500 AS DOUBLE) AS maxx, CAST(8200000 AS DOUBLE) AS maxy, 'float64' AS dtype, CAST(-1 AS DOUBLE) AS nodata, CAST(500000 AS DOUBLE) AS origin_x""")
def geotiff_metadata(spark, sf_dir):
    found = raster.metadata(spark, written_raster(spark, sf_dir, ["red", "green", "blue"]))
    return found.withColumn("origin_x", F.col("transform")[2]).drop("path", "bytes", "transform")


@query('SELECT "row", col, round_even(red / 200 * 100, 0) AS score FROM pixels WHERE blue <= 50')
def score_raster_round_trip(spark, sf_dir):
    """Scores in hundredths as bytes; 255 is no score."""
    path = folder(spark, "scores")
    scored = view(spark, sf_dir, "pixels").select("row", "col", F.when(F.col("blue") <= 50, F.col("red") / 200).alias("vote"))
    raster.write_scores(scored, "vote", f"{path}/puntuacion.tif", SIDE, SIDE, T, 32720)
    return raster.read_band(raster.read_tiles(spark, path), 1).filter(F.col("value") != 255).select("row", "col", F.col("value").alias("score"))


PARCEL_AREA = "CASE WHEN tri THEN 11250.0 ELSE 22500.0 END"


@query(f"SELECT name, ord, 'Polygon' AS kind, CAST({PARCEL_AREA} AS DOUBLE) AS area FROM parcels")
def geojson_round_trip(spark, sf_dir):
    path = f"{local(folder(spark, 'layer'))}/parcels.geojson"
    sinks.export(view(spark, sf_dir, "parcels").select("name", "ord", "ring"), path)
    return vector.read_vector(spark, path, "name:string,ord:long").select("name", "ord", "kind", g.area(F.col("rings")[0]).alias("area"))


@query(f"SELECT row_number() OVER (ORDER BY ord) AS id, 32720 AS srid, CAST({PARCEL_AREA} AS DOUBLE) AS area FROM parcels")
def geopackage_round_trip(spark, sf_dir):
    path = f"{local(folder(spark, 'layer'))}/parcels.gpkg"
    sinks.write_geopackage(parcel_shapes(spark, sf_dir).orderBy("ord"), path, "parcels", 32720)
    return vector.read_vector(spark, path).select("id", "srid", g.area(F.col("rings")[0]).alias("area"))


@query(f"SELECT row_number() OVER (ORDER BY ord) AS id, 'Polygon' AS kind, CAST({PARCEL_AREA} AS DOUBLE) AS area FROM parcels")
def shapefile_round_trip(spark, sf_dir):
    path = f"{local(folder(spark, 'layer'))}/parcels.shp"
    sinks.write_shapefile(parcel_shapes(spark, sf_dir).orderBy("ord"), path)
    return vector.read_vector(spark, path).select("id", "kind", g.area(F.col("rings")[0]).alias("area"))


@query(f"""SELECT name, 'Polygon' AS kind, CAST({PARCEL_AREA} AS DOUBLE) AS area, 4326 AS srid FROM parcels UNION ALL SELECT 'Placemark', 'LineString', 0, 4326 FROM parcels WHERE tri""")
def kml_scan(spark, sf_dir):
    """Placemarks with a polygon, and nameless ones with a line; heights are dropped."""
    p = view(spark, sf_dir, "parcels")
    points = F.array_join(F.transform(F.concat("ring", F.slice("ring", 1, 1)), lambda q: F.concat_ws(",", q["x"].cast("string"), q["y"].cast("string"), F.lit("7.5"))), " ")
    polygon = F.concat(F.lit("<Placemark><name>"), "name", F.lit("</name><Polygon><outerBoundaryIs><LinearRing><coordinates>"), points, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"))
    line = F.concat(F.lit("<Placemark><LineString><coordinates>"), points, F.lit("</coordinates></LineString></Placemark>"))
    path = folder(spark, "kml")
    marks = F.array_join(F.collect_list(F.concat(polygon, F.when(F.col("tri"), line).otherwise(""))), "\n")  # one document of 25 parcels
    p.agg(F.concat(F.lit("<kml><Document>\n"), marks, F.lit("\n</Document></kml>")).alias("value")).write.text(path)
    return vector.read_kml(spark, path).select("name", "kind", F.when(F.col("kind") == "Polygon", g.area(F.col("ring"))).otherwise(0.0).alias("area"), "srid")


@query(f"SELECT name AS id, CAST({PARCEL_AREA} AS DOUBLE) AS area, CASE WHEN tri THEN 3 ELSE 4 END AS corners FROM parcels")
def annotation_scan(spark, sf_dir):
    ring = F.array_join(F.transform(F.concat("ring", F.slice("ring", 1, 1)), lambda q: F.concat_ws(" ", q["x"].cast("string"), q["y"].cast("string"))), ", ")
    wkt = F.concat(F.lit("POLYGON (("), ring, F.lit("))"))
    item = F.struct(F.col("name").alias("id"), F.struct(wkt.alias("wkt")).alias("geometry"))
    path = folder(spark, "annotations")
    view(spark, sf_dir, "parcels").groupBy(F.lit("campo").alias("layer_id")).agg(F.collect_list(item).alias("items")).select(F.to_json(F.struct("layer_id", "items")).alias("value")).write.text(path)
    found = vector.read_annotations(spark, path)
    return found.select("id", g.area(F.col("rings")[0]).alias("area"), (F.size(F.col("rings")[0]) - 1).alias("corners"))


@query("SELECT CAST(lid % 3 AS INTEGER) AS class_id, count(*) AS n, round(sum(rx1 / 1000), 6) AS cx, round(sum((rx2 - rx1) * (ry2 - ry1) / 1000000), 9) AS area FROM labels_boxes GROUP BY 1")
def label_text_scan(spark, sf_dir):
    path = folder(spark, "labels")
    lines = F.format_string("%d %.9f %.9f %.9f %.9f", F.col("lid") % 3, F.col("rx1") / 1000, F.col("ry1") / 1000, (F.col("rx2") - F.col("rx1")) / 1000, (F.col("ry2") - F.col("ry1")) / 1000)
    view(spark, sf_dir, "labels_boxes").select(lines.alias("value")).write.text(path)
    found = text.read_labels(spark, path).groupBy("class_id")
    return found.agg(F.count(F.lit(1)).alias("n"), r9(F.sum("cx"), 6).alias("cx"), r9(F.sum(F.col("w") * F.col("h"))).alias("area"))


@query("SELECT CAST(s_suppkey % 1000 + 0.25 AS DOUBLE) AS RelativeAltitude, CAST(s_suppkey % 37 AS DOUBLE) AS GimbalYawDegree, CAST(NULL AS DOUBLE) AS FocalLength FROM supplier")
def photo_metadata_scan(spark, sf_dir):
    path = folder(spark, "photos")
    head = F.format_string('<x:xmpmeta RelativeAltitude="+%.2f" GimbalYawDegree="%d" />', (F.col("s_suppkey") % 1000 + F.lit(0.25)).cast("double"), F.col("s_suppkey") % 37)
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    rows.select(head.alias("value"), F.col("s_suppkey").alias("k")).repartitionByRange(4, "k").write.partitionBy("k").text(path)  # a file a photo
    found = text.read_photo_metadata(spark, f"{path}/*/", ["RelativeAltitude", "GimbalYawDegree", "FocalLength"])
    return found.select("RelativeAltitude", "GimbalYawDegree", "FocalLength")


@query(f"SELECT name AS ID_elemento, CAST({PARCEL_AREA} AS DOUBLE) AS Area_m2, CAST({PARCEL_AREA} / 10000 AS DOUBLE) AS Area_ha FROM parcels")
def area_report(spark, sf_dir):
    """Written with a byte-order mark, read back as a table."""
    path = f"{local(folder(spark, 'report'))}/areas.csv"
    layer = view(spark, sf_dir, "parcels").select(F.col("name").alias("id"), g.area(F.col("ring")).alias("area"))
    sinks.write_table(sinks.area_report(layer), path, bom=True)
    return spark.read.csv(path, header=True, encoding="UTF-8", schema="ID_elemento string, Area_m2 double, Area_ha double")


@query(WEEDS + """, k AS (SELECT name, area, malezas, cultivo, malezas / nullif(CAST(malezas + cultivo AS DOUBLE), 0) AS v FROM n) SELECT name AS Parcela, CAST(area AS DOUBLE) AS Area_m2, malezas AS Num_Malezas, cultivo AS Num_Cultivo,
    round(v, 12) AS Cobertura_Malezas, CASE WHEN v IS NULL THEN 'Sin datos' WHEN v < 0.1 THEN 'Baja' WHEN v < 0.3 THEN 'Media' ELSE 'Alta' END AS Infestacion FROM k""")
def weed_report(spark, sf_dir):
    path = f"{local(folder(spark, 'report'))}/malezas.csv"
    sinks.write_table(sinks.weed_report(weed_result(spark, sf_dir)), path)
    return spark.read.csv(path, header=True, schema="Parcela string, Area_m2 double, Num_Malezas long, Num_Cultivo long, Cobertura_Malezas double, Infestacion string")


@query(f"SELECT name AS Parcela, count(pid) AS Num_Plantas FROM parcels LEFT JOIN points ON {INSIDE} GROUP BY name")
def count_report(spark, sf_dir):
    path = f"{local(folder(spark, 'report'))}/conteo.csv"
    sinks.write_table(sinks.count_report(spatial.count_points(view(spark, sf_dir, "points"), view(spark, sf_dir, "parcels"), "name", CELL)), path)
    return spark.read.csv(path, header=True, schema="Parcela string, Num_Plantas long")


@query("""SELECT 'surcos' AS capa, count(*) AS n, round(sum(x2 - x1), 6) AS long_m FROM segments UNION ALL SELECT 'fallas', count(*) FILTER (x2 - x1 < 10), round(coalesce(sum(x2 - x1) FILTER (x2 - x1 < 10), 0), 6) FROM segments
    UNION ALL SELECT 'vacia', 0, 0""")
def run_folder(spark, sf_dir):
    """A run's layers and its summary, read back; a layer without rows is in the summary alone."""
    rows = view(spark, sf_dir, "segments").withColumn("long_m", F.col("x2") - F.col("x1"))
    done = sinks.write_run(folder(spark, "run"), {"surcos": rows, "fallas": rows.filter("long_m < 10"), "vacia": rows.limit(0)})
    said = spark.read.schema("surcos struct<n:long,long_m:double>, fallas struct<n:long,long_m:double>, vacia struct<n:long,long_m:double>").json(f"{done['folder']}/resumen.json", multiLine=True)
    layers = F.explode(F.array(*[F.struct(F.lit(c).alias("capa"), F.col(f"{c}.n").alias("n"), F.round(f"{c}.long_m", 6).alias("long_m")) for c in said.columns]))
    stored = spark.read.parquet(f"{done['folder']}/surcos").agg(F.count(F.lit(1)).alias("stored"))
    return said.select(layers.alias("l")).select("l.*").join(F.broadcast(stored), (F.col("capa") != "surcos") | (F.col("n") == F.col("stored"))).drop("stored")
