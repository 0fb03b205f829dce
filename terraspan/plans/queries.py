"""Registered queries: each a DataFrame plan and, where SQL expresses it, the DuckDB text that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspan.functions import affine, detections as d, geometry as g, indices
from terraspan.operators import nms, overlay, raster, sequences, spatial, weeds
from terraspan.sources import vector

from .domain import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CELL = 200.0
T = affine.Affine(0.5, 0.0, 500_000.0, 0.0, -0.5, 8_200_000.0)
BOX = ("x1", "y1", "x2", "y2")

#: In DuckDB: whether point (x, y) lies strictly inside a parcel.
INSIDE = "x > x0 AND y > y0 AND CASE WHEN tri THEN (x - x0) + (y - y0) < 150 ELSE x < x0 + 150 AND y < y0 + 150 END"


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = with_views(oracle)
        return f

    return register


def r9(c, n=9):
    return F.round(c, n)


def pixel_points(spark, sf_dir):
    return view(spark, sf_dir, "pixels").withColumn("x", F.col("col") + F.lit(0.5)).withColumn("y", F.col("row") + F.lit(0.5))


@query(f"""WITH c AS (SELECT name, count(pid) AS n FROM parcels LEFT JOIN points ON {INSIDE} GROUP BY name),
    v AS (SELECT p.name, p.ord, n, CASE WHEN tri THEN 11250.0 ELSE 22500.0 END AS area FROM parcels p JOIN c USING (name)),
    k AS (SELECT *, n / area AS dens, row_number() OVER (ORDER BY n / area DESC NULLS LAST, ord) / CAST(count(*) OVER () AS DOUBLE) AS share FROM v)
    SELECT name, n AS num_plantas, CAST(area AS DOUBLE) AS area_m2, dens AS densidad, CASE WHEN share <= 1/3.0 THEN 'Alta' WHEN share <= 2/3.0 THEN 'Media' ELSE 'Baja' END AS clase FROM k""")
def parcel_density_class(spark, sf_dir):
    parcels = view(spark, sf_dir, "parcels")
    counts = spatial.count_points(view(spark, sf_dir, "points"), parcels, "name", CELL)
    out = parcels.join(counts, parcels["name"].cast("string") == counts["id"]).withColumn("area_m2", g.area(F.col("ring"))).withColumn("densidad", d.density(F.col("n"), F.col("area_m2")))
    return out.select("name", F.col("n").alias("num_plantas"), "area_m2", "densidad", d.ranked_class(F.col("densidad"), F.col("ord"), ("Alta", "Media", "Baja"), True).alias("clase"))


@query(f"SELECT name AS id, count(pid) AS n FROM parcels LEFT JOIN points ON {INSIDE} GROUP BY name")
def points_in_polygon_counts(spark, sf_dir):
    return spatial.count_points(view(spark, sf_dir, "points"), view(spark, sf_dir, "parcels"), "name", CELL)


@query("SELECT class AS class_name, count(*) AS n FROM detections WHERE conf >= 0.25 GROUP BY class")
def count_by_class(spark, sf_dir):
    return view(spark, sf_dir, "detections").filter("conf >= 0.25").groupBy(F.col("class").alias("class_name")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(min(red), 0) AS "min", coalesce(max(red), 0) AS "max", round(coalesce(avg(red), 0), 9) AS mean, round(coalesce(stddev_pop(red), 0), 6) AS std,
    coalesce(median(red), 0) AS median FROM pixels WHERE red <> 0""")
def raster_band_stats(spark, sf_dir):
    return raster.band_statistics(view(spark, sf_dir, "pixels"), "red", 0.0).withColumns({"mean": r9(F.col("mean")), "std": r9(F.col("std"), 6)})


def zonal_sql(prefix: str, value: str, levels: tuple[float, float, float]) -> str:
    m = f"{prefix}_mean"
    return f"""WITH v AS (SELECT col + 0.5 AS x, "row" + 0.5 AS y, {value} AS v FROM pixels),
        s AS (SELECT name, avg(v) AS {m}, min(v) AS lo, max(v) AS hi, stddev_pop(v) AS sd FROM parcels LEFT JOIN v ON v IS NOT NULL AND {INSIDE} GROUP BY name)
        SELECT name, round({m}, 9) AS {m}, round(lo, 9) AS {prefix}_min, round(hi, 9) AS {prefix}_max, round(sd, 6) AS {prefix}_std,
        CASE WHEN {m} IS NULL THEN 'Sin datos' WHEN {m} >= {levels[0]} THEN 'Vigorosa' WHEN {m} >= {levels[1]} THEN 'Moderada' WHEN {m} >= {levels[2]} THEN 'Estresada' ELSE 'Suelo/Agua' END AS {prefix}_clase FROM s"""


def rounded(out: DataFrame, prefix: str) -> DataFrame:
    return out.withColumns({f"{prefix}_{c}": r9(F.col(f"{prefix}_{c}"), 6 if c == "std" else 9) for c in ("mean", "min", "max", "std")})


@query(zonal_sql("ndvi", "(nir - red) / nullif(nir + red, 0)", (0.6, 0.3, 0.1)))
def ndvi_zonal(spark, sf_dir):
    return rounded(raster.zonal(pixel_points(spark, sf_dir), view(spark, sf_dir, "parcels"), indices.ndvi(F.col("nir"), F.col("red")), "ndvi", CELL), "ndvi")


@query(zonal_sql("ndre", "(nir - edge) / nullif(nir + edge, 0)", (0.6, 0.3, 0.1)))
def ndre_zonal(spark, sf_dir):
    return rounded(raster.zonal(pixel_points(spark, sf_dir), view(spark, sf_dir, "parcels"), indices.ndre(F.col("nir"), F.col("edge")), "ndre", CELL), "ndre")


NODATA = "red = 0 AND green = 0 AND blue = 0"


@query(zonal_sql("exg", f"CASE WHEN NOT ({NODATA}) THEN (2 * green - red - blue) / nullif(red + green + blue, 0) END", (0.2, 0.05, -0.05)))
def exg_zonal(spark, sf_dir):
    return rounded(raster.zonal_rgb_index(pixel_points(spark, sf_dir), view(spark, sf_dir, "parcels"), "EXG", CELL, 0.0), "exg")


@query(zonal_sql("vari", f"CASE WHEN NOT ({NODATA}) THEN (green - red) / nullif(green + red - blue, 0) END", (0.2, 0.05, -0.1)))
def vari_zonal(spark, sf_dir):
    return rounded(raster.zonal_rgb_index(pixel_points(spark, sf_dir), view(spark, sf_dir, "parcels"), "vari", CELL, 0.0), "vari")


@query("""WITH v AS (SELECT (nir - red) / nullif(nir + red, 0) AS v FROM pixels) SELECT CASE WHEN v IS NULL THEN 'Sin datos' WHEN v >= 0.6 THEN 'Vigorosa'
    WHEN v >= 0.3 THEN 'Moderada' WHEN v >= 0.1 THEN 'Estresada' ELSE 'Suelo/Agua' END AS clase, count(*) AS n FROM v GROUP BY 1""")
def vigour_class(spark, sf_dir):
    return view(spark, sf_dir, "pixels").groupBy(indices.classify(indices.ndvi(F.col("nir"), F.col("red"))).alias("clase")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT "row", col, CAST(500000 + 0.5 * (col + 0.5) AS DOUBLE) AS x, CAST(8200000 - 0.5 * ("row" + 0.5) AS DOUBLE) AS y FROM pixels""")
def pixel_to_coords(spark, sf_dir):
    x, y = affine.pixel_to_coords(F.col("row"), F.col("col"), T)
    return view(spark, sf_dir, "pixels").select("row", "col", x.alias("x"), y.alias("y"))


@query("SELECT pid, CAST(floor((8200000 - y) / 0.5) AS BIGINT) AS \"row\", CAST(floor((x - 500000) / 0.5) AS BIGINT) AS col FROM points")
def coords_to_pixel(spark, sf_dir):
    row, col = affine.coords_to_pixel(F.col("x"), F.col("y"), T)
    return view(spark, sf_dir, "points").select("pid", row.alias("row"), col.alias("col"))


@query("SELECT id, CAST((CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END) + least(floor((lon + 180) / 6) + 1, 60) AS INTEGER) AS epsg FROM lonlat")
def utm_zone(spark, sf_dir):
    return view(spark, sf_dir, "lonlat").select("id", g.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))


@query("""SELECT name, CAST(CASE WHEN tri THEN 11250 ELSE 22500 END AS DOUBLE) AS area, round(CASE WHEN tri THEN 300 + sqrt(45000.0) ELSE 600 END, 9) AS perimeter,
    CASE WHEN tri THEN x0 + 50 ELSE x0 + 75 END AS cx, CASE WHEN tri THEN y0 + 50 ELSE y0 + 75 END AS cy FROM parcels""")
def polygon_area_perimeter_centroid(spark, sf_dir):
    c = g.centroid(F.col("ring"))
    return view(spark, sf_dir, "parcels").select("name", g.area(F.col("ring")).alias("area"), r9(g.perimeter(F.col("ring"))).alias("perimeter"), r9(c["x"]).alias("cx"), r9(c["y"]).alias("cy"))


@query("""SELECT r.v AS row_off, c.v AS col_off, least(128, 1000 - r.v) AS h, least(128, 1000 - c.v) AS w FROM (SELECT unnest(range(0, 1000, 102)) AS v) r
    CROSS JOIN (SELECT unnest(range(40, 1000, 102)) AS v) c""")
def tile_grid(spark, sf_dir):
    return raster.tile_offsets(spark, 1000, 1000, 128, 0.2, (0, 40, 1200, 1000))


@query("""WITH t AS (SELECT CAST(floor("row" / 100.0) AS BIGINT) AS tile_row, CAST(floor(col / 100.0) AS BIGINT) AS tile_col, avg(CASE WHEN red <> 0 THEN 1.0 ELSE 0.0 END) AS f FROM pixels GROUP BY 1, 2)
    SELECT tile_row, tile_col, round(f, 9) AS valid_fraction FROM t WHERE f >= 0.5""")
def tile_valid_fraction(spark, sf_dir):
    return raster.valid_tiles(view(spark, sf_dir, "pixels"), 100, 0.0, 0.5, "red").withColumn("valid_fraction", r9(F.col("valid_fraction")))


@query("""SELECT id, (x1 + x2) / 2 + 30 AS px, (y1 + y2) / 2 + 20 AS py, 500000 + 0.5 * ((x1 + x2) / 2 + 30.5) AS gx, 8200000 - 0.5 * ((y1 + y2) / 2 + 20.5) AS gy,
    500000 + 0.5 * (x1 + 30.5) AS west, 8200000 - 0.5 * (y1 + 20.5) AS north, 500000 + 0.5 * (x2 + 30.5) AS east, 8200000 - 0.5 * (y2 + 20.5) AS south FROM detections""")
def detection_shift_georef(spark, sf_dir):
    moved = view(spark, sf_dir, "detections").withColumns({c: F.col(c) + (30 if c[0] == "x" else 20) for c in BOX})
    moved = moved.withColumn("px", (F.col("x1") + F.col("x2")) / 2).withColumn("py", (F.col("y1") + F.col("y2")) / 2)
    gx, gy = affine.pixel_to_coords(F.col("py"), F.col("px"), T)
    box = d.corners(*[F.col(c) for c in BOX], T)
    return moved.select("id", "px", "py", gx.alias("gx"), gy.alias("gy"), box[0]["x"].alias("west"), box[0]["y"].alias("north"), box[2]["x"].alias("east"), box[2]["y"].alias("south"))


WEEDS = f"""WITH dp AS (SELECT *, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, lower(class) IN ('weed', 'weeds', 'maleza', 'malezas') AS weed FROM detections),
    c AS (SELECT name, ord, tri, count(*) FILTER (weed) AS malezas, count(*) FILTER (NOT weed) AS cultivo FROM parcels LEFT JOIN dp ON {INSIDE} GROUP BY name, ord, tri),
    n AS (SELECT name, ord, CASE WHEN tri THEN 11250.0 ELSE 22500.0 END AS area, malezas, cultivo FROM c)"""


def weeds_by_parcel(spark, sf_dir, only=None):
    """Weeds and crops in each parcel and whether the data set has crops; ``only`` restricts the classes."""
    parcels = view(spark, sf_dir, "parcels").withColumn("area", g.area(F.col("ring")))
    found = view(spark, sf_dir, "detections")
    found = found if only is None else found.filter(F.col("class").isin(*only))
    weed, has_crop = d.weed_split(found)
    points = found.select("class", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), weed.alias("weed"))
    inside = spatial.points_within(points, parcels.select("name", "ring"), CELL).groupBy("name").agg(F.count_if("weed").alias("malezas"), F.count_if(~F.col("weed")).alias("cultivo"))
    return parcels.select("name", "ord", "area").join(inside, "name", "left").na.fill(0, ["malezas", "cultivo"]), has_crop


def weed_result(spark, sf_dir, only=None):
    found, has_crop = weeds_by_parcel(spark, sf_dir, only)
    ratio = d.weed_coverage(F.col("malezas"), F.col("cultivo"), F.col("area"), has_crop)
    return found.select("name", "area", "malezas", "cultivo", F.round(ratio, 12).alias("cobertura"), d.infestation_class(ratio).alias("infestacion"))


def weed_sql(only, weed, has_crop):
    ratio = "malezas / nullif(CAST(malezas + cultivo AS DOUBLE), 0)" if has_crop else "malezas / area"
    chosen = "WHERE class IN (" + ", ".join(f"'{c}'" for c in only) + ")" if only else ""
    return f"""WITH dp AS (SELECT *, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y, {weed} AS weed FROM detections {chosen}),
        c AS (SELECT name, tri, count(*) FILTER (weed) AS malezas, count(*) FILTER (NOT weed) AS cultivo FROM parcels LEFT JOIN dp ON {INSIDE} GROUP BY name, tri),
        n AS (SELECT name, CAST(CASE WHEN tri THEN 11250.0 ELSE 22500.0 END AS DOUBLE) AS area, malezas, cultivo FROM c), k AS (SELECT *, {ratio} AS v FROM n)
        SELECT name, area, malezas, cultivo, round(v, 12) AS cobertura, CASE WHEN v IS NULL THEN 'Sin datos' WHEN v < 0.1 THEN 'Baja' WHEN v < 0.3 THEN 'Media' ELSE 'Alta' END AS infestacion FROM k"""


@query(weed_sql(("Maleza", "weed"), "true", False))
def weeds_only_by_area(spark, sf_dir):
    """A data set of weeds alone: coverage is weeds a square metre."""
    return weed_result(spark, sf_dir, ("Maleza", "weed"))


@query(weed_sql(("crop", "planta"), "class <> 'crop'", True))
def weeds_by_exclusion(spark, sf_dir):
    """No weed names: what isn't crop is weed."""
    return weed_result(spark, sf_dir, ("crop", "planta"))


@query(WEEDS + """ SELECT name, malezas, cultivo, round(malezas / nullif(CAST(malezas + cultivo AS DOUBLE), 0), 9) AS cobertura, CASE WHEN malezas + cultivo = 0 THEN 'Sin datos'
    WHEN malezas / CAST(malezas + cultivo AS DOUBLE) < 0.1 THEN 'Baja' WHEN malezas / CAST(malezas + cultivo AS DOUBLE) < 0.3 THEN 'Media' ELSE 'Alta' END AS infestacion FROM n""")
def weed_coverage_class(spark, sf_dir):
    return weed_result(spark, sf_dir).select("name", "malezas", "cultivo", r9(F.col("cobertura")).alias("cobertura"), "infestacion")


@query(WEEDS + """, k AS (SELECT *, malezas / area AS dens, row_number() OVER (ORDER BY malezas / area NULLS LAST, ord) / CAST(count(*) OVER () AS DOUBLE) AS share FROM n)
    SELECT name, round(dens, 12) AS densidad, CASE WHEN share <= 1/3.0 THEN 'Baja' WHEN share <= 2/3.0 THEN 'Media' ELSE 'Alta' END AS clase,
    CASE WHEN share <= 1/3.0 THEN '#1a9641' WHEN share <= 2/3.0 THEN '#fdae61' ELSE '#d7191c' END AS color_hex FROM k""")
def infestation_rank_class(spark, sf_dir):
    dens = d.density(F.col("malezas"), F.col("area"))
    out = weeds_by_parcel(spark, sf_dir)[0].withColumn("clase", d.ranked_class(dens, F.col("ord"), ("Baja", "Media", "Alta"), False))
    return out.select("name", F.round(dens, 12).alias("densidad"), "clase", d.colour(F.col("clase")).alias("color_hex"))


@query("""WITH m AS (SELECT line, row_number() OVER (PARTITION BY line ORDER BY pos) - 1 AS i, v < 50 AS f, count(*) OVER (PARTITION BY line) AS n FROM signal),
    t AS (SELECT *, i - row_number() OVER (PARTITION BY line ORDER BY i) AS g FROM m WHERE f), s AS (SELECT line, g, n, min(i) AS "start", max(i) + 1 AS "end" FROM t GROUP BY line, g, n)
    SELECT line, "start", "end", n FROM s WHERE "start" > 0 AND "end" < n AND "end" - "start" >= 2""")
def row_runs_gaps(spark, sf_dir):
    return sequences.inner_gaps(sequences.runs(view(spark, sf_dir, "signal"), ["line"], "pos", F.col("v") < 50))


@query("""WITH g AS (SELECT *, sqrt((lead(x1) OVER w - x2) ** 2 + (lead(y1) OVER w - y2) ** 2) AS gap FROM segments WINDOW w AS (PARTITION BY line ORDER BY x1, seg))
    SELECT line, seg, round(gap, 6) AS gap_m FROM g WHERE gap >= 100""")
def segment_gaps(spark, sf_dir):
    return sequences.gaps_between(view(spark, sf_dir, "segments"), ["line"], 100.0).select("line", "seg", r9(F.col("gap_m"), 6).alias("gap_m"))


@query("""WITH g AS (SELECT x2 - x1 AS len, lead(x1) OVER w - x2 AS gap FROM segments WINDOW w AS (PARTITION BY line ORDER BY x1, seg))
    SELECT count(*) AS surcos, sum(len) AS longitud_m, count(*) FILTER (gap >= 100) AS fallas FROM g""")
def row_summary(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("line").orderBy("x1", "seg")
    rows = view(spark, sf_dir, "segments").select((F.col("x2") - F.col("x1")).alias("len"), (F.lead("x1").over(w) - F.col("x2")).alias("gap"))
    return rows.agg(F.count(F.lit(1)).alias("surcos"), F.sum("len").alias("longitud_m"), F.count_if(F.col("gap") >= 100).alias("fallas"))


@query("SELECT count(*) AS continuos FROM (SELECT seg % 500 AS track FROM segments GROUP BY 1 HAVING count(DISTINCT line % 7) > 1)")
def track_continuity(spark, sf_dir):
    tracks = view(spark, sf_dir, "segments").groupBy((F.col("seg") % 500).alias("track")).agg(F.countDistinct(F.col("line") % 7).alias("parcels"))
    return tracks.filter("parcels > 1").agg(F.count(F.lit(1)).alias("continuos"))


OVERLAY = """WITH o AS (SELECT id, lid, x1, y1, x2, y2, (rx2 - rx1) * (ry2 - ry1) AS larea, greatest(x1, rx1) AS ix1, greatest(y1, ry1) AS iy1, least(x2, rx2) AS ix2, least(y2, ry2) AS iy2
    FROM detections JOIN labels_boxes ON x1 < rx2 AND rx1 < x2 AND y1 < ry2 AND ry1 < y2)"""


@query(OVERLAY + " SELECT id, lid, (ix2 - ix1) * (iy2 - iy1) AS overlap FROM o")
def bbox_overlay_intersection(spark, sf_dir):
    return spatial.overlay_boxes(view(spark, sf_dir, "detections"), view(spark, sf_dir, "labels_boxes"), 50.0).select("id", "lid", "overlap")


# boxes have whole corners, so a label's covered part is a number of unit cells
@query(OVERLAY + """, b AS (SELECT DISTINCT lid, larea, ix1, iy1, ix2, iy2 FROM o), u AS (SELECT DISTINCT lid, larea, unnest(range(CAST(ix1 AS BIGINT), CAST(ix2 AS BIGINT))) AS x, iy1, iy2 FROM b),
    c AS (SELECT DISTINCT lid, larea, x, unnest(range(CAST(iy1 AS BIGINT), CAST(iy2 AS BIGINT))) AS y FROM u), s AS (SELECT lid, 100.0 * count(*) / larea AS pct FROM c GROUP BY lid, larea),
    a AS (SELECT lid, coalesce(pct, 0) AS pct FROM labels_boxes LEFT JOIN s USING (lid))
    SELECT lid, round(pct, 9) AS cobertura_pct, CASE WHEN pct = 0 THEN 'Omitida' WHEN pct < 50 THEN 'Parcial' ELSE 'Mayormente cubierta' END AS resultado FROM a""")
def coverage_evaluation(spark, sf_dir):
    """How much of each label the union of the detections covers."""
    labels = view(spark, sf_dir, "labels_boxes")
    size = (F.col("rx2") - F.col("rx1")) * (F.col("ry2") - F.col("ry1"))
    met = spatial.covered_area(labels, view(spark, sf_dir, "detections"), "lid", 50.0)
    out = labels.join(met, "lid", "left").withColumn("pct", F.coalesce(100 * F.col("covered") / size, F.lit(0.0)))
    return out.select("lid", r9(F.col("pct")).alias("cobertura_pct"), d.coverage_result(F.col("pct")).alias("resultado"))


# rounds over all boxes that overlap others: 1 stays, -1 goes, 0 isn't decided
@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT a.id AS hi, b.id AS lo FROM detections a JOIN detections b ON a.class = b.class AND (a.conf > b.conf OR (a.conf = b.conf AND a.id > b.id))
      AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2
      WHERE (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
        - (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) > 0.45),
    r AS (SELECT 0 AS k, id, 0 AS st FROM (SELECT hi AS id FROM e UNION SELECT lo FROM e)
      UNION ALL SELECT k + 1, id, CASE WHEN st <> 0 THEN st WHEN above IS NULL OR (above = -1 AND low = -1) THEN 1 WHEN above = 1 THEN -1 ELSE 0 END FROM
      (SELECT r.k, r.id, r.st, max(h.st) AS above, min(h.st) AS low, min(min(abs(r.st))) OVER () AS left_over FROM r LEFT JOIN e ON e.lo = r.id LEFT JOIN r h ON h.id = e.hi GROUP BY r.k, r.id, r.st) WHERE left_over = 0)
    SELECT id, class, conf FROM detections WHERE id NOT IN (SELECT id FROM r WHERE st = -1)""")
def nms_kept(spark, sf_dir):
    return nms.suppress(view(spark, sf_dir, "detections"), 0.45, 50.0).select("id", "class", "conf")


@query("""WITH m AS (SELECT avg(red) AS mr, avg(green) AS mg, var_samp(red) + 1e-5 AS a, covar_samp(red, green) AS b, var_samp(green) + 1e-5 AS c FROM pixels),
    k AS (SELECT (c * (red - mr) ** 2 - 2 * b * (red - mr) * (green - mg) + a * (green - mg) ** 2) / (a * c - b * b) AS dist, mr, mg FROM pixels, m)
    SELECT round(min(mr), 9) AS mean_red, round(min(mg), 9) AS mean_green, round(quantile_cont(dist, 0.9), 6) AS cutoff, count(*) FILTER (round(dist, 6) <= 2) AS near FROM k""")
def reference_colour_fit(spark, sf_dir):
    p = view(spark, sf_dir, "pixels")
    model = weeds.fit_colour(p, ["red", "green"])
    near = F.count_if(F.round(model.distance(F.col("red"), F.col("green")), 6) <= 2).alias("near")
    mean = [F.round(F.lit(float(v)), 9).alias(n) for v, n in zip(model.mean, ("mean_red", "mean_green"), strict=True)]
    return p.agg(near).select(*mean, F.round(F.lit(model.cutoff), 6).alias("cutoff"), "near")


@query("""WITH k AS (SELECT score, y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored)
    SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * CAST(count(*) FILTER (y = 0) AS DOUBLE)), 9) AS auc FROM k""")
def pixel_auc(spark, sf_dir):
    return raster.auc(view(spark, sf_dir, "scored"), "score", "y").select(r9(F.col("auc")).alias("auc"))


@query("""WITH t AS (SELECT unnest([-0.4, -0.2, 0.0, 0.2, 0.4]::DOUBLE[]) AS t), g AS (SELECT t, grp, y, avg(CASE WHEN score >= t THEN 1.0 ELSE 0.0 END) AS rate FROM scored CROSS JOIN t GROUP BY t, grp, y)
    SELECT round(CAST(t AS DOUBLE), 3) AS t, round(avg(rate) FILTER (y = 1), 9) AS recall, round(avg(rate) FILTER (y = 0), 9) AS fp_mean, round(max(rate) FILTER (y = 0), 9) AS fp_worst FROM g GROUP BY t""")
def threshold_sweep(spark, sf_dir):
    """Recall and false positives as means of group means, for a fixed list of thresholds."""
    steps = F.explode(F.array(*[F.lit(round(x / 10 - 0.4, 3)) for x in (0, 2, 4, 6, 8)]))
    groups = view(spark, sf_dir, "scored").withColumn("t", steps).groupBy("t", "grp", "y").agg(F.avg(F.when(F.col("score") >= F.col("t"), 1.0).otherwise(0.0)).alias("rate"))
    of = lambda f, y: r9(f(F.when(F.col("y") == y, F.col("rate"))))
    return groups.groupBy("t").agg(of(F.avg, 1).alias("recall"), of(F.avg, 0).alias("fp_mean"), of(F.max, 0).alias("fp_worst"))


@query("""WITH w AS (SELECT vec_id, 1.0 / count(*) OVER (PARTITION BY grp) AS w FROM scored) SELECT vec_id, round(w / avg(w) OVER (), 9) AS weight FROM w""")
def balanced_weights(spark, sf_dir):
    return weeds.balanced(view(spark, sf_dir, "scored"), "grp").select("vec_id", r9(F.col("weight")).alias("weight"))


@query("""WITH m AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a FROM signal WINDOW w AS (PARTITION BY line ORDER BY pos)) SELECT line, pos, v FROM m WHERE v > b AND v > a""")
def local_maxima(spark, sf_dir):
    return sequences.local_maxima(view(spark, sf_dir, "signal"), ["line"], ["pos"], "v")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY pos) AS i FROM signal), s AS (SELECT a.line, a.pos, sum(b.v * exp(-0.5 * (b.i - a.i) ** 2)) / sum(exp(-0.5 * (b.i - a.i) ** 2)) AS v
    FROM k a JOIN k b ON a.line = b.line AND abs(a.i - b.i) <= 4 GROUP BY a.line, a.pos) SELECT line, pos, round(v, 6) AS smooth FROM s""")
def gaussian_smoothing(spark, sf_dir):
    return sequences.gaussian_smooth(view(spark, sf_dir, "signal"), ["line"], ["pos"], "v", 1.0).select("line", "pos", r9(F.col("smooth"), 6).alias("smooth"))


@query("SELECT line, pos FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY pos) AS i FROM signal) WHERE i % 5 = 1")
def stride_sample(spark, sf_dir):
    return sequences.one_in(view(spark, sf_dir, "signal"), ["line"], ["pos"], 5).select("line", "pos")


@query("SELECT class, id, area FROM (SELECT class, id, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY class ORDER BY (x2 - x1) * (y2 - y1) DESC, id) AS k FROM detections) WHERE k <= 6")
def largest_by_class(spark, sf_dir):
    boxes = view(spark, sf_dir, "detections").withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    return sequences.first_of_group(boxes, ["class"], [F.col("area").desc(), F.col("id")], 6).select("class", "id", "area")


@query("SELECT count(*) AS n, count(*) FILTER (contains(lower(text), 'gap') OR contains(lower(text), 'falla') OR contains(lower(text), 'omitid') OR contains(lower(text), 'vacio') OR contains(lower(text), 'vacío') OR contains(lower(text), 'no sembr') OR contains(lower(text), 'no_sembr')) AS unsown FROM documents")
def unsown_keywords(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.count(F.lit(1)).alias("n"), F.count_if(d.looks_unsown(F.col("text"))).alias("unsown"))


@query("SELECT c_custkey AS id, split_part(c_name || '|layername=' || c_mktsegment, '|', 1) AS path FROM customer")
def layer_path_strip(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), d.layer_path(F.concat("c_name", F.lit("|layername="), "c_mktsegment")).alias("path"))


@query("""SELECT p_partkey AS id, round(17.3 * p_retailprice / nullif(24.0 * (p_size % 3) * 1000, 0), 9) AS gsd, greatest(1, CAST(round_even(p_size * p_retailprice / 1000 / 0.5, 0) AS BIGINT)) AS pixels FROM part""")
def photo_gsd(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    gsd = d.ground_sample_distance(F.col("p_retailprice"), F.lit(24.0), (F.col("p_size") % 3) * 1000)
    return p.select(F.col("p_partkey").alias("id"), r9(gsd).alias("gsd"), d.resampled_size(F.col("p_size"), F.col("p_retailprice") / 1000, F.lit(0.5)).alias("pixels"))


@query("""SELECT count(*) AS n, count(*) FILTER ((2 * green - red - blue) / (red + green + blue + 1) > 0.12 AND green > 1.08 * red AND green > 1.08 * blue) AS vegetation FROM pixels""")
def vegetation_mask(spark, sf_dir):
    return view(spark, sf_dir, "pixels").agg(F.count(F.lit(1)).alias("n"), F.count_if(indices.is_vegetation(F.col("red"), F.col("green"), F.col("blue"))).alias("vegetation"))


@query("""WITH b AS (SELECT lid AS id, rx1 AS x1, ry1 AS y1, rx2 AS x2, ry2 AS y2, (rx2 - rx1) * (ry2 - ry1) > 100 AS big FROM labels_boxes), n AS (SELECT *, CASE WHEN big THEN ceil((x2 - x1) / 10) ELSE 1 END AS nx,
    CASE WHEN big THEN ceil((y2 - y1) / 10) ELSE 1 END AS ny FROM b) SELECT id, count(*) AS pieces, round(sum((x2 - x1) / nx * (y2 - y1) / ny), 6) AS area, round(max((x2 - x1) / nx * (y2 - y1) / ny), 6) AS largest
    FROM n, unnest(range(CAST(nx * ny AS BIGINT))) GROUP BY id""")
def piece_split(spark, sf_dir):
    boxes = view(spark, sf_dir, "labels_boxes").select(F.col("lid").alias("id"), *[F.col(f"r{c}").alias(c) for c in BOX])
    size = (F.col("px2") - F.col("px1")) * (F.col("py2") - F.col("py1"))
    return spatial.split_by_area(boxes, 100.0).groupBy("id").agg(F.count(F.lit(1)).alias("pieces"), F.round(F.sum(size), 6).alias("area"), F.round(F.max(size), 6).alias("largest"))


@query("SELECT p.pid, s.lid, round(sqrt((p.x - s.rx1) ** 2 + (p.y - s.ry1) ** 2), 9) AS distance FROM points p JOIN labels_boxes s ON (p.x - s.rx1) ** 2 + (p.y - s.ry1) ** 2 < 16")
def near_join(spark, sf_dir):
    others = view(spark, sf_dir, "labels_boxes").select("lid", F.col("rx1").alias("ox"), F.col("ry1").alias("oy"))
    return spatial.near(view(spark, sf_dir, "points"), others, 4.0).select("pid", "lid", r9(F.col("distance")).alias("distance"))


@query("""SELECT min(x0) AS minx, min(y0) AS miny, max(x0) + 150 AS maxx, max(y0) + 150 AS maxy, CAST(sum(CASE WHEN tri THEN 11250.0 ELSE 22500.0 END) AS DOUBLE) AS area_m2,
    round(sum(CASE WHEN tri THEN 300 + sqrt(45000.0) ELSE 600 END), 6) AS perimeter_m, CAST(sum(CASE WHEN tri THEN 1.125 ELSE 2.25 END) AS DOUBLE) AS area_ha, count(*) AS features, 32720 AS srid,
    'Polygon' AS kind, 'string' AS type_of_name FROM parcels""")
def layer_metadata(spark, sf_dir):
    found = vector.layer_metadata(view(spark, sf_dir, "parcels").select("name", "grp", "ring"), 32720)
    return found.withColumns({"perimeter_m": r9(F.col("perimeter_m"), 6), "type_of_name": F.col("fields")["name"]}).drop("fields")


@query("""SELECT a."row", a.col FROM pixels a JOIN pixels b ON a."row" = b.col AND a.col = b."row" WHERE a.red >= 100 AND b.nir >= 30 AND a.red <> 255 AND b.nir <> 255""")
def score_consensus(spark, sf_dir):
    p = view(spark, sf_dir, "pixels")
    first, second = p.select("row", "col", F.col("red").alias("s3")), p.select(F.col("col").alias("row"), F.col("row").alias("col"), F.col("nir").alias("s4"))
    return first.filter("s3 >= 100 and s3 <> 255").join(second.filter("s4 >= 30 and s4 <> 255"), ["row", "col"]).select("row", "col")


@query(f"""SELECT grp, name, CAST(count(pid) AS BIGINT) AS n FROM parcels LEFT JOIN points ON {INSIDE} GROUP BY ROLLUP (grp, name)""")
def rollup_report(spark, sf_dir):
    """An extension: counts by region and parcel with subtotals."""
    parcels = view(spark, sf_dir, "parcels")
    counts = spatial.count_points(view(spark, sf_dir, "points"), parcels, "name", CELL)
    return parcels.join(counts, parcels["name"] == counts["id"]).rollup("grp", "name").agg(F.sum("n").alias("n"))


@query("""WITH p AS (SELECT CAST(floor("row" / 250.0) AS BIGINT) AS tile, red, nir FROM pixels), q AS (SELECT tile, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi
      FROM (SELECT tile, red AS v FROM p UNION ALL SELECT tile, nir FROM p) GROUP BY tile), k AS (SELECT tile, floor(greatest(0.0, least(1.0, (red - lo) / (hi - lo))) * 255) AS a, floor(greatest(0.0, least(1.0, (nir - lo) / (hi - lo))) * 255) AS b FROM p JOIN q USING (tile))
    SELECT tile, CAST(sum(a) AS BIGINT) AS red_total, CAST(sum(b) AS BIGINT) AS nir_total FROM k GROUP BY tile""")
def tile_to_uint8(spark, sf_dir):
    p = view(spark, sf_dir, "pixels").select(F.floor(F.col("row") / 250).alias("tile"), "red", "nir")
    return raster.to_uint8(p, ["tile"], ["red", "nir"]).groupBy("tile").agg(F.sum("red_u8").alias("red_total"), F.sum("nir_u8").alias("nir_total"))


def label_shapes(spark, sf_dir):
    corners = [(F.col("rx1"), F.col("ry1")), (F.col("rx2"), F.col("ry1")), (F.col("rx2"), F.col("ry2")), (F.col("rx1"), F.col("ry2"))]
    return view(spark, sf_dir, "labels_boxes").select("lid", F.array(g.ring(*corners)).alias("rings"))


def parcel_shapes(spark, sf_dir):
    return view(spark, sf_dir, "parcels").select("name", "ord", F.array("ring").alias("rings"))


# the part of a box below a triangle's slope is a sum of four corner triangles
@query("""WITH c AS (SELECT name, lid, tri, greatest(rx1 - x0, 0) AS a, greatest(ry1 - y0, 0) AS b, least(rx2 - x0, 150) AS c, least(ry2 - y0, 150) AS d FROM parcels JOIN labels_boxes
      ON rx1 < x0 + 150 AND x0 < rx2 AND ry1 < y0 + 150 AND y0 < ry2),
    s AS (SELECT name, lid, CASE WHEN tri THEN (power(greatest(0, 150 - a - b), 2) - power(greatest(0, 150 - c - b), 2) - power(greatest(0, 150 - a - d), 2) + power(greatest(0, 150 - c - d), 2)) / 2 ELSE (c - a) * (d - b) END AS area FROM c)
    SELECT name, lid, round(area, 4) AS area FROM s WHERE area > 0""")
def polygon_overlay_intersection(spark, sf_dir):
    found = overlay.intersections(parcel_shapes(spark, sf_dir), label_shapes(spark, sf_dir), CELL)
    return found.select("name", "lid", r9(F.col("area"), 4).alias("area"))


@query("""WITH u AS (SELECT DISTINCT lid % 4 AS grp, unnest(range(CAST(rx1 AS BIGINT), CAST(rx2 AS BIGINT))) AS x, ry1, ry2 FROM labels_boxes),
    c AS (SELECT DISTINCT grp, x, unnest(range(CAST(ry1 AS BIGINT), CAST(ry2 AS BIGINT))) AS y FROM u) SELECT grp, CAST(count(*) AS DOUBLE) AS area FROM c GROUP BY grp""")
def union_area_by_group(spark, sf_dir):
    pieces = overlay.dissolved(label_shapes(spark, sf_dir).withColumn("grp", F.col("lid") % 4), ["grp"], 40.0)
    return pieces.groupBy("grp").agg(r9(F.sum("area"), 4).alias("area"))


@query("""SELECT name, round(CASE WHEN tri THEN 11250 + (300 + 150 * sqrt(2)) * 10 ELSE 22500 + 6000 END + 32 * sin(pi() / 32) * 100, 6) AS area FROM parcels""")
def buffer_area(spark, sf_dir):
    return overlay.buffered(parcel_shapes(spark, sf_dir), 10.0).select("name", r9(F.col("area"), 6).alias("area"))


@query("SELECT name, round(CASE WHEN tri THEN 11250 ELSE 22500 END - 2500.0, 6) AS area FROM parcels")
def parcel_minus_core(spark, sf_dir):
    x, y = F.col("x0") + 20, F.col("y0") + 20
    cores = view(spark, sf_dir, "parcels").select(F.array(g.ring((x, y), (x + 50, y), (x + 50, y + 50), (x, y + 50))).alias("rings"))
    pieces = overlay.differences(parcel_shapes(spark, sf_dir), cores, CELL)
    return pieces.groupBy("name").agg(r9(F.sum("area"), 6).alias("area"))


from . import analysis, files  # noqa: E402, F401  they register further queries
