"""Queries on geometry, neighbourhoods, samples and traced rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from terraspan.functions import detections as d, geometry as g
from terraspan.operators import chips, interrow, neighbours, overlay, patches, raster, rows, sequences, spatial, weeds

from .domain import view
from .queries import CELL, INSIDE, T, pixel_points, query, r9

# the Krueger series of the third order, on degrees of the customer's zone
UTM = """WITH n AS (SELECT 1 / 298.257223563 / (2 - 1 / 298.257223563) AS n), c AS (SELECT n, 6378137.0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS a, n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 AS a1,
    13 * n ** 2 / 48 - 3 * n ** 3 / 5 AS a2, 61 * n ** 3 / 240 AS a3, 2 * sqrt(n) / (1 + n) AS e FROM n),
    z AS (SELECT id, lat, lon, least(floor((lon + 180) / 6) + 1, 60) AS zone FROM lonlat), p AS (SELECT *, radians(lat) AS phi, radians(lon - (zone * 6 - 183)) AS lam FROM z, c),
    t AS (SELECT *, (exp(u) - exp(-u)) / 2 AS t FROM (SELECT *, atanh(sin(phi)) - e * atanh(e * sin(phi)) AS u FROM p)), x AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
    SELECT id, round(500000 + 0.9996 * a * (eta + a1 * cos(2 * xi) * (exp(2 * eta) - exp(-2 * eta)) / 2 + a2 * cos(4 * xi) * (exp(4 * eta) - exp(-4 * eta)) / 2 + a3 * cos(6 * xi) * (exp(6 * eta) - exp(-6 * eta)) / 2), 3) AS east,
    round(CASE WHEN lat >= 0 THEN 0 ELSE 10000000 END + 0.9996 * a * (xi + a1 * sin(2 * xi) * (exp(2 * eta) + exp(-2 * eta)) / 2 + a2 * sin(4 * xi) * (exp(4 * eta) + exp(-4 * eta)) / 2
      + a3 * sin(6 * xi) * (exp(6 * eta) + exp(-6 * eta)) / 2), 3) AS north FROM x"""


@query(UTM)
def utm_projection(spark, sf_dir):
    at = g.utm_xy(F.col("lon"), F.col("lat"), g.utm_epsg(F.col("lon"), F.col("lat")))
    return view(spark, sf_dir, "lonlat").select("id", F.round(at["x"], 3).alias("east"), F.round(at["y"], 3).alias("north"))


# a box between two parallels, less its middle ninth: closed form in the equal-area plane
@query("""WITH k AS (SELECT id, lat, sqrt(1 / 298.257223563 * (2 - 1 / 298.257223563)) AS e FROM lonlat), p AS (SELECT id, e, unnest([0, 1, 2, 3]) AS i, lat FROM k), s AS (SELECT id, i, e, sin(radians(lat + 0.01 * i)) AS s FROM p),
    q AS (SELECT id, i, 6378137.0 ** 2 / 2 * (1 - e * e) * (s / (1 - e * e * s * s) + atanh(e * s) / e) AS q FROM s), w AS (SELECT id, max(q) FILTER (i = 0) AS q0, max(q) FILTER (i = 1) AS q1, max(q) FILTER (i = 2) AS q2, max(q) FILTER (i = 3) AS q3 FROM q GROUP BY id)
    SELECT id, round((radians(0.03) * (q3 - q0) - radians(0.01) * (q2 - q1)) / 100, 2) AS area_100 FROM w""")
def ellipsoid_area(spark, sf_dir):
    """Hundreds of square metres of a box of 0.03 degrees with a hole of 0.01."""
    x, y = F.col("lon"), F.col("lat")
    box = lambda a, b: g.ring((x + a, y + a), (x + b, y + a), (x + b, y + b), (x + a, y + b))
    return view(spark, sf_dir, "lonlat").select("id", r9(g.ellipsoid_area(box(0.0, 0.03), F.array(box(0.01, 0.02))) / 100, 2).alias("area_100"))


def crossed(parcels):
    """Every second square with two corners exchanged, so that its ring crosses itself in the middle."""
    swapped = F.array(F.col("ring")[0], F.col("ring")[1], F.col("ring")[3], F.col("ring")[2])
    return parcels.withColumn("ring", F.when(~F.col("tri") & (F.col("ord") % 4 == 0), swapped).otherwise(F.col("ring")))


@query("SELECT name, NOT (NOT tri AND ord % 4 = 0) AS valid, CAST(CASE WHEN tri OR ord % 4 = 0 THEN 11250 ELSE 22500 END AS DOUBLE) AS repaired_area FROM parcels")
def ring_validity_and_repair(spark, sf_dir):
    p = crossed(view(spark, sf_dir, "parcels")).withColumn("valid", g.is_simple(F.col("ring")))
    return overlay.repaired(p.select("name", "valid", F.array("ring").alias("rings"))).select("name", "valid", r9(F.col("area"), 6).alias("repaired_area"))


@query("""SELECT name, CASE WHEN ord % 7 = 3 THEN 'sin CRS' WHEN ord % 5 = 4 THEN 'vacía' WHEN ord % 6 = 5 THEN 'no es un polígono' WHEN NOT tri AND ord % 4 = 0 THEN 'no válida' END AS problem FROM parcels""")
def parcel_input_problems(spark, sf_dir):
    p = crossed(view(spark, sf_dir, "parcels"))
    layer = p.select("name", F.when(F.col("ord") % 6 == 5, "Point").otherwise("Polygon").alias("kind"), F.when(F.col("ord") % 7 != 3, 32720).alias("srid"), F.when(F.col("ord") % 5 != 4, F.col("ring")).alias("ring"))
    return raster.parcel_problems(layer)


@query(f"""SELECT name, count(*) AS n FROM (SELECT *, col + 0.5 AS x, "row" + 0.5 AS y FROM pixels WHERE red <> 0 AND green <> 0 AND blue > 5) v JOIN parcels ON {INSIDE} GROUP BY name""")
def valid_pixels(spark, sf_dir):
    found = raster.valid_mask(pixel_points(spark, sf_dir).withColumn("alpha", F.greatest(F.col("blue") - 5, F.lit(0.0))), ["red", "green"], 0.0, "alpha", view(spark, sf_dir, "parcels"), CELL)
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p.pid, round(min(sqrt((p.x - s.rx1) ** 2 + (p.y - s.ry1) ** 2)), 9) AS distance FROM points p LEFT JOIN labels_boxes s ON (p.x - s.rx1) ** 2 + (p.y - s.ry1) ** 2 < 900 GROUP BY p.pid""")
def nearest_distance(spark, sf_dir):
    others = view(spark, sf_dir, "labels_boxes").select(F.col("rx1").alias("ox"), F.col("ry1").alias("oy"))
    near = spatial.nearest(view(spark, sf_dir, "points"), others, "pid", 30.0)
    return near.groupBy("pid").agg(r9(F.min("distance")).alias("distance"))


@query("""WITH n AS (SELECT p.pid, min(sqrt((p.x - s.rx1) ** 2 + (p.y - s.ry1) ** 2)) / 100 AS m FROM points p JOIN labels_boxes s ON (p.x - s.rx1) ** 2 + (p.y - s.ry1) ** 2 < 1600 GROUP BY p.pid)
    SELECT count(*) AS n, count(*) FILTER (m BETWEEN 0.18 AND 0.30 AND pid % 10 < 6) AS eligible FROM n""")
def between_rows(spark, sf_dir):
    """Places between rows, with a hundredth of a metre a pixel and coverage from the id."""
    others = view(spark, sf_dir, "labels_boxes").select(F.col("rx1").alias("ox"), F.col("ry1").alias("oy"))
    near = spatial.nearest(view(spark, sf_dir, "points"), others, "pid", 40.0).filter("distance is not null")
    return near.agg(F.count(F.lit(1)).alias("n"), F.count_if(d.is_between_rows(F.col("distance") / 100, F.col("pid") % 10 / 10)).alias("eligible"))


@query(f"""SELECT name, count(*) AS pixels, min(r) AS first_row, max(c) AS last_col FROM (SELECT r.v AS r, c.v AS c, c.v * 4 + 2.0 AS x, r.v * 4 + 2.0 AS y FROM (SELECT unnest(range(250)) AS v) r CROSS JOIN (SELECT unnest(range(250)) AS v) c) JOIN parcels ON {INSIDE} GROUP BY name""")
def rasterised_parcels(spark, sf_dir):
    found = spatial.rasterised(view(spark, sf_dir, "parcels").select("name", "ring"), "name", 4.0)
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("pixels"), F.min("row").alias("first_row"), F.max("col").alias("last_col"))


# a horizontal line within a square or below a slope
@query("""WITH l AS (SELECT seg, x1 % 1000 AS a, x1 % 1000 + (x2 - x1) AS b, (seg * 13) % 1000 + 0.25 AS y FROM segments), m AS (SELECT seg, name, greatest(a, x0) AS a, least(b, CASE WHEN tri THEN x0 + 150 - (y - y0) ELSE x0 + 150 END) AS b
    FROM l JOIN parcels ON y > y0 AND y < y0 + 150 AND a < x0 + 150 AND b > x0) SELECT seg, name, round(b - a, 6) AS length FROM m WHERE b - a > 0""")
def lines_in_parcels(spark, sf_dir):
    s = view(spark, sf_dir, "segments")
    a, y = F.col("x1") % 1000, (F.col("seg") * 13) % 1000 + F.lit(0.25)
    lines = s.select("seg", g.ring((a, y), (a + F.col("x2") - F.col("x1"), y)).alias("path"))
    return spatial.lines_within(lines, view(spark, sf_dir, "parcels").select("name", "ring"), CELL).select("seg", "name", r9(F.col("length"), 6).alias("length"))


@query("""WITH s AS (SELECT line, pos // 7 AS place, avg(v) AS v FROM signal GROUP BY 1, 2), k AS (SELECT *, lead(place) OVER w AS np, lead(v) OVER w AS nv FROM s WINDOW w AS (PARTITION BY line ORDER BY place)),
    f AS (SELECT line, unnest(range(place, coalesce(np, place + 1))) AS here, place, v, np, nv FROM k) SELECT line, count(*) AS places, round(sum(v + coalesce((here - place) / CAST(np - place AS DOUBLE) * (nv - v), 0)), 4) AS total FROM f GROUP BY line""")
def interpolated_signal(spark, sf_dir):
    s = view(spark, sf_dir, "signal").groupBy("line", F.floor(F.col("pos") / 7).alias("place")).agg(F.avg("v").alias("v"))
    return sequences.interpolate(s, ["line"], "place", "v").groupBy("line").agg(F.count(F.lit(1)).alias("places"), r9(F.sum("value"), 4).alias("total"))


@query("""WITH a AS (SELECT class, id, (x2 - x1) * (y2 - y1) AS area FROM detections), r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY area DESC, id) AS i, row_number() OVER (PARTITION BY class ORDER BY area, id) AS j FROM a)
    SELECT class, max(id) FILTER (i = 1) AS largest, max(id) FILTER (j = 1) AS smallest FROM r GROUP BY class""")
def extreme_boxes(spark, sf_dir):
    boxes = view(spark, sf_dir, "detections").withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    return sequences.extremes(boxes, ["class"], "area", "id")


@query("""WITH k AS (SELECT line, pos, row_number() OVER (PARTITION BY line ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY line) AS n FROM signal), w AS (SELECT DISTINCT line, n, unnest(range(9)) * (n - 1) // 8 AS i FROM (SELECT DISTINCT line, n FROM k WHERE n > 9))
    SELECT line, pos FROM k JOIN w USING (line, n, i) UNION ALL SELECT line, pos FROM k WHERE n <= 9""")
def evenly_spaced_ranks(spark, sf_dir):
    return sequences.evenly_spaced(view(spark, sf_dir, "signal"), ["line"], [F.col("pos")], 9).select("line", "pos")


@query("SELECT grp, vec_id FROM (SELECT grp, vec_id, row_number() OVER (PARTITION BY grp ORDER BY md5(concat(vec_id, '/42')), CAST(vec_id AS VARCHAR)) AS i FROM scored) WHERE i <= 20")
def group_sample(spark, sf_dir):
    return sequences.sample_of_group(view(spark, sf_dir, "scored"), ["grp"], F.col("vec_id").cast("string"), 20).select("grp", "vec_id")


@query("""WITH t AS (SELECT unnest(range(20)) AS k), s AS (SELECT grp, y, least(1.0, 0.7 + score * 2 + y * 0.1) AS score FROM scored), g AS (SELECT k, grp, y, avg(CASE WHEN score >= round(0.60 + 0.02 * k, 2) THEN 1.0 ELSE 0.0 END) AS rate FROM s CROSS JOIN t GROUP BY ALL),
    r AS (SELECT k, coalesce(avg(rate) FILTER (y = 1), 0) AS recall, coalesce(avg(rate) FILTER (y = 0), 0) AS fp, coalesce(max(rate) FILTER (y = 0), 0) AS worst FROM g GROUP BY k), o AS (SELECT * FROM r WHERE fp <= 0.03 AND worst <= 0.10 AND k >= 10),
    b AS (SELECT k, recall FROM o ORDER BY recall DESC, k LIMIT 1) SELECT round(CAST(0.60 + 0.02 * coalesce((SELECT k FROM b), 19) AS DOUBLE), 2) AS threshold, round(coalesce((SELECT recall FROM b), (SELECT recall FROM r WHERE k = 19)), 9) AS recall""")
def threshold_choice(spark, sf_dir):
    scored = view(spark, sf_dir, "scored").withColumn("score", F.least(F.lit(1.0), F.lit(0.7) + F.col("score") * 2 + F.col("y") * 0.1))
    t, recall = weeds.choose_threshold(scored, "grp", "y")
    return spark.createDataFrame([(t, round(recall, 9))], "threshold double, recall double")


CELLS = """SELECT DISTINCT CAST(floor("row" / 4.0) AS BIGINT) AS r, CAST(floor(col / 4.0) AS BIGINT) AS c FROM pixels WHERE red >= 120"""


@query(f"""WITH RECURSIVE m AS MATERIALIZED ({CELLS}), e AS MATERIALIZED (SELECT a.r * 1000 + a.c AS a, b.r * 1000 + b.c AS b FROM m a JOIN (SELECT unnest([-1, 1, 0, 0]) AS dr, unnest([0, 0, -1, 1]) AS dc) o ON true JOIN m b ON b.r = a.r + o.dr AND b.c = a.c + o.dc),
    t AS (SELECT r * 1000 + c AS v, r * 1000 + c AS root FROM m UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.v WHERE t.root < e.b), w AS (SELECT v, min(root) AS root FROM t GROUP BY v)
    SELECT size, count(*) AS n FROM (SELECT root, count(*) AS size FROM w GROUP BY root) GROUP BY size""")
def component_sizes(spark, sf_dir):
    """Sizes of four-connected patches of bright cells, found over tiles of 32 cells."""
    at = lambda c: F.floor(F.col(c) / 4).alias(c)
    cells = view(spark, sf_dir, "pixels").filter("red >= 120").select(at("row"), at("col"))
    sizes = patches.components(cells, 32).groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS n FROM (SELECT DISTINCT r + dr AS r, c + dc AS c FROM ({CELLS}) m, (SELECT unnest([0, -1, 1, 0, 0]) AS dr, unnest([0, 0, 0, -1, 1]) AS dc) o)")
def grown_cells(spark, sf_dir):
    """Cells of the closing's first half, as the closing of a mask that is spread out twice has them: closing changes nothing of what is grown already."""
    at = lambda c: F.floor(F.col(c) / 4).alias(c)
    cells = view(spark, sf_dir, "pixels").filter("red >= 120").select(at("row"), at("col")).distinct()
    cross = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))]))
    grown = cells.withColumn("o", cross).select((F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col")).distinct()
    return weeds.closing(grown).join(grown, ["row", "col"], "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT name, CAST(7 + ord % 4 AS BIGINT) AS surcos, CAST(ord % 3 AS BIGINT) AS fallas FROM parcels")
def traced_rows(spark, sf_dir):
    """Rows and gaps of one scene a parcel, drawn from its number: 7 to 10 lines of plants 1.2 m apart, up to two of them interrupted for 3 m."""
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("parcela_id"), F.col("n_nationkey").cast("long").alias("ord"))
    schema = f"parcela_id string, piece long, h int, w int, signal binary, valid binary, transform array<double>, rings array<{rows.LINE}>"

    def draw(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                n = 7 + r.ord % 4
                h, w = 24 * n + 8, 400
                signal = np.zeros((h, w), np.float32)
                for i in range(n):
                    signal[24 * i + 13 : 24 * i + 20] = 0.35
                for i in range(r.ord % 3):
                    signal[24 * (2 * i + 1) + 13 : 24 * (2 * i + 1) + 20, 150:210] = 0
                x, y, s = T.c, T.f, 0.05
                ring = [{"x": x + a, "y": y - b} for a, b in ((0.1, 0.1), (w * s - 0.1, 0.1), (w * s - 0.1, h * s - 0.1), (0.1, h * s - 0.1))]
                out.append((r.parcela_id, 0, h, w, signal.tobytes(), np.ones(h * w, np.uint8).tobytes(), [s, 0.0, x, 0.0, -s, y], [ring]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    found, gaps = rows.trace_pieces(names.mapInPandas(draw, schema), rows.RowOptions(spacing_m=1.2))
    count = lambda df, n: df.groupBy(F.col("parcela_id").alias("name")).agg(F.count(F.lit(1)).alias(n))
    whole = names.select(F.col("parcela_id").alias("name")).join(count(found, "surcos"), "name", "left").join(count(gaps, "fallas"), "name", "left")
    return whole.na.fill(0, ["surcos", "fallas"])



# places a third of a pixel off; missing pixels give their weight to the others
@query("""WITH q AS (SELECT pid, y + 0.3 - 0.5 AS u, x + 0.45 - 0.5 AS v FROM points), f AS (SELECT pid, floor(u) AS r, floor(v) AS c, u - floor(u) AS a, v - floor(v) AS b FROM q),
    k AS (SELECT pid, r + i AS r, c + j AS c, CASE WHEN i = 1 THEN a ELSE 1 - a END * CASE WHEN j = 1 THEN b ELSE 1 - b END AS w FROM f, (SELECT unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j))
    SELECT pid, round(sum(w * red) / sum(w), 9) AS red, round(sum(w * nir) / sum(w), 9) AS nir FROM k JOIN pixels p ON p."row" = k.r AND p.col = k.c GROUP BY pid""")
def bilinear_samples(spark, sf_dir):
    places = view(spark, sf_dir, "points").select("pid", (F.col("y") + F.lit(0.3)).alias("row"), (F.col("x") + F.lit(0.45)).alias("col"))
    return neighbours.bilinear(places, view(spark, sf_dir, "pixels"), ["pid"], ["red", "nir"]).select("pid", r9(F.col("red")).alias("red"), r9(F.col("nir")).alias("nir"))


@query(f"""WITH RECURSIVE m AS MATERIALIZED ({CELLS}), e AS MATERIALIZED (SELECT a.r * 1000 + a.c AS a, b.r * 1000 + b.c AS b FROM m a JOIN (SELECT unnest([-1, 1, 0, 0]) AS dr, unnest([0, 0, -1, 1]) AS dc) o ON true JOIN m b ON b.r = a.r + o.dr AND b.c = a.c + o.dc),
    t AS (SELECT r * 1000 + c AS v, r * 1000 + c AS root FROM m UNION SELECT e.b, t.root FROM t JOIN e ON e.a = t.v WHERE t.root < e.b), w AS (SELECT v, min(root) AS root FROM t GROUP BY v),
    l AS (SELECT CAST(floor((y0 + 75) / 4) AS BIGINT) AS lr, CAST(x0 / 4 AS BIGINT) + i AS lc FROM parcels, (SELECT unnest(range(38)) AS i)),
    n AS (SELECT m.r, m.c, min(sqrt((m.r - lr) ** 2 + (m.c - lc) ** 2)) * 0.02 AS d FROM m JOIN l ON lr BETWEEN m.r - 16 AND m.r + 16 AND lc BETWEEN m.c - 16 AND m.c + 16 GROUP BY m.r, m.c),
    g AS (SELECT k, exp(-0.5 * (k / 10.0) ** 2) AS g FROM (SELECT unnest(range(-40, 41)) AS k)), h AS (SELECT k, g / sum(g) OVER () AS g FROM g),
    x AS MATERIALIZED (SELECT r, c + k AS c, sum(g) AS s FROM (SELECT r, c FROM m UNION ALL SELECT r, -1 - c FROM m UNION ALL SELECT r, 499 - c FROM m) JOIN h ON c + k BETWEEN 0 AND 249 GROUP BY ALL),
    y AS (SELECT m.r, m.c, sum(x.s * g) AS cover FROM (SELECT r, c, s FROM x UNION ALL SELECT -1 - r, c, s FROM x UNION ALL SELECT 499 - r, c, s FROM x) x JOIN m ON m.c = x.c JOIN h ON h.k = m.r - x.r GROUP BY m.r, m.c),
    p AS (SELECT w.root, cover, coalesce(d > 0.14, true) AS far, coalesce(d BETWEEN 0.18 AND 0.30 AND cover < 0.60, false) AS ok FROM w JOIN m ON m.r * 1000 + m.c = w.v JOIN y ON y.r = m.r AND y.c = m.c LEFT JOIN n ON n.r = m.r AND n.c = m.c),
    a AS (SELECT root, count(*) AS pixels, avg(CASE WHEN far THEN 1.0 ELSE 0 END) AS outside, avg(CASE WHEN ok THEN 1.0 ELSE 0 END) AS supported, avg(cover) AS coverage FROM p GROUP BY root)
    SELECT root // 1000 AS "row", root % 1000 AS col, pixels, round(outside, 9) AS outside, round(supported, 9) AS supported, round(coverage, 6) AS coverage FROM a""")
def plants_beside_rows(spark, sf_dir):
    """Patches of bright cells beside lines through the parcels' middles, two hundredths of a metre a cell."""
    at = lambda c: F.floor(F.col(c) / 4).alias(c)
    cells = view(spark, sf_dir, "pixels").filter("red >= 120").select(at("row"), at("col")).distinct().withColumn("vegetation", F.lit(True))
    x, y = F.col("x0") / 4, (F.col("y0") + 75) / 4
    centres = interrow.line_pixels(view(spark, sf_dir, "parcels").select(g.ring((x, y), (x + 37.5, y)).alias("path")))
    shares = interrow.patch_shares(interrow.observed(cells, centres, 0.02, 250, 250, 64), 64)[1]
    row, col = F.floor(F.col("label") / (1 << 31)).alias("row"), (F.col("label") % (1 << 31)).alias("col")
    return shares.select(row, col, "pixels", r9(F.col("outside")).alias("outside"), r9(F.col("supported")).alias("supported"), r9(F.col("coverage"), 6).alias("coverage"))


# the chip's pixel centres lie off the parcels' edges: sides of 2.2 m a pixel around the centres of gravity
@query(f"""WITH z AS (SELECT *, x0 + CASE WHEN tri THEN 50 ELSE 75 END - 88.0 AS west, y0 + CASE WHEN tri THEN 50 ELSE 75 END + 88.0 AS north FROM parcels), k AS (SELECT z.*, i, j, west + (j + 0.5) * 2.2 AS x, north - (i + 0.5) * 2.2 AS y FROM z, (SELECT unnest(range(80)) AS i), (SELECT unnest(range(80)) AS j))
    SELECT name AS id, count(*) FILTER ({INSIDE}) AS labelled, min(i) FILTER ({INSIDE}) AS first_row, max(j) FILTER ({INSIDE}) AS last_col, round(any_value(west), 6) AS west, round(any_value(north), 6) AS north FROM k GROUP BY name""")
def label_chip_masks(spark, sf_dir):
    """Masks of 80 x 80 pixels around the parcels."""
    found = chips.label_chips(view(spark, sf_dir, "parcels").select(F.col("name").alias("id"), F.array("ring").alias("rings")), 80, 2.2)
    marks = found.select("id", "transform", F.posexplode(F.split(F.regexp_replace(F.hex("mask"), "(..)", "$1,"), ",")).alias("p", "mark")).filter("mark = '01'")
    out = marks.groupBy("id", F.round(F.col("transform")[2], 6).alias("west"), F.round(F.col("transform")[5], 6).alias("north"))
    return out.agg(F.count(F.lit(1)).alias("labelled"), F.min(F.floor(F.col("p") / 80)).alias("first_row"), F.max(F.col("p") % 80).cast("long").alias("last_col"))
