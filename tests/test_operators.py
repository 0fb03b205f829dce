import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from terraspan.functions import affine, detections, geometry as g, indices
from terraspan.operators import nms, raster, sequences, spatial
from terraspan.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda r: tuple(v if v is None or isinstance(v, (str, bool)) else float(v) for v in r)
    a = sorted((plain(r[c] for c in columns) for r in got.collect()), key=str)
    b = sorted((plain(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=str)
    assert a == b


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def square(x0, y0, x1, y1):
    return g.ring((F.lit(x0), F.lit(y0)), (F.lit(x1), F.lit(y0)), (F.lit(x1), F.lit(y1)), (F.lit(x0), F.lit(y1)))


def test_square_measures_and_strict_inside(spark):
    r, c = square(0.0, 0.0, 10.0, 10.0), g.centroid(square(0.0, 0.0, 10.0, 10.0))
    assert one(spark, g.area(r), g.perimeter(r), c["x"], c["y"]) == (100, 40, 5, 5)
    edge = [(0, 5), (5, 0), (10, 5), (5, 10), (0, 0), (10, 10), (0, 10), (10, 0)]
    assert not any(one(spark, *[g.within(F.lit(float(x)), F.lit(float(y)), r) for x, y in edge]))
    assert one(spark, g.within(F.lit(5.0), F.lit(5.0), r), g.within(F.lit(11.0), F.lit(5.0), r)) == (True, False)


def test_utm_known_values(spark):
    p = g.utm_xy(F.lit(-3.70379), F.lit(40.41678), g.utm_epsg(F.lit(-3.70379), F.lit(40.41678)))
    x, y = one(spark, p["x"], p["y"])
    assert abs(x - 440291.289) < 0.01 and abs(y - 4474255.155) < 0.01
    m = g.metric_ring(square(-3.95, 40.40, -3.90, 40.45))
    area, length = one(spark, g.area(m), g.perimeter(m))
    assert abs(area - 23_543_038.01) < 1 and abs(length - 19_584.14) < 0.1
    assert one(spark, *[g.utm_epsg(F.lit(float(a)), F.lit(float(b))) for a, b in ((180, 10), (-180, -1), (500, 95), (0, 0))]) == (32660, 32701, 32660, 32631)


def test_points_in_parcels(spark):
    parcels = spark.range(1).select(F.explode(F.array(F.struct(F.lit("A").alias("name"), square(0.0, 0.0, 10.0, 10.0).alias("ring")), F.struct(F.lit("B").alias("name"), square(20.0, 0.0, 30.0, 10.0).alias("ring")))).alias("p")).select("p.*")
    points = spark.createDataFrame([(5.0, 5.0), (3.0, 3.0), (25.0, 5.0), (15.0, 5.0), (-5.0, -5.0)], "x double, y double")
    assert dict(map(tuple, spatial.count_points(points, parcels, "name", 7.0).collect())) == {"A": 2, "B": 1}
    assert dict(map(tuple, spatial.count_points(points.limit(0), parcels, "name", 7.0, ("a", "b")).collect())) == {"A": 0, "B": 0}
    with pytest.raises(spatial.CrsMismatchError):
        spatial.count_points(points, parcels, "name", 7.0, ("EPSG:4326", "EPSG:32630"))


def test_indices(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    a, b, c, e = one(spark, indices.ndvi(*lit(0.5, 0.1)), indices.ndvi(*lit(0, 0)), indices.ndre(*lit(0.6, 0.2)), indices.vari(*lit(60, 180, 40)))
    assert (round(a, 4), b, round(c, 4), round(e, 4)) == (0.6667, None, 0.5, 0.6)
    values = [None, math.nan, 0.6, 0.59, 0.3, 0.1, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(indices.classify(F.col("v")))
    assert [r[0] for r in df.collect()] == ["Sin datos", "Sin datos", "Vigorosa", "Moderada", "Moderada", "Estresada", "Suelo/Agua"]
    with pytest.raises(ValueError):
        raster.zonal_rgb_index(None, None, "ndvi", 1.0)


def test_affine_round_trip(spark):
    t = affine.Affine(0.01, 0, -4.0, 0, -0.01, 40.5)
    x, y = affine.pixel_to_coords(F.lit(0), F.lit(0), t)
    row, col = affine.coords_to_pixel(F.lit(-3.8951), F.lit(40.3949), t)
    assert [round(v, 6) for v in one(spark, x, y)] == [-3.995, 40.495] and one(spark, row, col) == (10, 10)


def greedy(boxes, t):
    def overlap(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        both = max(0.0, w) * max(0.0, h)
        size = lambda r: (r[5] - r[3]) * (r[6] - r[4])
        union = size(a) + size(b) - both
        return both / union if union else 0.0

    kept = []
    for b in sorted(boxes, key=lambda r: (-r[2], -r[0])):
        if all(k[1] != b[1] or overlap(k, b) <= t for k in kept):
            kept.append(b)
    return sorted(k[0] for k in kept)


def test_suppression_is_that_of_the_sequential_greedy(spark):
    rng = random.Random(4)
    boxes = [(0, "a", 0.9, 10.0, 10.0, 50.0, 50.0), (1, "a", 0.6, 12.0, 12.0, 52.0, 52.0), (2, "b", 0.6, 12.0, 12.0, 52.0, 52.0)]
    for i in range(3, 250):
        x, y = rng.uniform(0, 150), rng.uniform(0, 150)
        boxes.append((i, rng.choice("ab"), round(rng.random(), 1), x, y, x + rng.uniform(0, 40), y + rng.uniform(0, 40)))
    df = spark.createDataFrame(boxes, "id long, class string, conf double, x1 double, y1 double, x2 double, y2 double")
    for t in (0.2, 0.45):
        assert sorted(r["id"] for r in nms.suppress(df, t, 30.0).collect()) == greedy(boxes, t)
    assert nms.suppress(df.limit(0)).count() == 0


def test_tiles(spark):
    assert raster.tile_offsets(spark, 20, 20, 10, 0.0).count() == 4
    got = sorted(map(tuple, raster.tile_offsets(spark, 25, 20, 10, 0.2).collect()))
    assert got[-1] == (16, 24, 4, 1) and got[0] == (0, 0, 10, 10)
    assert raster.tile_offsets(spark, 20, 20, 10, 0.0, (30, 0, 40, 9)).count() == 0


def test_split_keeps_area(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 60.0), (2, 0.0, 0.0, 5.0, 5.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    rows = spatial.split_by_area(boxes, 100.0).collect()
    sizes = [((r["px2"] - r["px1"]) * (r["py2"] - r["py1"]), r["piece"]) for r in rows if r["id"] == 1]
    assert abs(sum(s for s, _ in sizes) - 6000) < 1e-6 and max(s for s, _ in sizes) <= 100 and {p for _, p in sizes} == {f"1.{k}" for k in range(1, 61)}
    assert [r["piece"] for r in rows if r["id"] == 2] == ["2"]


def test_runs_and_interpolation(spark):
    df = spark.createDataFrame([(1, i, f) for i, f in enumerate([1, 1, 0, 1, 1, 1, 0, 1])], "k int, i int, f int")
    assert sorted((r["start"], r["end"]) for r in sequences.runs(df, ["k"], "i", F.col("f") == 1).collect()) == [(0, 2), (3, 6), (7, 8)]
    s = spark.createDataFrame([(1, 0, 0.0), (1, 4, 8.0), (1, 5, 7.0)], "k int, at int, v double")
    assert [r["value"] for r in sequences.interpolate(s, ["k"], "at", "v").orderBy("place").collect()] == [0, 2, 4, 6, 8, 7]


def test_segments_gap(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 0.0), (1, 2, 15.0, 0.1, 25.0, 0.1), (2, 3, 0.0, 0.0, 10.0, 0.0), (2, 4, 10.3, 0.0, 20.0, 0.0)], "k int, seg int, x1 double, y1 double, x2 double, y2 double")
    gaps = sequences.gaps_between(df, ["k"], 1.0).collect()
    assert len(gaps) == 1 and 4.5 < gaps[0]["gap_m"] < 5.5


def test_names_and_classes(spark):
    df = spark.createDataFrame([("Sin falla",), ("GAP 3",), ("Vacío",), ("surco",)], "n string").select(detections.looks_unsown(F.col("n")))
    assert [r[0] for r in df.collect()] == [True, True, True, False]
    assert one(spark, detections.layer_path(F.lit("/a/b.gpkg|layername=x"))) == ("/a/b.gpkg",)
