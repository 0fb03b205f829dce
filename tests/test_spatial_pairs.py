"""Joins of pairs where many rows share a place, and where Spark underrates the size of what it would broadcast."""

import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from terraspan.operators import spatial
from terraspan.plans.queries import ORACLES, QUERIES

from .test_operators import SF

POINTS = [(i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0)] * 9 + [(3, 4), (-7, 2), (50, 50)])] + [(90, None, 1.0), (91, math.nan, 1.0)]
OTHERS = [(i, float(x), float(y)) for i, (x, y) in enumerate([(1, 1)] * 8 + [(3, 4), (0, 5), (-9, 2), (80, 80)])] + [(90, 1.0, None), (91, 1.0, math.nan)]


def tables(spark):
    return spark.createDataFrame(POINTS, "pid long, x double, y double"), spark.createDataFrame(OTHERS, "lid long, ox double, oy double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("pack", [1, 3, 1024])
def test_near_pairs_of_copies(spark, monkeypatch, pack):
    monkeypatch.setattr(spatial, "PACK", pack)
    points, others = tables(spark)
    want = Counter((p, o, math.hypot(x - ox, y - oy)) for p, x, y in POINTS[:-2] for o, ox, oy in OTHERS[:-2] if math.hypot(x - ox, y - oy) < 5)
    found = spatial.near(points, others, 5.0)
    assert found.columns == ["pid", "x", "y", "lid", "ox", "oy", "distance"]
    assert Counter((r["pid"], r["lid"], r["distance"]) for r in found.collect()) == want
    assert spatial.near(points.select("x", "y"), others.select("ox", "oy"), 5.0).count() == want.total()


def test_near_broadcasts_nothing(spark):
    assert "BroadcastExchange" not in plan(QUERIES["near_join"](spark, SF))


def test_near_compares_places_once(spark, monkeypatch):
    points, others = tables(spark)
    met = []
    plain = spatial._near
    monkeypatch.setattr(spatial, "_near", lambda *a: met.append(plain(*a)) or met[-1])
    assert spatial.near(points, others, 5.0).filter("x = 0 and ox = 1").count() == 72
    assert met[0].filter("x = 0 and ox = 1").count() == 1


BOXES = [(i, *box) for i, box in enumerate([(0.0, 0.0, 6.0, 6.0)] * 9 + [(2.0, 2.0, 25.0, 14.0), (6.0, 0.0, 8.0, 2.0), (-5.0, -5.0, 1.0, 1.0)])] + [(90, None, 0.0, 9.0, 9.0)]
LABELS = [(i, *box) for i, box in enumerate([(3.0, 1.0, 12.0, 5.0)] * 8 + [(24.0, 0.0, 40.0, 40.0), (6.0, 6.0, 7.0, 7.0)])] + [(90, 0.0, 0.0, None, 9.0)]


def boxes(spark):
    return spark.createDataFrame(BOXES, "id long, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(LABELS, "lid long, rx1 double, ry1 double, rx2 double, ry2 double")


@pytest.mark.parametrize("pack", [1, 3, 1024])
def test_overlay_of_copies(spark, monkeypatch, pack):
    monkeypatch.setattr(spatial, "PACK", pack)
    left, right = boxes(spark)
    shared = lambda a, b: (max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3]))
    met = [(i, j, *shared(a, b)) for i, *a in BOXES[:-1] for j, *b in LABELS[:-1]]
    want = Counter((i, j, a, b, c, d, (c - a) * (d - b)) for i, j, a, b, c, d in met if a < c and b < d)
    found = spatial.overlay_boxes(left, right, 10.0)
    assert found.columns == ["id", "x1", "y1", "x2", "y2", "lid", "rx1", "ry1", "rx2", "ry2", "ix1", "iy1", "ix2", "iy2", "overlap"]
    assert Counter(map(tuple, found.select("id", "lid", "ix1", "iy1", "ix2", "iy2", "overlap").collect())) == want


def test_overlay_broadcasts_nothing(spark):
    assert "BroadcastExchange" not in plan(QUERIES["bbox_overlay_intersection"](spark, SF))


def test_overlay_compares_equal_boxes_once(spark, monkeypatch):
    met = []
    plain = spatial._unpacked
    monkeypatch.setattr(spatial, "_unpacked", lambda *a: met.append(a[0]) or plain(*a))
    assert spatial.overlay_boxes(*boxes(spark), 10.0).filter("x1 = 0 and rx1 = 3").count() == 72
    assert met[0].filter("x1 = 0 and rx1 = 3").count() == 1


def test_between_rows_broadcasts_nothing(spark):
    assert "BroadcastExchange" not in plan(QUERIES["between_rows"](spark, SF))


def test_nearest_compares_places_not_rows(spark, monkeypatch):
    met = []
    plain = spatial._near
    monkeypatch.setattr(spatial, "_near", lambda *a: met.append(plain(*a)) or met[-1])
    monkeypatch.setattr(spatial, "_unpacked", None)
    assert spatial.nearest(*tables(spark), "pid", 5.0).filter("distance is not null").count() == 11
    assert met[0].filter("x = 0 and ox = 1").count() == 1


def test_nearest_distance_broadcasts_nothing(spark):
    assert "BroadcastExchange" not in plan(QUERIES["nearest_distance"](spark, SF))


def test_nearest_keeps_every_row(spark):
    """Rows without a place or with nothing near stay, with null."""
    points, others = tables(spark)
    found = spatial.nearest(points, others, "pid", 5.0)
    least = lambda x, y: min((d for _, ox, oy in OTHERS[:-2] if (d := math.hypot(x - ox, y - oy)) < 5), default=None)
    assert found.columns == ["pid", "x", "y", "distance"]
    assert {r["pid"]: r["distance"] for r in found.collect()} == {p: least(x, y) for p, x, y in POINTS[:-2]} | {90: None, 91: None}
    assert found.count() == len(POINTS)


def test_nearest_distance_broadcasts_nothing_as_it_runs(spark):
    """The plan that adaptive execution ends with, where all tables are below the threshold."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        df = QUERIES["nearest_distance"](spark, SF)
        df.collect()
        assert "isFinalPlan=true" in plan(df) and "Broadcast" not in plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_nearest_distance_has_a_row_for_each_id(spark, tmp_path):
    """Customers that come more than once, or without a key, against the SQL."""
    for table, key in (("customer", "c_custkey"), ("part", "p_partkey")):
        df = spark.read.parquet(f"{SF}/{table}.parquet").filter(f"{key} < 300")
        lost = df.limit(2).withColumn(key, F.lit(None).cast("long"))
        df.union(df.filter(f"{key} % 3 = 0")).union(lost).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    for table in ("customer", "part"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.sql(ORACLES["nearest_distance"]).fetchall()
    assert Counter(map(tuple, QUERIES["nearest_distance"](spark, str(tmp_path)).collect())) == Counter(want)
