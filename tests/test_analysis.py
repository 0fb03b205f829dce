import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspan.functions import geometry as g
from terraspan.functions import kernels
from terraspan.functions.affine import Affine
from terraspan.operators import models, patches, row_gaps, weeds
from terraspan.sources import config
from terraspan.streaming import ingest

from .test_operators import one, square


def test_ellipsoid_area_of_a_square_with_a_hole(spark):
    side = lambda lat: 100 / (111_412.84 * np.cos(np.radians(lat)) - 93.5 * np.cos(np.radians(3 * lat)))  # noqa: E731  degrees of longitude in 100 m
    high = 100 / (111_132.92 - 559.82 * np.cos(np.radians(2 * -16.3)) + 1.175 * np.cos(np.radians(4 * -16.3)))
    w = side(-16.3)
    outer, hole = square(-63.6, -16.3, -63.6 + w, -16.3 + high), square(-63.6 + w * 0.4, -16.3 + high * 0.4, -63.6 + w * 0.5, -16.3 + high * 0.5)
    assert abs(one(spark, g.ellipsoid_area(outer, F.array(hole)))[0] - 9900) < 10


def test_simple_rings(spark):
    ring = lambda *points: g.ring(*[(F.lit(float(x)), F.lit(float(y))) for x, y in points])
    good = ring((0, 0), (1, 0), (1, 1), (0, 1))
    closed = ring((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    crossing = ring((0, 0), (2, 2), (2, 0), (0, 2))
    line = ring((0, 0), (1, 1))
    missing = F.lit(None).cast("array<struct<x:double,y:double>>")
    assert one(spark, *[g.is_simple(r) for r in (good, closed, crossing, line, missing)]) == (True, True, False, False, False)


def test_raster_prediction(spark):
    image = np.zeros((40, 40))
    image[3:7, 8:12] = 255
    image[18:24, 18:22] = 250
    rows = []
    for r in (0, 16):
        for c in (0, 16):
            part = image[r : r + 24, c : c + 24]
            rows.append(("a", r, c, *part.shape, [part.astype("<f8").tobytes()]))
    tiles = spark.createDataFrame(rows, "path string, row_off int, col_off int, h int, w int, bands array<binary>")
    found = models.predict_raster(tiles, models.bright_spots, Affine(1, 0, 0, 0, -1, 100), cell=50.0)
    assert sorted((r["x1"], r["y1"], r["x2"], r["y2"], r["x"], r["y"]) for r in found.collect()) == [(8, 3, 12, 7, 10.5, 94.5), (18, 18, 22, 24, 20.5, 78.5)]


def test_inferred_gaps(spark):
    lines = [("p", 0, 0.0, 0.0, 10.0, 0.0), ("p", 1, 15.0, 0.1, 25.0, 0.1), ("p", 2, 0.0, 5.0, 10.0, 5.0), ("q", 0, 0.0, 0.0, 10.0, 0.0), ("q", 1, 10.3, 0.0, 20.0, 0.0)]
    df = spark.createDataFrame(lines, "parcela_id string, ordinal long, x1 double, y1 double, x2 double, y2 double")
    got = row_gaps.infer_gaps(df, 1.0, 0.5).collect()
    assert len(got) == 1 and got[0]["parcela_id"] == "p" and 4.5 < got[0]["long_m"] < 5.5


def test_colour_model(spark):
    rng = np.random.default_rng(1)
    x = rng.normal([0.3, 0.5, 0.2], 0.05, (2000, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "r double, g double, b double")
    m = weeds.fit_colour(df, ["r", "g", "b"])
    inverse = np.linalg.inv(np.cov(x.T) + np.diag(weeds.RIDGE))
    d = ((x - x.mean(axis=0)) @ inverse * (x - x.mean(axis=0))).sum(axis=1)
    assert abs(m.cutoff - np.percentile(d, 90)) < 1e-6
    got = df.select(m.distance(F.col("r"), F.col("g"), F.col("b")).alias("d")).agg(F.sum("d")).first()[0]
    assert abs(got - d.sum()) < 1e-6 * d.sum()


def test_patches_and_filters(spark):
    mask = np.zeros((30, 40), bool)
    mask[2:8, 2:8] = True
    mask[15, 1:38] = True
    mask[20:23, 30:34] = True
    mask[21, 31] = False  # closed again
    rows = [(int(y), int(x), 0.9, bool(mask[y, x])) for y in range(30) for x in range(40)]
    scored = spark.createDataFrame(rows, "row long, col long, score double, hit boolean")
    found = weeds.patches(scored)
    good = weeds.acceptable(found, 0.01)
    assert found.count() == 3 and sorted((r["pixels"], round(r["solidity"], 6)) for r in good.collect()) == [(12, 1.0), (36, 1.0)]
    across = sorted(map(str, found.collect()))
    for tile in (4, 7):  # patches don't end at the borders of tiles
        assert sorted(map(str, weeds.patches(scored, tile).collect())) == across
    bounded = {r["pixels"]: r["solidity"] for r in weeds.patches(scored, most=20).collect()}
    assert bounded[36] is None and bounded[12] == 1.0


@pytest.mark.parametrize("diagonal", [False, True])
def test_components_across_tiles(spark, diagonal):
    rng = np.random.default_rng(4)
    mask = rng.random((60, 70)) < (0.55 if not diagonal else 0.35)
    want, n = kernels.components(mask, diagonal)
    df = spark.createDataFrame([(int(y) - 20, int(x) - 10) for y, x in np.argwhere(mask)], "row long, col long")
    got = {(r["row"] + 20, r["col"] + 10): r["label"] for r in patches.components(df, 8, diagonal).collect()}
    assert len(got) == mask.sum() and len(set(got.values())) == n
    assert len({(want[p], label) for p, label in got.items()}) == n
    assert patches.components(df.limit(0), 8).count() == 0


def test_forest_never_sees_the_group_it_scores(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i % 6), int(i % 2), float(rng.normal(i % 2, 0.2)), float(rng.normal())) for i in range(600)]
    df = spark.createDataFrame(rows, "grp int, y int, a double, b double")
    scored = weeds.leave_one_group_out(df, ["a", "b"], "grp", "y", trees=10, depth=4)
    t, recall = weeds.choose_threshold(scored, "grp", "y")
    assert scored.count() == 600 and recall > 0.8 and weeds.publishable(recall) and 0.8 <= t <= 0.98


def test_stream_counts_hours(spark, tmp_path):
    base = datetime.datetime(2026, 1, 1)
    rows = [(base + datetime.timedelta(minutes=20 * i), "planta" if i % 2 else "maleza") for i in range(24)]
    spark.createDataFrame(rows, "ts timestamp, class string").write.parquet(f"{tmp_path}/in")
    stream = ingest.read_arrivals(spark, f"{tmp_path}/in", "ts timestamp, class string")
    ingest.start(ingest.hourly_counts(stream), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").agg(F.sum("n")).first()[0]
    assert got and got <= 24


def test_configuration(tmp_path):
    assert config.load_config(str(tmp_path / "none.yaml")) == {}
    (tmp_path / "c.yaml").write_text("ai:\n  conf: 0.3\n")
    assert config.load_config(str(tmp_path / "c.yaml")) == {"conf": 0.3}
    data = config.DetectionDataset(tmp_path / "d", ("planta", "árbol"))
    with pytest.raises(ValueError):
        data.validate()
    data.build()
    with pytest.raises(ValueError):
        data.validate()
    (tmp_path / "d/images/train/a.jpg").write_bytes(b"x")
    data.validate()
    assert "árbol" in data.write(config.TrainingConfig()).read_text(encoding="utf-8")
