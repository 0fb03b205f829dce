import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspan.functions import kernels
from terraspan.functions.affine import Affine
from terraspan.operators import chips, interrow, neighbours, overlay, spatial, weeds
from terraspan.sources import raster


def table(spark, **grids):
    h, w = next(iter(grids.values())).shape
    rows = [(y, x, *[g[y, x].item() for g in grids.values()]) for y in range(h) for x in range(w)]
    kinds = {"b": "boolean", "i": "long", "f": "double"}
    return spark.createDataFrame(rows, "row long, col long, " + ", ".join(f"{n} {kinds[g.dtype.kind]}" for n, g in grids.items()))


@pytest.mark.parametrize("tile", [16, 31, 200])
def test_smoothing_over_tiles(spark, tile):
    a = np.random.default_rng(5).random((70, 45))
    got = neighbours.smoothed(table(spark, v=a), "v", 2.0, 70, 45, tile).collect()
    want = kernels.gaussian(a, 2.0)
    assert len(got) == a.size and max(abs(r["smooth"] - want[r["row"], r["col"]]) for r in got) < 1e-12


def test_smoothing_of_nothing_and_nulls(spark):
    empty = spark.createDataFrame([], "row long, col long, v double")
    assert neighbours.smoothed(empty, "v", 2.0, 10, 10).count() == 0
    one = spark.createDataFrame([(3, 3, None), (3, 4, 1.0)], "row long, col long, v double")
    grid = np.zeros((10, 10))
    grid[3, 4] = 1
    want = kernels.gaussian(grid, 1.0)
    assert all(abs(r["smooth"] - want[r["row"], r["col"]]) < 1e-12 for r in neighbours.smoothed(one, "v", 1.0, 10, 10, 4).collect())


def test_values_between_pixels(spark):
    y, x = np.mgrid[0:6, 0:7]
    places = spark.createDataFrame([(1, 2.5, 3.5), (2, 2.75, 3.1), (3, 0.1, 0.2), (4, -9.0, 2.0)], "id long, row double, col double")
    got = {r["id"]: r["v"] for r in neighbours.bilinear(places, table(spark, v=3.0 * y + x), ["id"], ["v"]).collect()}
    assert got == pytest.approx({1: 9.0, 2: 3 * 2.25 + 2.6, 3: 0.0})  # at a corner the only known pixel; nothing far outside


def test_pixels_along_a_line(spark):
    paths = spark.sql("SELECT array(struct(0.5D AS x, 0.5D AS y), struct(4.5D AS x, 2.5D AS y), struct(4.5D AS x, 2.5D AS y)) AS path")
    got = sorted(map(tuple, interrow.line_pixels(paths).collect()))
    assert got == [(0, 0), (1, 1), (1, 2), (2, 3), (2, 4)]


def test_patches_between_rows(spark):
    h, w, res = 90, 160, 0.02
    plants = np.zeros((h, w), bool)
    plants[18:23, :] = True  # a row of plants, and another one
    plants[66:71, :] = True
    plants[31:36, 20:40] = True  # 5 x 20 pixels, 0.22 to 0.30 m from the first row: too drawn out only beyond 4
    plants[31:36, 60:82] = True  # 5 x 22
    plants[31:35, 100:118:3] = True  # single columns, too small
    plants[23:34, 140:150] = True  # grown out of the row
    centres = spark.createDataFrame([(r, c) for r in (20, 68) for c in range(w)], "row long, col long")
    seen = interrow.observed(table(spark, vegetation=plants), centres, res, h, w, 32).cache()
    nearest = np.minimum(abs(np.arange(h) - 20), abs(np.arange(h) - 68)) * res
    cover = kernels.gaussian(plants.astype(float), interrow.SIGMA)
    rows = seen.collect()
    assert len(rows) == h * w
    for r in rows:
        d = nearest[r["row"]]
        assert (r["distance"] is None) if d > 0.30 else abs(r["distance"] - d) < 1e-12
        assert abs(r["coverage"] - cover[r["row"], r["col"]]) < 1e-9
    found = interrow.candidates(seen, res, 32)
    assert [(r["row0"], r["col0"], r["pixels"], r["elongation"], r["solidity"]) for r in found.collect()] == [(31, 20, 100, pytest.approx(4.0), pytest.approx(1.0))]
    told = interrow.report(seen, found, res).first()
    between = (nearest >= 0.18) & (nearest <= 0.30)
    assert told["patches"] == 1 and told["flagged_m2"] == pytest.approx(0.04)
    assert told["evaluated_m2"] == pytest.approx((between[:, None] & (cover < 0.6)).sum() * res * res)
    nothing = interrow.observed(spark.createDataFrame([], "row long, col long, vegetation boolean"), centres, res, h, w)
    assert tuple(interrow.report(nothing, interrow.candidates(nothing, res), res).first()) == (0, 0, 0)


def test_sides_of_the_smallest_rectangle():
    slanted = np.array([(i + j, i - j + 40) for i in range(30) for j in range(6)])
    longer, shorter = weeds._sides(weeds._hull(slanted))
    assert longer / shorter == pytest.approx((29 + 1) / (5 + 1), rel=0.02)
    assert weeds._sides(weeds._hull(np.array([(7, 7)]))) == (1.0, 1.0)


def test_chips(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    outer, hole = ring((100, 50), (103, 50), (103, 53), (100, 53)), ring((101, 51), (102, 51), (102, 52), (101, 52))
    shapes = spark.createDataFrame([(7, [outer, hole]), (8, [ring((10, 10), (13, 10), (10, 13))]), (9, [])], "id long, rings array<array<struct<x:double,y:double>>>")
    found = {r["id"]: r for r in chips.label_chips(shapes).collect()}
    mask = np.frombuffer(found["7"]["mask"], np.uint8).reshape(200, 200)
    assert set(found) == {"7", "8"} and set(np.unique(mask)) == {1, 255}
    assert (mask == 1).sum() == pytest.approx(8 / 0.025**2) and mask[100, 100] == 255 and mask[45, 45] == 1
    assert found["7"]["transform"] == pytest.approx([0.025, 0, 99.0, 0, -0.025, 54.0]) and found["8"]["transform"][2] == pytest.approx(11 - 2.5)
    y, x = np.mgrid[0:40, 0:40]
    t = Affine(0.1, 0, 99.0, 0, -0.1, 54.0)
    image = chips.images(chips.label_chips(shapes.filter("id = 7"), 20, 0.05), table(spark, red=x * 1.0, green=y * 1.0), ["red", "green"], t).collect()
    assert len(image) == 400  # centred on column 25, row 25 of the raster
    for r in image:
        assert r["red"] == pytest.approx(20 + (r["chip_col"] + 0.5) / 2 - 0.5) and r["green"] == pytest.approx(20 + (r["chip_row"] + 0.5) / 2 - 0.5)
    listed = chips.manifest(chips.label_chips(shapes), "maleza", 32720, "anotación").orderBy("image").first()
    assert (listed["image"], listed["mask"], listed["class"], listed["crs"]) == ("maleza_07.png", "maleza_07_mask.png", 1, "EPSG:32720")


def test_score_raster(spark, tmp_path):
    rows = [(0, 0, 0.005), (0, 1, 0.996), (2, 3, None), (4, 4, 0.5), (4, 3, float("nan"))]
    raster.write_scores(spark.createDataFrame(rows, "row long, col long, vote double"), "vote", f"file://{tmp_path}/s.tif", 5, 5, Affine(1, 0, 0, 0, -1, 0), 32720, 16)
    back = {(r["row"], r["col"]): r["value"] for r in raster.read_band(raster.read_tiles(spark, f"{tmp_path}/s.tif"), 1).collect()}
    assert [back[p] for p in ((0, 0), (0, 1), (2, 3), (4, 4), (4, 3), (1, 1))] == [0, 100, 255, 50, 255, 255]


def test_plants_counted_on_repaired_parcels(spark):
    """Three parcels, one of them crossing itself, with 400, 150 and 40 plants drawn inside them."""
    rng = np.random.default_rng(3)
    parcels = {"Parcela A": [(0, 0), (10, 0), (10, 10), (0, 10)], "Parcela B": [(20, 0), (30, 0), (30, 10), (20, 10)], "Parcela C_invalida": [(40, 0), (50, 10), (50, 0), (40, 10)]}
    many, points = {"Parcela A": 400, "Parcela B": 150, "Parcela C_invalida": 40}, []
    for (name, ring), x0 in zip(parcels.items(), (0, 20, 40), strict=True):
        drawn = np.stack([rng.uniform(x0, x0 + 10, 4000), rng.uniform(0, 10, 4000)], axis=1)
        points += drawn[kernels.inside_ring(drawn[:, 0], drawn[:, 1], [np.array(ring, float)])][: many[name]].tolist()
    layer = spark.createDataFrame([(n, [[{"x": float(x), "y": float(y)} for x, y in r]]) for n, r in parcels.items()], "name string, rings array<array<struct<x:double,y:double>>>")
    whole = overlay.repaired(layer).withColumn("ring", F.explode("rings"))
    counted = spatial.count_points(spark.createDataFrame(points, "x double, y double"), whole, "name", 10.0)
    assert {r["id"]: r["n"] for r in counted.collect()} == many
