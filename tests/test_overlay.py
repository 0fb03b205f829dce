import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspan.functions import polygons as pg
from terraspan.functions.affine import Affine
from terraspan.operators import overlay, row_models, rows, spatial, texture
from terraspan.sources import sinks, vector

RINGS = "array<array<struct<x:double,y:double>>>"


def box(x1, y1, x2, y2):
    return [np.array([(x1, y1), (x2, y1), (x2, y2), (x1, y2)], float)]


def layer(spark, shapes, names="id long"):
    rows_ = [(i, overlay.from_shape(s)) for i, s in enumerate(shapes)]
    return spark.createDataFrame(rows_, f"{names}, rings {RINGS}")


def test_algebra_obeys_inclusion_and_exclusion():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = ([rng.integers(0, 12, (int(rng.integers(3, 9)), 2)).astype(float)] for _ in range(2))
        both, one, other = pg.area(pg.intersection(a, b)), pg.area(pg.repair(a)), pg.area(pg.repair(b))
        assert pg.area(pg.union(a, b)) + both == pytest.approx(one + other, abs=1e-6)
        assert pg.area(pg.difference(a, b)) + both == pytest.approx(one, abs=1e-6)
    at = (np.arange(600) + 0.5) / 50
    x, y = np.meshgrid(at, at)
    counted = (pg.inside_ring(x, y, a) & pg.inside_ring(x, y, b)).mean() * 144
    assert both == pytest.approx(counted, abs=0.2)


def test_repair_holes_and_buffers():
    bow = [np.array([(0, 0), (0, 2), (2, 0), (2, 2)], float)]
    assert len(pg.polygons(pg.repair(bow))) == 2 and pg.area(pg.repair(bow)) == pytest.approx(2)
    ring = pg.difference(box(0, 0, 100, 100), box(45, 45, 55, 55))
    assert pg.area(ring) == pytest.approx(9900) and [len(p) for p in pg.polygons(ring)] == [2]
    assert pg.area(pg.buffer(box(0, 0, 50, 50), -5)) == pytest.approx(1600)
    assert pg.area(pg.buffer(box(432000, 8197000, 432010, 8197010), 2)) == pytest.approx(180 + 32 * np.sin(np.pi / 32) * 4, abs=1e-3)
    assert pg.buffer(box(0, 0, 4, 4), -3) == [] and pg.union([], []) == [] and pg.repair([np.array([(0, 0), (5, 5), (9, 9)], float)]) == []


def test_outline_of_a_mask():
    m = np.zeros((6, 7), bool)
    m[1:5, 1:5], m[2, 2], m[5, 5] = True, False, True
    rings = pg.outline(m)
    assert sorted(pg.ring_area(r) for r in rings) == [-1, 1, 16] and pg.outline(np.zeros((3, 3), bool)) == []


def test_overlays(spark):
    a, b = layer(spark, [box(0, 0, 10, 10), box(20, 0, 30, 10)]), layer(spark, [box(5, 0, 15, 10), box(100, 100, 110, 110), box(10, 0, 20, 10)])
    found = overlay.intersections(a, b, 4.0).collect()  # touching isn't sharing
    assert [(r["id_1"], r["id_2"], round(r["area"], 6)) for r in found] == [(0, 0, 50.0)]
    left = {r["id"]: r["a"] for r in overlay.differences(a, b, 7.0).groupBy("id").agg(F.round(F.sum("area"), 6).alias("a")).collect()}
    assert left == {0: 50.0, 1: 100.0}
    whole = overlay.dissolved(a.unionByName(b).withColumn("k", F.lit("x")), ["k"], 6.0).agg(F.sum("area")).first()[0]
    assert whole == pytest.approx(400)
    assert overlay.buffered(a, 2.0).first()["area"] == pytest.approx(180 + 32 * np.sin(np.pi / 32) * 4)
    assert overlay.intersections(a.limit(0), b, 4.0).count() == 0
    with pytest.raises(spatial.CrsMismatchError):
        overlay.intersections(a, b, 4.0, ("EPSG:4326", "EPSG:32630"))


def test_packages_and_shapefiles_round_trip(spark, tmp_path):
    shapes = [box(0, 0, 10, 10), pg.difference(box(20, 0, 40, 20), box(25, 5, 30, 10)), []]
    df = layer(spark, shapes).withColumns({"nombre": F.concat(F.lit("Parcela ñ "), F.col("id").cast("string")), "area": F.col("id") * 1.5, "ok": F.col("id") == 1})
    assert sinks.write_geopackage(df, f"{tmp_path}/a.gpkg", "parcelas", 32720) == 3
    back = {r["id"]: r for r in vector.read_geopackage(spark, f"{tmp_path}/a.gpkg").collect()}
    areas = [abs(pg.area(pg.repair(overlay.to_shape(back[i + 1]["rings"])))) for i in range(2)]
    assert areas == pytest.approx([100, 375]) and back[1]["srid"] == 32720 and back[1]["layer"] == "parcelas"
    assert sinks.write_geopackage(df.limit(1), f"{tmp_path}/a.gpkg", "parcelas", 32720) == 1  # replaced
    assert sinks.write_shapefile(df, f"{tmp_path}/b.shp", 'LOCAL_CS["x"]') == 3
    shp = {r["id"]: r for r in vector.read_shapefile(spark, f"{tmp_path}/b.shp").collect()}
    assert [abs(pg.area(pg.repair(overlay.to_shape(shp[i]["rings"])))) for i in (1, 2)] == pytest.approx([100, 375])
    table = (tmp_path / "b.dbf").read_bytes()
    assert "Parcela ñ 1".encode() in table and table[-1] == 0x1A and len(table) == 33 + 32 * 4 + 3 * (1 + 20 + 254 + 24 + 1) + 1
    with pytest.raises(vector.UnsupportedFormatError):
        sinks.export(df, f"{tmp_path}/c.pdf")
    with pytest.warns(UserWarning):
        sinks.export(df.limit(0), f"{tmp_path}/d.gpkg")


def test_features_do_not_depend_on_the_tiling(spark):
    rng, size = np.random.default_rng(1), 32
    image = rng.integers(0, 256, (3, 80, 70)).astype(float)
    tiles = [
        ("r", r, c, min(size, 80 - r), min(size, 70 - c), [np.ascontiguousarray(b[r : r + size, c : c + size]).astype("<f8").tobytes() for b in image])
        for r in range(0, 80, size)
        for c in range(0, 70, size)
    ]
    df = spark.createDataFrame(tiles, "path string, row_off int, col_off int, h int, w int, bands array<binary>")
    whole = texture.features(image)
    assert len(whole) == len(texture.OWN) == 21 and len(texture.features(image, context=True)) == len(texture.table(True)) == 31
    named = dict(zip([f.name for f in texture.OWN], whole, strict=True))
    r, g, b = image.astype(float) / 255
    assert len(named) == 21 and np.allclose(named["greenness"], (2 * g - r - b) / (r + g + b + 1e-6)) and np.allclose(named["light"], (r + g + b) / 3, atol=1e-5)
    flat = texture.features(np.full((3, 60, 60), 90.0))
    assert np.allclose([p.std() for p in flat], 0, atol=1e-6) and np.allclose(dict(zip(named, flat, strict=True))["greenness_spread_3"], 0, atol=1e-6)
    stripes = np.zeros((3, 80, 80))
    stripes[1, :, ::2] = stripes[1, :, 1::8] = 200
    assert dict(zip(named, texture.features(stripes), strict=True))["greenness_alignment_5"][20:60, 20:60].min() > 0.95
    found = texture.tile_features(df, size).collect()
    assert len(found) == 9
    for t in found:
        got = np.stack([np.frombuffer(f, "<f4").reshape(t["h"], t["w"]) for f in t["features"]])
        assert np.allclose(got, whole[:, t["row_off"] : t["row_off"] + t["h"], t["col_off"] : t["col_off"] + t["w"]], atol=1e-5)
    with pytest.raises(ValueError):
        texture.tile_features(df, size, context=True)


def test_rows_from_models(spark):
    t = Affine(0.05, 0.0, 500_000.0, 0.0, -0.05, 8_200_000.0)
    valid = np.ones((80, 400), np.uint8)

    def masks(image):
        row, gap = np.zeros((80, 400), bool), np.zeros((80, 400), bool)
        row[18:23, 5:196] = True
        gap[38:43, 5:196] = True
        return [row_models.Instance("surco", 0.9, mask=row), row_models.Instance("Falla", 0.8, mask=gap), row_models.Instance("surco", 0.1, mask=row)]

    def ends(image):
        line = lambda a, b, y: row_models.Instance("surco", 0.9, ends=np.array([(a, y), (b, y)], float))
        return [line(0, 120, 20), line(250, 390, 21), line(0, 150, 60), row_models.Instance("surco", 0.9, ends=np.array([(-9, -9), (900, 900)], float))]

    pieces = [(p, i, 80, 400, np.zeros((3, 80, 400), np.uint8).tobytes(), valid.tobytes(), [t.a, t.b, t.c, t.d, t.e, t.f]) for i, p in enumerate("AB")]
    df = spark.createDataFrame(pieces, "parcela_id string, piece long, h int, w int, image binary, valid binary, transform array<double>")
    options = rows.RowOptions(resolution_m=0.05, spacing_m=0.45, min_row_m=5.0)
    found, gaps, warnings = row_models.segment_pieces(df, masks, options)
    lines = found.orderBy("surco_id").collect()
    assert [r["surco_id"] for r in lines] == [1, 2] and all(9.0 <= r["long_m"] <= 9.6 for r in lines) and lines[0]["estado"] == "surco (0.90)"
    assert {(r["parcela_id"], r["estado"]) for r in gaps.collect()} == {("A", "Falla (0.80)"), ("B", "Falla (0.80)")} and warnings.count() == 0
    found, gaps, _ = row_models.segment_pieces(df, ends, options)
    assert found.count() == 6
    between = gaps.collect()
    assert len(between) == 2 and between[0]["estado"] == row_models.INFERRED and between[0]["long_m"] == pytest.approx(6.5, abs=0.01)
    none = row_models.segment_pieces(df, lambda image: [], options)
    assert [x.count() for x in none] == [0, 0, 2] and none[2].first()["warning"].startswith("Parcela ")
