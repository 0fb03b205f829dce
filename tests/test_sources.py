import json
import sqlite3
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraspan.sources import raster, sinks, text, vector


def tiff(a, tile=None, deflate=False, nodata=None):
    """A small GeoTIFF of an array [bands, h, w], chunky."""
    bands, h, w = a.shape
    pixels = np.ascontiguousarray(a.transpose(1, 2, 0))
    blocks = []
    if tile:
        for r in range(0, h, tile):
            for c in range(0, w, tile):
                b = np.zeros((tile, tile, bands), a.dtype)
                part = pixels[r : r + tile, c : c + tile]
                b[: part.shape[0], : part.shape[1]] = part
                blocks.append(b.tobytes())
    else:
        blocks = [pixels[r : r + 7].tobytes() for r in range(0, h, 7)]
    blocks = [zlib.compress(b) if deflate else b for b in blocks]
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    tags = [(256, "H", [w]), (257, "H", [h]), (258, "H", [a.dtype.itemsize * 8] * bands), (259, "H", [8 if deflate else 1]), (277, "H", [bands]), (339, "H", [kind] * bands)]
    tags += [(322, "H", [tile]), (323, "H", [tile])] if tile else [(278, "H", [7])]
    tags += [(33550, "d", [0.5, 0.5, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 100.0, 200.0, 0.0]), (34735, "H", [1, 1, 0, 1, 3072, 0, 1, 32720])]
    if nodata is not None:
        tags.append((42113, "s", f"{nodata}\0".encode()))
    body, offsets = b"", []
    for b in blocks:
        offsets.append(8 + len(body))
        body += b
    tags += [(324 if tile else 273, "I", offsets), (325 if tile else 279, "I", [len(b) for b in blocks])]
    tags.sort()
    at = 8 + len(body)
    extra_at, extra, entries = at + 2 + 12 * len(tags) + 4, b"", b""
    codes = {"H": 3, "I": 4, "d": 12, "s": 2}
    for tag, form, values in tags:
        data = values if form == "s" else struct.pack(f"<{len(values)}{form}", *values)
        value = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", extra_at + len(extra))
        extra += b"" if len(data) <= 4 else data
        entries += struct.pack("<HHI", tag, codes[form], len(values)) + value
    return b"II*\0" + struct.pack("<I", at) + body + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + extra


@pytest.mark.parametrize(("tile", "deflate", "dtype"), [(None, False, "u1"), (None, True, "f4"), (16, False, "u2"), (16, True, "i2")])
def test_geotiff(spark, tmp_path, tile, deflate, dtype):
    a = np.arange(3 * 25 * 38).reshape(3, 25, 38).astype(dtype)
    (tmp_path / "a.tif").write_bytes(tiff(a, tile, deflate, 0))
    tiles = raster.read_tiles(spark, str(tmp_path))
    rows = raster.pixels(tiles, 3).collect()
    assert len(rows) == 25 * 38 and all(a[b, r["row"], r["col"]] == r[f"b{b + 1}"] for r in rows for b in range(3))
    m = raster.metadata(spark, str(tmp_path)).first()
    assert (m["width"], m["height"], m["count"], m["crs"], m["nodata"]) == (38, 25, 3, "EPSG:32720", 0.0)
    assert (m["minx"], m["maxy"], m["maxx"], m["miny"]) == (100.0, 200.0, 119.0, 187.5)


def test_kml(spark, tmp_path):
    marks = [("A", "<Polygon><outerBoundaryIs><LinearRing><coordinates>0,0,5 1,0,5\n1,1,5 0,0,5</coordinates></LinearRing></outerBoundaryIs></Polygon>"), (None, "<Point><coordinates>3,4</coordinates></Point>"), ("L", "<LineString><coordinates>1,1 2,2</coordinates></LineString>"), ("none", "")]
    body = "".join(f"<Placemark>{f'<name>{n}</name>' if n else ''}{x}</Placemark>" for n, x in marks)
    (tmp_path / "p.kml").write_text(f'<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>{body}</Document></kml>')
    got = {r["name"]: (r["kind"], len(r["ring"])) for r in vector.read_vector(spark, str(tmp_path / "p.kml")).collect()}
    assert got == {"A": ("Polygon", 4), "Placemark": ("Point", 1), "L": ("LineString", 2)}


def test_geojson_round_trip(spark, tmp_path):
    df = spark.sql("SELECT 'A' AS name, 3 AS n, array(named_struct('x', 0d, 'y', 0d), named_struct('x', 2d, 'y', 0d), named_struct('x', 2d, 'y', 2d)) AS ring")
    sinks.write_geojson(df, str(tmp_path / "o.geojson"))
    r = vector.read_vector(spark, str(tmp_path / "o.geojson"), "name:string,n:int").first()
    assert (r["name"], r["n"], r["kind"], len(r["rings"][0])) == ("A", 3, "Polygon", 4)


def test_annotations(spark, tmp_path):
    item = {"id": "7", "geometry": {"wkt": "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)),((5 5, 6 5, 6 6, 5 5)))"}}
    (tmp_path / "a.json").write_text(json.dumps({"layer_id": "l", "items": [item]}))
    r = vector.read_annotations(spark, str(tmp_path / "a.json")).first()
    assert r["id"] == "7" and [len(x) for x in r["rings"]] == [4, 4] and r["rings"][1][1]["x"] == 6.0


def wkb(ring):
    return struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)


def test_shapefile_geopackage_and_wkb(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]
    body = struct.pack("<i4dii", 5, 0, 0, 1, 1, 1, len(ring)) + struct.pack("<i", 0) + b"".join(struct.pack("<dd", *p) for p in ring)
    (tmp_path / "s.shp").write_bytes(b"\0" * 100 + struct.pack(">ii", 1, len(body) // 2) + body)
    r = vector.read_vector(spark, str(tmp_path / "s.shp")).first()
    assert (r["id"], r["kind"], [tuple(p) for p in r["rings"][0]]) == (1, "Polygon", ring)
    db = sqlite3.connect(tmp_path / "g.gpkg")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name, column_name, srs_id)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('t', 'geom', 32630)")
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, geom BLOB)")
    db.execute("INSERT INTO t VALUES (5, ?), (6, NULL)", (b"GP\0\1" + struct.pack("<i", 32630) + wkb(ring),))
    db.commit()
    db.close()
    r = vector.read_vector(spark, str(tmp_path / "g.gpkg")).collect()
    assert [(x["id"], x["srid"], x["kind"], len(x["rings"][0])) for x in r] == [(5, 32630, "Polygon", 4)]
    df = spark.createDataFrame([(1, bytearray(wkb(ring))), (2, None)], "id int, g binary")
    assert [(x["id"], x["kind"]) for x in vector.from_wkb(df, "g").collect()] == [(1, "Polygon")]
    with pytest.raises(vector.UnsupportedFormatError):
        vector.read_vector(spark, "x.pdf")


def test_labels_and_photos(spark, tmp_path):
    (tmp_path / "img.txt").write_text("0 0.5 0.5 0.1 0.2\nbad line\n1 0.1 0.2 0.3 0.4\n")
    assert sorted((r["image"], r["class_id"], r["w"]) for r in text.read_labels(spark, str(tmp_path / "img.txt")).collect()) == [("img", 0, 0.1), ("img", 1, 0.3)]
    (tmp_path / "p.jpg").write_bytes(b"\xff\xd8" + b'<x drone:RelativeAltitude="+25.50" />')
    r = text.read_photo_metadata(spark, str(tmp_path / "p.jpg"), ["RelativeAltitude", "Focal"]).first()
    assert (r["RelativeAltitude"], r["Focal"]) == (25.5, None)


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("Parcela A", 100), ("B & C", 200)], "k string, v int")
    sinks.write_table(df, str(tmp_path / "d/r.csv"), ["Parcela", "Plantas"], bom=True)
    assert (tmp_path / "d/r.csv").read_bytes().startswith(b"\xef\xbb\xbfParcela,Plantas")
    sinks.write_table(df, str(tmp_path / "r.xlsx"), ["Parcela", "Plantas"])
    with zipfile.ZipFile(tmp_path / "r.xlsx") as z:
        assert "B &amp; C" in z.read("xl/worksheets/sheet1.xml").decode()
    with pytest.raises(vector.UnsupportedFormatError):
        sinks.write_table(df, str(tmp_path / "r.pdf"))
    rows = spark.createDataFrame([(1, 2.5), (2, 4.0)], "surco_id int, long_m double")
    folder = f"file://{tmp_path}/run"
    summary = {"surcos": {"n": 2, "long_m": 6.5}, "fallas": {"n": 0, "long_m": 0.0}}
    assert sinks.write_run(folder, {"surcos": rows, "fallas": rows.limit(0)}) == {"folder": folder} | summary
    assert json.loads((tmp_path / "run/resumen.json").read_text()) == summary
    assert sinks.write_run(folder, {"surcos": rows})["folder"] == f"{folder}_2" and (tmp_path / "run_2/resumen.json").exists()
    assert not (tmp_path / "run/fallas").exists() and spark.read.parquet(str(tmp_path / "run/surcos")).agg(F.sum("long_m")).first()[0] == 6.5


def test_reports_have_no_limit_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "SHEET_ROWS", 1000)
    rows = spark.range(2500).select(F.col("id").alias("a"), F.lit("x").alias("b"))
    sinks.write_table(rows, str(tmp_path / "r.xlsx"))
    with zipfile.ZipFile(tmp_path / "r.xlsx") as z:
        assert [z.read(f"xl/worksheets/sheet{i}.xml").count(b"<row>") for i in (1, 2, 3)] == [1001, 1001, 501] and z.read("xl/workbook.xml").count(b"<sheet ") == 3
    sinks.write_table(rows, str(tmp_path / "r.csv"))
    assert len((tmp_path / "r.csv").read_text().splitlines()) == 2501
    sinks.write_table(rows.limit(0), str(tmp_path / "none.xlsx"))
    with zipfile.ZipFile(tmp_path / "none.xlsx") as z:
        assert z.read("xl/worksheets/sheet1.xml").count(b"<row>") == 1
