"""GeoTIFF files as tile tables and pixel tables.

A file's strips or tiles become rows with the decoded bands, one array of
bytes a band, so that a large raster spreads over tasks after one pass.
Uncompressed and deflated data, with or without the horizontal predictor.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspan import storage
from terraspan.functions.affine import Affine

from .vector import UnsupportedFormatError

# TIFF field types (code: struct letter) and tags, from the public specification.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_W, TILE_H, TILES, TILE_SIZES, FORMAT, SCALE, TIEPOINT, MATRIX, GEOKEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113


@dataclass
class Tiff:
    """Header of a TIFF's first image; blocks are decoded one by one."""

    data: bytes

    def __post_init__(self) -> None:
        d = self.data
        if d[:2] not in (b"II", b"MM"):
            raise UnsupportedFormatError("no TIFF")
        self.order = "<" if d[:2] == b"II" else ">"
        big = struct.unpack_from(self.order + "H", d, 2)[0] == 43
        at = struct.unpack_from(self.order + ("Q" if big else "I"), d, 8 if big else 4)[0]
        n = struct.unpack_from(self.order + ("Q" if big else "H"), d, at)[0]
        at, size, inline = at + (8 if big else 2), 20 if big else 12, 8 if big else 4
        self.tags: dict[int, tuple] = {}
        for i in range(n):
            tag, kind = struct.unpack_from(self.order + "HH", d, at + i * size)
            count = struct.unpack_from(self.order + ("Q" if big else "I"), d, at + i * size + 4)[0]
            where = at + i * size + (12 if big else 8)
            form = self.order + (f"{count}s" if kind == 2 else TYPES.get(kind, "B") * count)
            if struct.calcsize(form) > inline:
                where = struct.unpack_from(self.order + ("Q" if big else "I"), d, where)[0]
            self.tags[tag] = struct.unpack_from(form, d, where)
        one = lambda tag, default: self.tags.get(tag, (default,))[0]
        self.width, self.height, self.bands = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
        self.planar, self.compression, self.predictor = one(PLANAR, 1) == 2, one(COMPRESSION, 1), one(PREDICTOR, 1)
        if self.compression not in (1, 8, 32946):
            raise UnsupportedFormatError(f"TIFF compression {self.compression}")
        kind = {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)]
        self.dtype = np.dtype(f"{self.order}{kind}{one(BITS, 1) // 8}")
        self.tiled = TILES in self.tags
        self.block_w, self.block_h = (one(TILE_W, 0), one(TILE_H, 0)) if self.tiled else (self.width, min(self.height, one(ROWS, self.height)))
        text = one(NODATA, b"").split(b"\0")[0].strip() if NODATA in self.tags else b""
        self.nodata = float(text) if text else None

    @property
    def transform(self) -> Affine:
        if MATRIX in self.tags:
            m = self.tags[MATRIX]
            return Affine(m[0], m[1], m[3], m[4], m[5], m[7])
        if SCALE not in self.tags:
            return Affine(1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
        sx, sy = self.tags[SCALE][:2]
        col, row, _, x, y, _ = self.tags[TIEPOINT][:6]
        return Affine(sx, 0.0, x - col * sx, 0.0, -sy, y + row * sy)

    @property
    def epsg(self) -> int | None:
        keys = self.tags.get(GEOKEYS, ())
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        return found.get(3072) or found.get(2048)

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row offset, column offset, array [bands, h, w]) of every block, clipped at the edges."""
        across, down = -(-self.width // self.block_w), -(-self.height // self.block_h)
        starts, sizes = (self.tags[TILES], self.tags[TILE_SIZES]) if self.tiled else (self.tags[STRIPS], self.tags[STRIP_SIZES])
        for j in range(down):
            for i in range(across):
                h, w = min(self.block_h, self.height - j * self.block_h), min(self.block_w, self.width - i * self.block_w)
                full_h = self.block_h if self.tiled else h
                planes = []
                for plane in range(self.bands if self.planar else 1):
                    k = plane * across * down + j * across + i
                    raw = self.data[starts[k] : starts[k] + sizes[k]]
                    raw = zlib.decompress(raw) if self.compression != 1 else raw
                    depth = 1 if self.planar else self.bands
                    a = np.frombuffer(raw, self.dtype, full_h * self.block_w * depth).reshape(full_h, self.block_w, depth)
                    if self.predictor == 2:
                        a = np.cumsum(a, axis=1, dtype=a.dtype)
                    planes.append(a.transpose(2, 0, 1)[:, :h, :w])
                yield j * self.block_h, i * self.block_w, np.concatenate(planes)


TILE_SCHEMA = "path string, row_off int, col_off int, h int, w int, bands array<binary>"


def _tiles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            for r, c, block in Tiff(bytes(content)).blocks():
                bands = [b.astype("<f8").tobytes() for b in block]
                yield pd.DataFrame({"path": [path], "row_off": [r], "col_off": [c], "h": [block.shape[1]], "w": [block.shape[2]], "bands": [bands]})


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """The tile table: bands are little-endian doubles, row by row."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_tiles, TILE_SCHEMA)


def read_band(tiles: DataFrame, index: int) -> DataFrame:
    """One band, counted from 1, as pixels: path, row, col, value; a band that a raster doesn't have is an error."""
    band = F.when((F.lit(index) < 1) | (F.lit(index) > F.size("bands")), F.raise_error(F.lit(f"no band {index}"))).otherwise(F.get("bands", F.lit(index - 1)))
    return pixels(tiles.withColumn("bands", F.array(band.cast("binary"))), 1).withColumnRenamed("b1", "value")


def pixels(tiles: DataFrame, bands: int) -> DataFrame:
    """The pixel table: path, row, col, b1..bn."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for t in frame.itertuples(index=False):
                rows, cols = np.mgrid[t.row_off : t.row_off + t.h, t.col_off : t.col_off + t.w]
                yield pd.DataFrame({"path": t.path, "row": rows.ravel(), "col": cols.ravel()} | {f"b{i + 1}": np.frombuffer(t.bands[i], "<f8") for i in range(bands)})

    return tiles.mapInPandas(unpack, "path string, row long, col long, " + ", ".join(f"b{i + 1} double" for i in range(bands)))


def _metadata(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path, size, content in zip(frame["path"], frame["length"], frame["content"], strict=True):
            t = Tiff(bytes(content))
            a, corners = t.transform, []
            for col, row in ((0, 0), (t.width, 0), (0, t.height), (t.width, t.height)):
                corners.append((a.a * col + a.b * row + a.c, a.d * col + a.e * row + a.f))
            xs, ys = zip(*corners, strict=True)
            crs = f"EPSG:{t.epsg}" if t.epsg else "Sin CRS definido"
            rows.append((os.path.basename(path), path, t.width, t.height, t.bands, crs, abs(a.a), abs(a.e), min(xs), min(ys), max(xs), max(ys), t.dtype.name, t.nodata, size, [a.a, a.b, a.c, a.d, a.e, a.f]))
        yield pd.DataFrame(rows, columns=["name", "path", "width", "height", "count", "crs", "res_x", "res_y", "minx", "miny", "maxx", "maxy", "dtype", "nodata", "bytes", "transform"])


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row a file; its type is that of the first band."""
    schema = "name string, path string, width long, height long, count long, crs string, res_x double, res_y double, minx double, miny double, maxx double, maxy double, dtype string, nodata double, bytes long, transform array<double>"
    return spark.read.format("binaryFile").load(path).select("path", "length", "content").mapInPandas(_metadata, schema)


def tiles_of(table: DataFrame, bands: list[str], width: int, height: int, size: int, fill: float) -> DataFrame:
    """The tile table of a pixel table (row, col, bands): tiles of ``size``, clipped at the edges, ``fill`` where there is no pixel; tiles without any have no row."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(group["_r"].iloc[0]) * size, int(group["_c"].iloc[0]) * size
        h, w = min(size, height - r0), min(size, width - c0)
        out = []
        for b in bands:
            grid = np.full((h, w), fill)
            grid[group["row"] - r0, group["col"] - c0] = group[b].fillna(fill)
            out.append(grid.astype("<f8").tobytes())
        return pd.DataFrame({"path": [""], "row_off": [r0], "col_off": [c0], "h": [h], "w": [w], "bands": [out]})

    inside = table.filter(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    rows = inside.select("row", "col", *[F.col(b).cast("double").alias(b) for b in bands], F.floor(F.col("row") / size).alias("_r"), F.floor(F.col("col") / size).alias("_c"))
    return rows.groupBy("_r", "_c").applyInPandas(run, TILE_SCHEMA)


def write_geotiff(tiles: DataFrame, path: str, width: int, height: int, size: int, bands: int, t: Affine, dtype: str = "float32", nodata: float | None = None, epsg: int | None = None) -> None:
    """A tiled, uncompressed BigTIFF of tiles on a grid of ``size`` (a multiple of 16), wherever Spark writes.

    The driver writes tile by tile as they come in order; those that have no row
    are NoData (or 0). All places in the file are known beforehand.
    """
    if size % 16:
        raise ValueError("a tile's side is a multiple of 16")
    kind = np.dtype(dtype).newbyteorder("<")
    across, down = -(-width // size), -(-height // size)
    each = size * size * bands * kind.itemsize
    form = {"u": 1, "i": 2, "f": 3}[kind.kind]
    fields = [
        (WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [8 * kind.itemsize] * bands), (COMPRESSION, "H", [1]), (262, "H", [1]), (SAMPLES, "H", [bands]), (PLANAR, "H", [1]),
        (TILE_W, "I", [size]), (TILE_H, "I", [size]), (TILES, "Q", [0] * (across * down)), (TILE_SIZES, "Q", [each] * (across * down)), (FORMAT, "H", [form] * bands),
        (MATRIX, "d", [t.a, t.b, 0.0, t.c, t.d, t.e, 0.0, t.f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]),
    ]
    fields += [(GEOKEYS, "H", [1, 1, 0, 1, 3072, 0, 1, epsg])] if epsg else []
    fields += [(NODATA, "s", f"{nodata:g}\0".encode())] if nodata is not None else []
    codes = {"H": 3, "I": 4, "Q": 16, "d": 12, "s": 2}
    width_of = lambda kind, values: len(values) if kind == "s" else struct.calcsize(f"<{len(values)}{kind}")
    extra_at = 16 + 8 + 20 * len(fields) + 8
    first = extra_at + sum(width_of(k, v) for _, k, v in fields if width_of(k, v) > 8)
    entries, extra = b"", b""
    for tag, k, values in sorted(fields):
        values = [first + i * each for i in range(len(values))] if tag == TILES else values
        data = values if k == "s" else struct.pack(f"<{len(values)}{k}", *values)
        entries += struct.pack("<HHQ", tag, codes[k], len(values)) + (data.ljust(8, b"\0") if len(data) <= 8 else struct.pack("<Q", extra_at + len(extra)))
        extra += b"" if len(data) <= 8 else data
    head = b"II" + struct.pack("<HHHQ", 43, 8, 0, 16) + struct.pack("<Q", len(fields)) + entries + struct.pack("<Q", 0) + extra
    blank = np.full((size, size, bands), nodata or 0, kind).tobytes()

    def parts() -> Iterator[bytes]:
        yield head
        done = 0
        for r in tiles.select("row_off", "col_off", "h", "w", "bands").orderBy("row_off", "col_off").toLocalIterator(prefetchPartitions=True):
            place = r["row_off"] // size * across + r["col_off"] // size
            for _ in range(done, place):
                yield blank
            grid = np.full((size, size, bands), nodata or 0, kind)
            for i in range(bands):
                grid[: r["h"], : r["w"], i] = np.frombuffer(r["bands"][i], "<f8").reshape(r["h"], r["w"])
            yield grid.tobytes()
            done = place + 1
        for _ in range(done, across * down):
            yield blank

    storage.write_bytes(tiles.sparkSession, path, parts())


def write_scores(scored: DataFrame, score: str, path: str, width: int, height: int, t: Affine, epsg: int | None = None, size: int = 256) -> None:
    """A byte raster of scores from 0 to 1 (row, col, score) in hundredths; 255 where there is none."""
    hundredths = F.when(F.isnan(score), None).otherwise(F.bround(F.col(score).cast("double") * 100, 0)).alias("score")
    tiles = tiles_of(scored.select("row", "col", hundredths), ["score"], width, height, size, 255.0)
    write_geotiff(tiles, path, width, height, size, 1, t, "uint8", 255, epsg)
