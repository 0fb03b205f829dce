import numpy as np

from terraspan.functions.affine import Affine
from terraspan.functions.kernels import sample
from terraspan.operators import resample


def test_regrid_equals_the_whole_image(spark):
    rng, size = np.random.default_rng(5), 16
    image = rng.random((2, 50, 41))
    tiles = [
        ("r", r, c, min(size, 50 - r), min(size, 41 - c), [np.ascontiguousarray(b[r : r + size, c : c + size]).tobytes() for b in image])
        for r in range(0, 50, size)
        for c in range(0, 41, size)
    ]
    df = spark.createDataFrame(tiles, "path string, row_off int, col_off int, h int, w int, bands array<binary>")
    source, turn = Affine(0.5, 0.0, 100.0, 0.0, -0.5, 200.0), np.deg2rad(20)
    targets = [
        (Affine(0.5, 0.0, 100.0, 0.0, -0.5, 200.0), 41, 50, False),
        (Affine(0.8, 0.0, 99.0, 0.0, -0.8, 201.0), 30, 35, False),
        (Affine(0.4 * np.cos(turn), 0.4 * np.sin(turn), 102.0, 0.4 * np.sin(turn), -0.4 * np.cos(turn), 195.0), 37, 29, True),
    ]
    for target, w, h, nearest in targets:
        y, x = np.meshgrid(np.arange(h) + 0.5, np.arange(w) + 0.5, indexing="ij")
        wx, wy = target.a * x + target.b * y + target.c, target.d * x + target.e * y + target.f
        sx, sy = (wx - 100) / 0.5, (200 - wy) / 0.5
        inside = (sx >= 0) & (sy >= 0) & (sx < 41) & (sy < 50)
        near = np.minimum(np.abs(sx - np.rint(sx)), np.abs(sy - np.rint(sy))) < 1e-9  # on a border either neighbour is right
        at = np.clip(sy - 0.5, 0, 49), np.clip(sx - 0.5, 0, 40)
        whole = np.stack([np.where(inside, sample(b, *at, nearest), 0.0) for b in image])
        got, valid = np.zeros_like(whole), np.zeros((h, w), bool)
        for t in resample.regrid(df, source, target, w, h, 12, nearest).collect():
            where = (slice(t["row_off"], t["row_off"] + t["h"]), slice(t["col_off"], t["col_off"] + t["w"]))
            valid[where] = np.frombuffer(t["valid"], np.uint8).reshape(t["h"], t["w"]) > 0
            for b in range(2):
                got[b][where] = np.frombuffer(t["bands"][b], "<f8").reshape(t["h"], t["w"])
        assert (valid == inside)[~near].all() and np.allclose(got[:, ~near], whole[:, ~near])
    assert resample.regrid(df, source, Affine(0.5, 0.0, 900.0, 0.0, -0.5, 200.0), 10, 10, 12).count() == 0
