import numpy as np
import pytest

from terraspan.functions import kernels as k
from terraspan.functions.affine import Affine
from terraspan.operators import rows

T = Affine(0.05, 0.0, 500_000.0, 0.0, -0.05, 8_200_000.0)
LINE = "array<struct<x:double,y:double>>"


def box(x1, y1, x2, y2):
    return np.array([(x1, y1), (x2, y1), (x2, y2), (x1, y2)], float)


def striped(shape, degrees, spacing, thick=3, level=0.35):
    """A signal with lines of a direction through the middle, and the distance of each pixel to its line's centre and its place along it."""
    h, w = shape
    yy, xx = np.indices(shape) + 0.5
    a = np.deg2rad(degrees)
    along = np.cos(a) * (xx - w / 2) + np.sin(a) * (yy - h / 2)
    across = np.cos(a) * (yy - h / 2) - np.sin(a) * (xx - w / 2)
    off = across - np.rint(across / spacing) * spacing
    return np.where(np.abs(off) <= thick, level, 0.0), np.rint(across / spacing), along


def frame_of(shape, inset=0.3):
    return [box(T.c + inset, T.f + T.e * shape[0] + inset, T.c + T.a * shape[1] - inset, T.f - inset)]


def options(**more):
    return rows.RowOptions(**({"resolution_m": 0.05, "spacing_m": 1.2, "min_row_m": 4.0} | more))


def degrees_of(row):
    d = row[-1] - row[0]
    return np.rad2deg(np.arctan2(-d[1], d[0])) % 180  # rows of the raster run downwards


@pytest.mark.parametrize("degrees", [0, 11, 52, 90, 143])
def test_lines_of_any_direction_and_a_hole_in_one(degrees):
    shape = (300, 420)
    signal, number, along = striped(shape, degrees, 24)
    signal[(number == 1) & (along > -30) & (along < 25)] = 0  # 2.75 m without plants on one line
    found = rows.trace(signal, np.ones(shape, bool), T, frame_of(shape), options())
    assert len({sector for sector, _, _ in found}) == 1 and len(found) >= 9
    long = [r for _, r, _ in found if k.path_length(r) > 8]
    assert len(long) >= 6 and all(min(abs(degrees_of(r) - degrees), 180 - abs(degrees_of(r) - degrees)) < 2.5 for r in long)
    gaps = [g for _, _, gs in found for g in gs]
    assert len(gaps) == 1 and 2.2 < k.path_length(gaps[0]) < 3.2
    centre = gaps[0].mean(axis=0)
    a = np.deg2rad(degrees)
    want = np.array([210 + np.cos(a) * -2.5 - np.sin(a) * 24, 150 + np.sin(a) * -2.5 + np.cos(a) * 24])
    assert np.hypot(*(centre - (T.c + T.a * want[0], T.f + T.e * want[1]))) < 0.5
    (ring,) = frame_of(shape)
    for _, r, _ in found:
        assert (r >= ring.min(axis=0) - 1e-6).all() and (r <= ring.max(axis=0) + 1e-6).all()


def test_a_band_without_data_is_no_gap():
    """All lines are cut by a band of columns without data, or by one whose pixels are there but bare."""
    shape = (240, 480)
    signal, _, _ = striped(shape, 0, 24)
    band = (np.indices(shape)[1] >= 200) & (np.indices(shape)[1] < 250)
    hidden = rows.trace(np.where(band, 0, signal), ~band, T, frame_of(shape), options())
    assert len(hidden) >= 14 and not [g for _, _, gs in hidden for g in gs]
    assert all(r[:, 0].max() <= T.c + 200 * T.a + 0.1 or r[:, 0].min() >= T.c + 250 * T.a - 0.1 for _, r, _ in hidden)
    bare = rows.trace(np.where(band, 0, signal), np.ones(shape, bool), T, frame_of(shape), options())
    assert len([g for _, _, gs in bare for g in gs]) == len(bare) >= 8


def test_shorter_gaps_and_rows_than_asked_for_do_not_count():
    shape = (240, 420)
    signal, number, along = striped(shape, 0, 24)
    signal[(number == 0) & (np.abs(along) < 30)] = 0
    whole = np.ones(shape, bool)
    count = lambda **more: sum(len(g) for _, _, g in rows.trace(signal, whole, T, frame_of(shape), options(**more)))
    assert count() == 1 and count(min_gap_m=4.0) == 0
    assert rows.trace(signal, whole, T, frame_of(shape), options(min_row_m=25.0)) == []
    assert rows.trace(np.zeros(shape), whole, T, frame_of(shape), options()) == []
    assert rows.trace(signal, ~whole, T, frame_of(shape), options()) == []


def test_fields_of_different_directions():
    shape = (420, 700)
    left, _, _ = striped(shape, 25, 24)
    right, _, _ = striped(shape, 110, 24)
    where = np.indices(shape)[1]
    signal = np.where(where < 330, left, np.where(where >= 370, right, 0))
    found = rows.trace(signal, np.ones(shape, bool), T, frame_of(shape), options())
    for degrees, side in ((25, lambda r: r[:, 0].mean() < T.c + 350 * T.a), (110, lambda r: r[:, 0].mean() > T.c + 350 * T.a)):
        own = [r for _, r, _ in found if abs(degrees_of(r) - degrees) < 5 and k.path_length(r) > 6]
        assert len(own) >= 8 and all(map(side, own))
    assert len({s for s, _, _ in found}) == 2


def test_a_gap_across_a_notch_belongs_to_each_part_for_its_own_stretch():
    """A parcel with a notch cuts rows in two; the bare stretch reaches from one part over the notch into the other."""
    shape = (260, 500)
    signal, _, along = striped(shape, 0, 24)
    signal[np.abs(along) < 60] = 0
    (outer,) = frame_of(shape)
    (x1, y1), (x2, y2) = outer.min(axis=0), outer.max(axis=0)
    m = T.c + 250 * T.a
    notched = np.array([(x1, y1), (m - 1, y1), (m - 1, y2 - 1), (m + 1, y2 - 1), (m + 1, y1), (x2, y1), (x2, y2), (x1, y2)])
    found = rows.trace(signal, np.ones(shape, bool), T, [notched], options())
    gaps = [tuple(np.round(np.concatenate([g[0], g[-1]]), 3)) for _, _, gs in found for g in gs]
    assert len(gaps) == len(set(gaps)) >= 12
    for _, r, gs in found:
        for g in gs:
            assert r[:, 0].min() - 1e-6 <= g[:, 0].min() and g[:, 0].max() <= r[:, 0].max() + 1e-6
            assert 1.5 < k.path_length(g) < 2.8 or k.path_length(r) > 20


def test_stretches_inside_rings():
    path = np.array([(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)])
    ring = [np.array([(1.0, -1.0), (3.0, -1.0), (3.0, 1.0), (1.0, 1.0)]), np.array([(3.0, 2.0), (5.0, 2.0), (5.0, 5.0), (3.0, 5.0)])]
    assert k.ranges_inside(path, ring) == [(0.25, 0.75), (1.5, 2.0)]
    assert [p.tolist() for p in k.clip_path(path, ring)] == [[[1, 0], [3, 0]], [[4, 2], [4, 4]]]
    assert k.part(path, 0.5, 1.25).tolist() == [[2, 0], [4, 0], [4, 1]]


def test_rows_and_gaps_as_tables(spark):
    shape = (240, 420)
    signal, number, along = striped(shape, 0, 24)
    signal[(number == 1) & (np.abs(along) < 25)] = 0
    shared = (*shape, signal.astype(np.float32).tobytes(), np.ones(shape, np.uint8).tobytes(), [T.a, T.b, T.c, T.d, T.e, T.f], [[(float(x), float(y)) for x, y in r] for r in frame_of(shape)])
    pieces = spark.createDataFrame([("1", 0, *shared), ("1", 1, *shared), ("2", 0, *shared)], f"parcela_id string, piece long, h int, w int, signal binary, valid binary, transform array<double>, rings array<{LINE}>")
    found, gaps = rows.trace_pieces(pieces, rows.RowOptions(spacing_m=1.2))
    ids = sorted(r["surco_id"] for r in found.filter("parcela_id = '1'").collect())
    assert ids == list(range(1, len(ids) + 1)) and gaps.count() == 3
    assert gaps.join(found, ["parcela_id", "surco_id"], "left_semi").count() == 3
    assert found.columns == ["parcela_id", "surco_id", "sector", "long_m", "estado", "geometry"]


def test_options():
    for bad in ({"spacing_m": 0}, {"spacing_m": 0.1}, {"vegetation_threshold": 3}, {"min_gap_m": float("nan")}):
        with pytest.raises(ValueError):
            options(**bad).checked()
    assert rows.RowOptions().at(0.02).resolution_m == 0.02


def test_components_holes_closing_and_distance():
    rng = np.random.default_rng(2)
    m = rng.random((40, 50)) < 0.55
    for diagonal in (False, True):
        labels, n = k.components(m, diagonal)
        seen, count = np.zeros_like(m), 0
        for y, x in zip(*np.nonzero(m), strict=True):
            if not seen[y, x]:
                count += 1
                stack, own = [(y, x)], labels[y, x]
                seen[y, x] = True
                while stack:
                    a, b = stack.pop()
                    assert labels[a, b] == own
                    for dy in (-1, 0, 1):
                        for dx in (-1, 0, 1):
                            p = (a + dy, b + dx)
                            if (dy or dx) and (diagonal or not (dy and dx)) and 0 <= p[0] < 40 and 0 <= p[1] < 50 and m[p] and not seen[p]:
                                seen[p] = True
                                stack.append(p)
        assert count == n
    ring = np.zeros((7, 7), bool)
    ring[1:6, 1:6] = True
    ring[3, 3] = False
    assert k.fill_holes(ring)[3, 3] and not k.fill_holes(ring)[0, 0] and k.close(ring)[3, 3]
    spots = rng.random((30, 35)) < 0.02
    ys, xs = np.nonzero(spots)
    yy, xx = np.indices(spots.shape)
    assert np.allclose(k.distance_to(spots), np.min(np.hypot(yy[..., None] - ys, xx[..., None] - xs), axis=-1))


def test_skeleton_length():
    m = np.zeros((20, 210), bool)
    m[8:13, 10:200] = True
    path, length = k.longest_path(k.thin(m))
    assert 9.0 <= length * 0.05 <= 9.6 and len(path)
    assert k.longest_path(np.zeros((3, 3), bool))[1] == 0


def test_gaussian_keeps_mass_and_constants():
    assert np.allclose(k.gaussian(np.full((9, 13), 2.5), 2), 2.5)
    a = np.zeros((41, 41))
    a[20, 20] = 1
    g = k.gaussian(a, 2)
    assert abs(g.sum() - 1) < 1e-9 and abs(g[20, 22] / g[20, 20] - np.exp(-0.5)) < 1e-9
