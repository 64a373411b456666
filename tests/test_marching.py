import numpy as np

from kinograph.functions.marching import fill, march
from kinograph.plans import checks
from kinograph.sources.tables import frames

RNG = np.random.default_rng(3)


def by_sweeps(hole):
    """Distances by repeating the same step over all pixels until nothing changes: no heap, no order."""
    h, w = hole.shape
    time = np.where(hole, np.inf, 0.0)
    while True:
        new = time.copy()
        for y, x in zip(*np.nonzero(hole), strict=True):
            up = min([time[p, x] for p in (y - 1, y + 1) if 0 <= p < h], default=np.inf)
            side = min([time[y, p] for p in (x - 1, x + 1) if 0 <= p < w], default=np.inf)
            a, b = min(up, side), max(up, side)
            if np.isfinite(a):
                new[y, x] = min(time[y, x], a + 1 if b - a >= 1 else (a + b + np.sqrt(2 - (a - b) ** 2)) / 2)
        if np.array_equal(new, time):
            return time
        time = new


def test_the_front_is_the_distance_from_the_rim():
    for _ in range(6):
        hole = RNG.random((14, 17)) < 0.8
        hole[0, 0] = False
        time, order = march(hole)
        want = by_sweeps(hole)
        assert np.allclose(time, want) and len(order) == hole.sum()
        assert [want[p] for p in order] == sorted(want[p] for p in order) or np.allclose([want[p] for p in order], sorted(want[p] for p in order))
    disc = np.hypot(*np.mgrid[-10:11, -10:11]) <= 8
    assert abs(march(disc)[0].max() - np.sqrt(65)) < 0.5  # from the middle to the nearest pixel beyond


def test_planes_go_on_and_levels_stay_within():
    y, x = np.mgrid[:20, :24]
    hole = (abs(y - 9) < 5) & (abs(x - 11) < 6)
    flat = fill(np.where(hole, -99.0, 7.0), hole, 5)
    assert np.allclose(flat, 7.0)
    plane = 3.0 * y - 2.0 * x
    assert np.abs(fill(np.where(hole, 0.0, plane), hole, 5) - plane).max() < 1e-9
    rough = RNG.normal(size=(20, 24))
    out = fill(rough, hole, 5)
    assert np.array_equal(out[~hole], rough[~hole]) and np.isfinite(out).all() and not np.array_equal(out, rough)
    assert np.array_equal(fill(rough, np.ones_like(hole), 5), rough) and np.array_equal(fill(rough, np.zeros_like(hole), 5), rough)


def test_the_query_fills_every_clip(spark):
    sf = "/root/testdata/sf0.001"
    clips = {}
    for r in frames(spark, sf).collect():
        clips.setdefault(r.clip, []).append(np.reshape(r.px, (8, 8)))
    hole = np.zeros((8, 8), bool)
    hole[2:6, 2:6] = True
    want = {(c, y, x): v for c, px in clips.items() for (y, x), v in np.ndenumerate(fill(np.mean(px, axis=0), hole, 5)) if hole[y, x]}
    got = {(r.clip, r.y, r.x): r.v for r in checks.marching_fill(spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
