import math

import numpy as np
import pytest

from kinograph.functions.windows import blurred, ellipse, gradients, over_ellipse, running, window_means
from kinograph.operators.grid import labelled, regions
from kinograph.operators.mosaic import block_pixels, cut, stencil

RNG = np.random.default_rng(7)


@pytest.mark.parametrize("radius", [0, 1, 2, 5, 24, 70])
def test_running_extremes_and_sums(radius):
    a = RNG.normal(size=(23, 41))
    for pick, plain in ((np.maximum, np.max), (np.minimum, np.min)):
        for axis in (0, 1):
            b = a if axis else a.T
            want = np.array([[plain(row[max(0, i - radius) : i + radius + 1]) for i in range(len(row))] for row in b])
            assert np.array_equal(running(a, radius, axis, pick), want if axis else want.T)
        want = np.full(a.shape, np.nan)
        for y in range(a.shape[0]):
            for x in range(a.shape[1]):
                want[y, x] = plain([v for d, half in zip(range(-radius, radius + 1), ellipse(radius), strict=True) if 0 <= y + d < a.shape[0] for v in a[y + d, max(0, x - half) : x + half + 1]])
        assert np.array_equal(over_ellipse(a, radius, pick), want)
    means = [[a[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1].mean() for x in range(41)] for y in range(23)]
    assert np.allclose(window_means(a, radius), means)
    assert ellipse(2) == [0, 2, 2, 2, 0] and ellipse(0) == [0]


def test_stencils_are_blind_to_blocks(spark):
    frames = [(c, t, RNG.normal(size=(50, 71))) for c in (1, 2) for t in range(2)]
    df = spark.createDataFrame([(c, t, a.ravel().tolist()) for c, t, a in frames] + [(3, 0, [1.0, 2.0])], "clip long, t long, px array<double>")

    def work(a):
        dy, dx = gradients(a)
        return {"dy": dy, "dx": dx, "far": over_ellipse(a, 9), "mean": window_means(a, 9), "soft": blurred(a, 1.5, 4)}

    for side in (8, 32, 100):
        out = stencil(cut(df, 50, 71, side), 9, work, dict.fromkeys(("dy", "dx", "far", "mean", "soft"), "double"), side)
        got = {(r.clip, r.t, r.y, r.x): (r.dy, r.dx, r.far, r.mean, r.soft) for r in block_pixels(out, "dy", "dx", "far", "mean", "soft", side=side).collect()}
        assert len(got) == 4 * 50 * 71
        for c, t, a in frames:
            want = work(a)
            for k, name in enumerate(("dy", "dx", "far", "mean", "soft")):
                mine = np.array([[got[c, t, y, x][k] for x in range(71)] for y in range(50)])
                assert np.allclose(mine, want[name], atol=1e-12), (side, name)


def plain_regions(marks):
    left, out = set(marks), {}
    for seed in sorted(marks):
        front = [seed] if seed in left else []
        left.discard(seed)
        while front:
            y, x = front.pop()
            out[y, x] = seed[0] * (1 << 20) + seed[1]
            near = [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (y + dy, x + dx) in left]
            left.difference_update(near)
            front += near
    return out


def test_a_region_runs_through_many_blocks(spark):
    spiral, y, x, step = set(), 30, 30, 0
    for k in range(1, 28):
        dy, dx = ((0, 1), (1, 0), (0, -1), (-1, 0))[k % 4]
        for _ in range(2 * k):
            spiral.add((y, x))
            y, x = y + dy, x + dx
    spiral = {(y, x) for y, x in spiral if y >= 0 and x >= 0}
    noise = {(int(y), int(x)) for y, x in RNG.integers(0, 60, (900, 2))}
    clips = {1: spiral, 2: noise, 3: {(5, 5)}, 4: {(7, 7), (8, 8), (7, 9)}}
    df = spark.createDataFrame([(c, y, x) for c, m in clips.items() for y, x in m] + [(3, 5, 5)], "clip long, y long, x long")
    for side in (4, 8, 64):
        got = {(r.clip, r.y, r.x): r.region for r in regions(df, "clip", side).collect()}
        want = {(c, *p): name for c, m in clips.items() for p, name in plain_regions(m).items()}
        assert got == want, side
    assert regions(df.limit(0), "clip").count() == 0


def test_labels_of_a_grid():
    marks = RNG.random((40, 40)) < 0.45
    want = plain_regions({(int(y), int(x)) for y, x in zip(*np.nonzero(marks), strict=True)})
    got = labelled(marks)
    assert all(got[p] == (name >> 20) * 40 + name % (1 << 20) for p, name in want.items()) and (got[~marks] == 1600).all()
    assert math.isclose(sum(ellipse(24)) / (math.pi * 24 * 24 / 2), 1, rel_tol=0.05)
