"""Single operators on literal fixtures, boundary rows above all."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinograph.functions.frames import gradient_x, gradient_y
from kinograph.functions.geometry import clamp, clock, human_bytes, parse_box, snap
from kinograph.operators.coverage import grow, measure
from kinograph.operators.grid import regions
from kinograph.operators.alpha import alpha_bound, matte_alpha, variance_alpha
from kinograph.operators.jobs import LIVE, STATE_OF_OUTCOME, TERMINAL, decide, state_of
from kinograph.plans.overlay import plausible
from kinograph.plans.service import argv
from kinograph.operators.quality import psnr, robust_z
from kinograph.operators.quality import medians
from kinograph.operators.delivery import deliver
from kinograph.operators.folds import fold_sorted
from kinograph.operators.repair import REPAIRERS, register, repair, repair_blocks, repairer_of, surroundings
from kinograph.operators.shots import segments, shot_starts, thinned
from kinograph.streaming.machines import patch_cache, step


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_gradients_are_one_sided_at_borders(spark):
    rng = np.random.default_rng(1)
    px = rng.normal(size=(8, 8))
    row = spark.createDataFrame([(px.ravel().tolist(),)], "px array<double>").select(gradient_x(F.col("px")).alias("x"), gradient_y(F.col("px")).alias("y")).first()
    dy, dx = np.gradient(px)
    assert np.allclose(row.x, dx.ravel()) and np.allclose(row.y, dy.ravel())


def test_bounds_are_thinned_greedily(spark):
    rng = np.random.default_rng(2)
    cases = {1: ([3, 20, 30, 60, 61, 95], 100), 2: ([20, 60], 100), 3: ([10], 12), 4: ([], 7), 5: (sorted({int(c) for c in rng.integers(0, 4000, 900)}), 4000), 6: ([5, 5, 40], 40), 7: (list(range(200)), 200)}
    rows = [(k, c) for k, (cuts, _) in cases.items() for c in [0, *cuts]]
    want = {}
    for k, (cuts, _) in cases.items():
        want[k] = [0]
        for c in cuts:
            if c > 0 and c - want[k][-1] >= 16:
                want[k].append(c)
    for stretch in (10, 300, 1 << 16):
        found, got = thinned(spark.createDataFrame(rows, "k long, c long"), "k", "c", 16, stretch), {}
        for r in found.collect():
            got.setdefault(r.k, []).append(r.at)
        assert {k: sorted(v) for k, v in got.items()} == want
    totals = spark.createDataFrame([(k, n) for k, (_, n) in cases.items()], "k long, total long")
    plan = segments(found, totals, "k", 16, 1000, 5).orderBy("k", "s").collect()
    assert [(r.s, r.e) for r in plan if r.k == 1] == [(0, 20), (20, 60), (60, 100)] == [(r.s, r.e) for r in plan if r.k == 2][:0] + [(0, 20), (20, 60), (60, 100)]
    assert [(r.s, r.e) for r in plan if r.k in (3, 4)] == [(0, 12), (0, 7)] and [(r.s, r.e) for r in plan if r.k == 6] == [(0, 40)]


def test_shot_starts_tell_empty_from_failed(spark):
    rows = [(1, 0, False, True), (1, 1, False, True), (1, 2, True, False), (1, 3, False, True), (1, 4, True, False), (2, 0, False, False), (3, 0, False, True), (3, 1, False, True)]
    schema = "k long, t long, cut boolean, black boolean"
    assert sorted(map(tuple, shot_starts(spark.createDataFrame(rows, schema), "k", ["t"]).collect())) == [(1, 2), (1, 4), (3, 2)]
    with pytest.raises(Exception, match="clip 4 has no frames"):
        shot_starts(spark.createDataFrame([*rows, (4, 0, None, None)], schema), "k", ["t"]).collect()


def test_segments_keep_context_inside_the_shot(spark):
    bounds, totals = spark.createDataFrame([(1, 0)], "k long, at long"), spark.createDataFrame([(1, 41)], "k long, total long")
    got = segments(bounds, totals, "k", 16, 17, 5).orderBy("s").collect()
    assert [(r.s, r.e, r.left, r.right) for r in got] == [(0, 17, 0, 5), (17, 34, 5, 5), (34, 41, 5, 0)]


@pytest.mark.parametrize(("delta", "db"), [(2, 42.1), (8, 30.1), (26, 19.8)])
def test_psnr(spark, delta, db):
    assert round(one(spark, psnr(F.lit(float(delta * delta)), 255.0)), 1) == db


def test_psnr_of_nothing_is_infinite(spark):
    assert math.isinf(one(spark, psnr(F.lit(0.0), 255.0))) and math.isinf(one(spark, psnr(F.lit(None).cast("double"), 255.0)))


def test_robust_z_of_a_constant_is_zero(spark):
    rows = robust_z(spark.createDataFrame([("a", 3.0)] * 4 + [("b", float(v)) for v in (1, 2, 3, 100)], "k string, v double"), "v", "k").collect()
    assert all(r.z == 0 for r in rows if r.k == "a") and max(r.z for r in rows) > 6


def test_clamp(spark):
    row = spark.range(1).select(*[v.alias(k) for k, v in clamp(*[F.lit(v) for v in (310, 170, 50, 50)], 320, 180).items()]).first()
    assert tuple(row) == (310, 170, 10, 10)


def test_snap_still_covers(spark):
    for low, high in ((3, 5), (0, 8), (9, 63), (8, 64)):
        a, b = snap(F.lit(low), F.lit(high), 64)
        got = spark.range(1).select(a.alias("a"), b.alias("b")).first()
        assert got.a % 8 == 0 and got.a <= low and high <= got.b <= 64


def test_boxes_are_parsed_or_null(spark):
    got = [r.b for r in spark.createDataFrame([(t,) for t in ("1,2,3,4", " 1 2  3,4 ", "1,2,3", "1,2,0,4", "a,2,3,4", "-1,2,3,4", "")], "t string").select(parse_box(F.col("t")).alias("b")).collect()]
    assert [tuple(b) if b else None for b in got] == [(1, 2, 3, 4), (1, 2, 3, 4), None, None, None, None, None]


def test_text_of_sizes_and_times(spark):
    assert [one(spark, human_bytes(F.lit(n))) for n in (0, 1023, 1024, 1 << 20)] == ["0 B", "1023 B", "1.0 KiB", "1.0 MiB"]
    assert one(spark, clock(F.lit(3661))) == "1:01:01"


def test_regions_touch_at_corners(spark):
    marks = [(1, 0, 0), (1, 1, 1), (1, 3, 3), (1, 3, 5), (2, 0, 0)]
    got = regions(spark.createDataFrame(marks, "clip long, y long, x long"), "clip").collect()
    assert len({(r.clip, r.region) for r in got}) == 4


def signals(spark, marked):
    return spark.createDataFrame([(y, x, (y, x) in marked, 1.0) for y in range(8) for x in range(8)], "y long, x long, locked boolean, std double")


def boxes(spark, x, y, w, h, ring):
    return spark.createDataFrame([(0, x, y, w, h, ring)], "box long, bx long, by long, bw long, bh long, ring long")


def test_reach_ignores_gaps_and_corners(spark):
    r = measure(signals(spark, {(3, 0), (0, 0)}), boxes(spark, 3, 3, 2, 2, 3)).first()
    assert (r.reach_left, r.reach_right, r.reach_top, r.reach_bottom) == (3, 0, 0, 0) and r.saturated and not r.ok
    assert (r.sx, r.sy, r.sw, r.sh) == (0, 3, 5, 2)


def test_growth_returns_the_verdict_of_its_box(spark):
    r = grow(signals(spark, {(3, 2), (4, 2), (3, 1), (4, 1)}), boxes(spark, 3, 3, 2, 2, 1)).first()
    assert (r.bx, r.by, r.bw, r.bh, r.ok) == (1, 3, 4, 2, True)
    far = grow(signals(spark, {(y, x) for y in range(8) for x in range(8)}), boxes(spark, 3, 3, 2, 2, 3)).first()
    assert far.inconclusive and (far.bw, far.bh) == (2, 2)


def test_outcomes(spark):
    def of(canceled, outcome, covered, code):
        return one(spark, decide(F.lit(canceled), F.lit(outcome).cast("string"), F.lit(covered).cast("boolean"), F.lit(code)))

    assert of(True, None, None, -15) == "canceled" and of(True, "ok", True, 0) == "ok" and of(True, "internal", None, 1) == "canceled"
    assert of(False, "ok", False, 0) == "coverage_under" and of(False, None, None, -9) == "interrupted" and of(False, None, None, 1) == "internal"
    assert [one(spark, state_of(F.lit(o).cast("string"))) for o in ("ok", "verify_failed", "anything", None)] == ["succeeded", "needs_review", "failed", "failed"]


def test_cache_compares_with_the_last_miss(spark):
    rows = [(1, t, [float(v)]) for t, v in enumerate((0, 0.6, 1.2, 1.8))]
    got = patch_cache(spark.createDataFrame(rows, "clip long, t long, px array<double>"), 1.0, 1).orderBy("t").collect()
    assert [(r.hit, r.age) for r in got] == [(False, 1), (True, 2), (False, 1), (True, 2)]


def test_job_machine():
    ranks, rank = [], 0
    for event in ("error", "view", "signup", "signup", "view", "error", "click"):
        rank = step(rank, event)
        ranks.append(rank)
    assert ranks == [0, 0, 1, 1, 2, 9, 9]


def test_repair_leaves_the_rest_alone(spark):
    px = [float(i) for i in range(64)]
    mask = np.zeros((8, 8), bool)
    mask[2:4, 2:4] = True
    df = spark.createDataFrame([(1, 0, px)], "clip long, t long, px array<double>")
    got = np.array(repair(df, mask, lambda f, m: f + 1).first().px).reshape(8, 8)
    want = np.array(px).reshape(8, 8)
    assert (got[~mask] == want[~mask]).all() and (got[mask] == want[mask] + 1).all()
    assert np.isclose(surroundings(want[None], mask)[0][2, 2], want[~mask].mean())


def test_medians_are_exact_whatever_the_number_of_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), float(v)) for k, n in ((1, 30_001), (2, 30_000), (3, 1), (4, 2), (5, 7)) for v, k in zip(np.round(rng.normal(size=n), 3), [k] * n)] + [(3, None), (6, None)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = {r.k: r.median for r in medians(df, F.col("v"), "k").collect()}
    want = {k: float(np.median([v for a, v in rows if a == k and v is not None])) for k in range(1, 6)}
    assert got == pytest.approx(want)
    assert medians(df, F.col("v")).first().median == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_delivery_repeats_what_may_change_only(spark):
    def send(name, body):
        with open(f"{body}/{name}", "a+") as f:
            f.write("x")
            f.seek(0)
            tries = len(f.read())
        answers = {1: [200], 2: [503, 429, 204], 3: [404], 4: [500] * 9, 5: [OSError(), 200]}[name]
        if isinstance(answers[tries - 1], OSError):
            raise answers[tries - 1]
        return answers[tries - 1]

    import tempfile

    folder = tempfile.mkdtemp()
    got = deliver(spark.createDataFrame([(i, folder) for i in range(1, 6)], "id long, body string"), send, wait=lambda s: None).collect()
    assert sorted(map(tuple, got)) == [(1, 1, True), (2, 3, True), (3, 1, False), (4, 4, False), (5, 2, True)]


def test_folds_run_in_order_within_each_key(spark):
    rows = [(k, t, (t * 7 + k) % 5) for k in range(6) for t in range(50)]
    df = spark.createDataFrame(rows[::-1], "k long, t long, v long")
    got = fold_sorted(df, ["k"], ["t"], lambda s, r: ((s or 0) + r["v"], ((s or 0) + r["v"],)), "k long, t long, v long, total long", ["total"])
    want = {(k, t): sum(v for a, b, v in rows if a == k and b <= t) for k, t, _ in rows}
    assert {(r.k, r.t): r.total for r in got.collect()} == want


def test_blocks_see_their_context_in_order(spark):
    seen = []

    def order(px, mask):
        out = px.copy()
        out[:, mask] = px[:, 0, 1:2]  # the frame's number, out of the mask
        assert (np.diff(px[:, 0, 1]) == 1).all()
        out[:, mask] += len(px) / 100
        return out

    register("order", order)
    mask = np.zeros((2, 2), bool)
    mask[1, 1] = True
    frames = [(c, 10 + i, [0.0, float(i), 0.0, -1.0]) for c in (1, 2) for i in range(20)]
    got = {(r.clip, r.t - 10): r.px[3] for r in repair_blocks(spark.createDataFrame(frames, "clip long, t long, px array<double>"), mask, "order", block=8, overlap=3).collect()}
    size = [11] * 8 + [14 - 1] * 0 + [14] * 8 + [7] * 4
    assert len(got) == 40 and all(got[c, i] == pytest.approx(i + size[i] / 100) for c in (1, 2) for i in range(20))
    assert repairer_of("surroundings") is surroundings and "order" in REPAIRERS and not seen
    with pytest.raises(ValueError):
        repairer_of("none of these")


def test_alphas_over_channels(spark):
    lit = lambda *values: [F.lit(float(v)) for v in values]
    assert one(spark, matte_alpha(lit(155, 155, 155), lit(55, 55, 55), 255.0)) == pytest.approx(0.5)
    assert one(spark, matte_alpha(lit(100, 60, 250), lit(100, 20, 250), 255.0)) == pytest.approx(40 * 235 / (155**2 + 235**2 + 5**2))
    assert one(spark, matte_alpha(lit(255, 255, 255), lit(249, 249, 249), 255.0)) == 0.0  # 108 is not more than 108
    assert one(spark, matte_alpha(lit(255, 255, 255), lit(248, 249, 249), 255.0)) == pytest.approx(1.0)
    assert one(spark, variance_alpha(lit(5, 2, 8), lit(10, 10, 10))) == pytest.approx(0.8)
    assert one(spark, variance_alpha(lit(5, 0, 8), lit(0, 0, 0))) == 0.0
    assert one(spark, alpha_bound(lit(255, 51, 102), 255.0)) == pytest.approx(0.2) and one(spark, alpha_bound(lit(255, 255, 255), 255.0)) == 0.88


def test_boxes_are_plausible_within_every_bound(spark):
    ok = lambda area, w, h: one(spark, plausible(F.lit(area), F.lit(w), F.lit(h)))
    assert ok(4, 2, 2) and ok(20, 5, 4) and ok(6, 6, 1)
    assert not ok(24, 6, 4)  # over 35 % of the region
    assert not ok(7, 7, 1) and not ok(7, 1, 7)  # over three quarters of a side
    assert not ok(0, 0, 0)


def test_states_that_run_are_live():
    assert LIVE == ("preparing", "downloading", "detecting", "running", "uploading")
    assert not set(LIVE) & set(TERMINAL) and set(STATE_OF_OUTCOME.values()) <= set(TERMINAL)


def test_options_become_arguments(spark):
    given = F.create_map(*[F.lit(x) for x in ("corner", "tl", "crf", "18", "fp16", "false", "verify", "true", "resume", "false", "samples", "true", "colour", "red")])
    assert one(spark, argv(given)) == "--corner tl --crf 18 --no-fp16 --no-resume"
    assert one(spark, argv(F.create_map(F.lit("crf"), F.lit(None).cast("string")))) == ""
