"""The segment driver and the part container: failures in the middle, halving, and what a filter opens."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinograph.operators.repair import register, repairer_of
from kinograph.operators.segments import LEAST_BLOCK, Settings, drive, repaired, repaired_or_halved
from kinograph.sources.containers import container_states, read_container, write_container

MASK = np.zeros((2, 2), bool)
MASK[0, 0] = True


def clips(spark, sizes):
    rows = [(c, i, [float(c + 1), float(i), float(i * i % 7), float(i % 5)]) for c, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "clip long, i long, px array<double>").repartition(3)


def cuts(spark, *at):
    return spark.createDataFrame(list(at), "clip long, i long")


def in_memory(sizes, at, s):
    """Blocks of frames, over lists: what the driver should give."""
    px = {c: np.array([[c + 1, i, i * i % 7, i % 5] for i in range(n)], float).reshape(-1, 2, 2) for c, n in enumerate(sizes)}
    out = {}
    for c, n in enumerate(sizes):
        bounds, last = [0], 0
        for k in sorted(k for d, k in at if d == c):
            if k - last >= s.least:
                bounds.append(k)
                last = k
        bounds = [b for b in bounds if b == 0 or n - b >= s.least]
        for a, z in zip(bounds, [*bounds[1:], n], strict=True):
            for b in range(a, z, s.segment):
                e = min(b + s.segment, z)
                low, high = max(a, b - s.overlap), min(z, e + s.overlap)
                done, _ = repaired_or_halved(repairer_of(s.repairer), px[c][low:high], MASK)
                for i in range(b, e):
                    out[c, i] = done[i - low].reshape(-1).tolist()
    return out


def rows(spark, path):
    return {(r.clip, r.i): r.px for r in repaired(spark, path).collect()}


SIZES, AT = (50, 7, 1, 23), [(0, 5), (0, 7), (0, 20), (0, 49), (3, 11)]


def test_one_run_equals_blocks_over_lists(spark, tmp_path):
    s = Settings("steady", 4, 9, 3, 12)
    report = drive(clips(spark, SIZES), cuts(spark, *AT), MASK, f"file://{tmp_path}/run", s)
    got, want = rows(spark, f"file://{tmp_path}/run"), in_memory(SIZES, AT, s)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert (report["frames"], report["halved"], report["waves"], report["parts"]) == (81, 0, 1, 9)
    assert drive(clips(spark, SIZES), cuts(spark, *AT), MASK, f"file://{tmp_path}/run", s) == {"segments": 0, "frames": 0, "halved": 0, "parts": 0, "waves": 0}


def test_a_run_that_broke_off_is_taken_up(spark, tmp_path):
    s, path = Settings("flaky", 4, 9, 3, 12), f"file://{tmp_path}/run"

    def steady(frames, mask):
        return repairer_of("steady")(frames, mask)

    def breaks(frames, mask):
        if (frames[:, 0, 1] == 40).any():
            raise ValueError("broken frame")
        return repairer_of("steady")(frames, mask)

    register("flaky", breaks)
    with pytest.raises(Exception, match="broken frame"):
        drive(clips(spark, SIZES), cuts(spark, *AT), MASK, path, s, stride=1)
    kept = {(r.clip, r.part) for r in container_states(spark, path).collect()}
    assert kept and (0, 3) not in kept
    assert not [f for f in os.listdir(f"{tmp_path}/run") if f.startswith("_staging")]
    stamps = {f: os.stat(f"{tmp_path}/run/{f}").st_mtime_ns for f in os.listdir(f"{tmp_path}/run") if f.endswith(".parquet")}
    register("flaky", steady)
    report = drive(clips(spark, SIZES), cuts(spark, *AT), MASK, path, s, stride=1)
    assert report["parts"] == 9 - len(kept)
    assert all(os.stat(f"{tmp_path}/run/{f}").st_mtime_ns == at for f, at in stamps.items())
    got, want = rows(spark, path), in_memory(SIZES, AT, s)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_jobs_and_tasks_do_not_grow_with_waves(spark, tmp_path):
    s, path = Settings("steady", 4, 9, 3, 4), f"file://{tmp_path}/run"
    spark.sparkContext.setJobGroup("many waves", "")
    report = drive(clips(spark, (300, 5)), cuts(spark, (0, 100)), MASK, path, s, stride=1)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("many waves")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert (report["waves"], report["parts"], report["frames"]) == (75, 77, 305) and len(jobs) < 75
    assert repaired(spark, path).rdd.getNumPartitions() == 1
    got, want = rows(spark, path), in_memory((300, 5), [(0, 100)], s)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_a_failure_stops_no_other_piece(spark, tmp_path):
    s, path = Settings("early", 4, 9, 3, 12), f"file://{tmp_path}/run"

    def early(frames, mask):
        if (frames[:, 0, 0] == 2).any():  # clip 1, in the first wave
            raise ValueError("broken clip")
        return repairer_of("steady")(frames, mask)

    register("early", early)
    with pytest.raises(RuntimeError, match="wave 0 of clip 1: ValueError: broken clip"):
        drive(clips(spark, (50, 7)), cuts(spark), MASK, path, s, stride=2)
    kept = {(r.clip, r.part) for r in container_states(spark, path).collect()}
    assert kept and (1, 0) not in kept and not [f for f in os.listdir(f"{tmp_path}/run") if f.startswith("_staging")]


def test_a_clip_that_has_grown_is_taken_up_in_waves(spark, tmp_path):
    s, path = Settings("steady", 4, 9, 3, 12), f"file://{tmp_path}/run"
    drive(clips(spark, (29,)), cuts(spark), MASK, path, s, stride=2)
    stamps = {k: os.stat(f"{tmp_path}/run/clip-0.part-{k}.frames-12.parquet").st_mtime_ns for k in (0, 1)}
    assert drive(clips(spark, (40,)), cuts(spark), MASK, path, s, stride=2)["parts"] == 2
    assert sorted(f for f in os.listdir(f"{tmp_path}/run") if f[0] not in "._") == [f"clip-0.part-{k}.frames-{n}.parquet" for k, n in ((0, 12), (1, 12), (2, 12), (3, 4))]
    assert all(os.stat(f"{tmp_path}/run/clip-0.part-{k}.frames-12.parquet").st_mtime_ns == at for k, at in stamps.items())


def test_other_settings_start_anew(spark, tmp_path):
    path = f"file://{tmp_path}/run"
    drive(clips(spark, SIZES), cuts(spark), MASK, path, Settings("steady", 4, 9, 3, 12))
    other = Settings("steady", 4, 9, 0, 12)
    assert drive(clips(spark, SIZES), cuts(spark), MASK, path, other)["parts"] == 9
    want = in_memory(SIZES, [], other)
    assert all(np.allclose(px, want[k]) for k, px in rows(spark, path).items())


def test_a_block_that_does_not_fit_is_halved(spark, tmp_path):
    s = Settings("tight", 4, 80, 3, 40)

    def tight(frames, mask):
        if len(frames) > 50:
            raise MemoryError
        return repairer_of("steady")(frames, mask)

    register("tight", tight)
    report = drive(clips(spark, (100,)), cuts(spark), MASK, f"file://{tmp_path}/run", s)
    assert report["halved"] == 80 and report["frames"] == 100
    want = in_memory((100,), [], s)
    got = rows(spark, f"file://{tmp_path}/run")
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_halves_line_up_and_other_failures_pass(spark):
    frames = np.arange(70 * 4, dtype=float).reshape(-1, 2, 2)

    def tight(block, mask):
        if len(block) > 40:
            raise RuntimeError("device out of memory")
        return block + 1000 * mask

    done, halved = repaired_or_halved(tight, frames, MASK)
    assert halved == 1 + 2 + 4 and np.array_equal(done, np.where(MASK, frames + 1000, frames))  # 70; 51 twice; 41 and 42 of each
    with pytest.raises(MemoryError):
        repaired_or_halved(lambda *_: (_ for _ in ()).throw(MemoryError()), frames[: LEAST_BLOCK - 1], MASK)
    with pytest.raises(ValueError):
        repaired_or_halved(lambda *_: (_ for _ in ()).throw(ValueError("no")), frames, MASK)


def test_no_frames_and_no_clip(spark, tmp_path):
    s = Settings("steady", 4, 9, 3, 12)
    assert drive(clips(spark, ()), cuts(spark), MASK, f"file://{tmp_path}/none", s)["parts"] == 0
    with pytest.raises(ValueError, match="no clip"):
        drive(spark.createDataFrame([(None, 0, [0.0] * 4)], "clip long, i long, px array<double>"), cuts(spark), MASK, f"file://{tmp_path}/null", s)


def parts(spark, n, size, drop="false"):
    own = spark.range(n).select(F.lit(5).cast("long").alias("clip"), F.floor(F.col("id") / size).alias("part"), F.col("id").alias("i"), F.least(F.lit(size), F.lit(n) - F.floor(F.col("id") / size) * size).cast("long").alias("expected"), F.lit(n).alias("v"))
    return own.where(f"NOT ({drop})")


def test_a_task_that_fails_leaves_no_part(spark, tmp_path):
    path = f"file://{tmp_path}/parts"
    write_container(parts(spark, 24, 12), path, 12)
    for drop in ("i = 30", "i = 24", "i = 35"):  # a gap, no start, no end
        with pytest.raises(Exception, match="part 2 of clip 5"):
            write_container(parts(spark, 48, 12, drop), path, 12)
        assert sorted(os.listdir(f"{tmp_path}/parts")) == ["clip-5.part-0.frames-12.parquet", "clip-5.part-1.frames-12.parquet"]


def test_a_part_that_has_grown_replaces_the_one_before(spark, tmp_path):
    path = f"file://{tmp_path}/parts"
    write_container(parts(spark, 29, 12), path, 12)
    write_container(parts(spark, 40, 12).where("part >= 2"), path, 12)
    assert sorted((r.part, r.frames) for r in container_states(spark, path).collect()) == [(0, 12), (1, 12), (2, 12), (3, 4)]
    assert {r.v for r in read_container(spark, path).where("part = 2").collect()} == {40}


def test_a_filter_on_part_opens_no_other(spark, tmp_path):
    path = f"file://{tmp_path}/parts"
    write_container(parts(spark, 40, 12), path, 12)
    for part in (0, 1, 3):  # not to be read from here on; the schema is known
        (tmp_path / "parts" / f"clip-5.part-{part}.frames-{12 if part < 3 else 4}.parquet").write_bytes(b"gone")
    rows = spark.read.format("frame_parts").schema("clip long, part long, i long, v long").load(path)
    assert rows.where("part = 2 AND i > 25").count() == 10
    assert rows.where("part IN (2) AND part >= 1 AND part < 3 AND v = 40").count() == 12
    with pytest.raises(Exception):
        rows.where("part > 0").collect()
