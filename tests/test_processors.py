"""Stateful processors over several batches, with restarts between them, against plain loops."""

import datetime as dt
import random

import pytest

from kinograph.streaming.processors import context_blocks, silences
from kinograph.streaming.runs import drain

START = dt.datetime(2024, 1, 1)
SCHEMA = "user_id long, event_id long, ts timestamp, value double"


def some(seed, users, rows):
    rng, out, at = random.Random(seed), [], START
    for k in range(rows):
        at += dt.timedelta(minutes=rng.choice([1, 7, 40, 500]))
        out.append((rng.randrange(users), k, at, rng.choice([None, *map(float, range(20))])))
    return out


def run(spark, tmp_path, rows, cuts, work):
    """What ``work`` gives over ``rows`` that come in slices, each by a query that takes up where the last one ended."""
    source, home = tmp_path / "in", str(tmp_path / "home")
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.parquet(str(source / f"slice={k}"))
        stream = spark.readStream.schema(SCHEMA).parquet(f"{source}/*")
        out = drain(work(stream), "test", "append", home)
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("cuts", [[], [40, 41, 150]])
def test_blocks_come_as_their_look_ahead_does(spark, tmp_path, cuts):
    rows = some(1, 3, 260)
    want = []
    for user in range(3):
        own = [v for u, _, _, v in rows if u == user]
        want += [(user, s, min(s, 3) + 11, 8, sum(v or 0 for v in own[s : s + 8])) for s in range(0, len(own) - 10, 8)]
    assert run(spark, tmp_path, rows, cuts, lambda s: context_blocks(s, 8, 3)) == sorted(want)


@pytest.mark.parametrize("cuts", [[], [30, 90]])
def test_silence_is_told_by_timers(spark, tmp_path, cuts):
    rows, after = some(2, 9, 140), {"silent": 6 * 3_600_000, "removed": 48 * 3_600_000}
    rows = [(u if k < 60 or u > 2 else 3, e, at, v) for k, (u, e, at, v) in enumerate(rows)]  # three users end early
    ms = lambda at: int((at - START).total_seconds() * 1000)
    zero = int(START.replace(tzinfo=dt.UTC).timestamp() * 1000)
    mark, want = ms(rows[-1][2]) - 3_600_000, []
    for user in {r[0] for r in rows}:
        times = [ms(r[2]) for r in rows if r[0] == user]
        for at, then in zip(times, [*times[1:], None], strict=True):
            want += [(user, kind, zero + at + due) for kind, due in after.items() if (at + due <= mark if then is None else then - at > due)]
    got = run(spark, tmp_path, rows, cuts, lambda s: silences(s.withWatermark("ts", "1 hour"), after))
    assert got == sorted(want) and any(k == "removed" for _, k, _ in got)
