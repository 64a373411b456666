"""Interrupted work that is taken up again."""

import pytest
from pyspark.sql import functions as F

from kinograph.sources.records import part_states, read_whole, resume_parts
from kinograph.streaming.runs import drain


def numbered(spark, n, value=0):
    return spark.range(n).select(F.col("id").alias("t"), F.lit(value).alias("v"))


def test_parts_are_taken_up_after_a_crash(spark, tmp_path):
    path = f"file://{tmp_path}/parts"
    assert resume_parts(numbered(spark, 29), path, 12, "a") == 3  # the third part breaks off after 5 frames
    then = {r.part: r.written for r in part_states(spark, path).collect()}
    assert resume_parts(numbered(spark, 50, 1), path, 12, "a") == 3
    now = {r.part: (r.counted, r.written) for r in part_states(spark, path).collect()}
    assert {p: c for p, (c, _) in now.items()} == {0: 12, 1: 12, 2: 12, 3: 12, 4: 2}
    assert all(now[p][1] == then[p] for p in (0, 1)) and now[2][1] > then[2]
    whole = read_whole(spark, path, 12).collect()
    assert [r.t for r in whole] == list(range(50)) and [r.v for r in whole] == [0] * 24 + [1] * 26
    assert resume_parts(numbered(spark, 50, 2), path, 12, "a") == 0


def test_other_settings_discard_what_is_there(spark, tmp_path):
    path = f"file://{tmp_path}/parts"
    resume_parts(numbered(spark, 24), path, 12, "a")
    assert resume_parts(numbered(spark, 24, 1), path, 12, "b") == 2
    assert {r.v for r in read_whole(spark, path, 12).collect()} == {1}
    assert resume_parts(numbered(spark, 24, 2), path, 8, "b") == 3


def test_gaps_are_refused(spark, tmp_path):
    for name, rows in (("missing part", "t < 12 OR t >= 24"), ("missing frame", "t <> 5"), ("no start", "t >= 12")):
        path = f"file://{tmp_path}/{name.replace(' ', '-')}"
        resume_parts(numbered(spark, 40).where(rows), path, 12, "a")
        with pytest.raises(ValueError):
            read_whole(spark, path, 12)


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    source, home = f"{tmp_path}/in", f"file://{tmp_path}/home"
    stream = lambda: spark.readStream.schema("t long, v int").parquet(source)
    numbered(spark, 5).write.parquet(source)
    assert drain(stream(), "s", "append", home).count() == 5
    assert drain(stream(), "s", "append", home).count() == 5
    numbered(spark, 3, 1).write.mode("append").parquet(source)
    assert drain(stream(), "s", "append", home).groupBy("v").count().orderBy("v").collect() == [(0, 5), (1, 3)]
