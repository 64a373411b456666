"""Documents and parts on storage."""

import json

import pytest
from compare import differences
from pyspark.sql import functions as F

from kinograph.plans import records
from kinograph.sources.records import PRESET, incomplete_parts, parsed, read_parts, read_records, write_parts, write_records


def test_documents_of_other_versions_are_null(spark):
    texts = ['{"version": 1, "dilate_px": 5}', '{"version": 2, "dilate_px": 5}', "{", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.d.dilate_px if r.d else None for r in df.select(parsed(F.col("t"), PRESET, 1).alias("d")).collect()] == [5, None, None, None, None]


def test_unreadable_records_are_left_out(spark, tmp_path):
    for name, text in (("b", json.dumps({"job": "b", "n": 2})), ("a", json.dumps({"job": "a", "n": 1})), ("c", "{broken")):
        (tmp_path / f"{name}.json").write_text(text)
    assert [(r.job, r.n) for r in read_records(spark, str(tmp_path), "job string, n long").collect()] == [("a", 1), ("b", 2)]


def test_parts_are_counted(spark, tmp_path):
    path = str(tmp_path / "parts")
    df = spark.range(50).select(F.col("id").alias("t")).where("t <> 30")
    write_parts(df, path, 12, 3)
    got = [tuple(r) for r in incomplete_parts(read_parts(spark, path), 12, 62).orderBy("part").collect()]
    assert got == [(2, 11, 12), (4, 2, 12), (5, 0, 2)]
    write_parts(df.where("t < 12"), path, 12, 3)
    assert read_parts(spark, path).count() == 12


def test_many_records_are_written_and_read_by_few_tasks(spark, tmp_path):
    path = f"file://{tmp_path}/records"
    rows = spark.range(3000).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") % 3 == 0, "{broken").otherwise(F.to_json(F.struct("id"))).alias("value"))
    assert write_records(rows.unionByName(rows.where("name = '4'")), path) == 3001
    (tmp_path / "records" / "_begun").write_text('{"id": 9000}')
    (tmp_path / "records" / "two.json").write_text('[{"id": 7000}, {"id": 7001}]')
    (tmp_path / "records" / "odd.json").write_bytes(b'{"id": 8000, "x": "\xff"}')
    (tmp_path / "records" / "wrong.json").write_text('{"id": "x"}')
    back = read_records(spark, path, "id long", "file")
    assert back.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    got = [(r.file, r.id) for r in back.collect()]
    assert [f for f, _ in got] == sorted(f for f, _ in got)
    assert sorted(i for _, i in got) == sorted([i for i in range(3000) if i % 3] + [4, 7000, 7001])
    with pytest.raises(Exception, match="no name"):
        write_records(rows.withColumn("name", F.lit("a/b")), path)


def test_suppliers_with_equal_or_no_keys(spark, tmp_path):
    rows = [(1, "a", 3), (1, "b", 4), (7, "c", 5), (None, "d", 6), (-3, "e", None)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    assert differences(spark, records.QUERIES["records_read"], records.ORACLES["records_read"], str(tmp_path)) == ""
