"""Documents and parts on storage: JSON records with versions, and frames written in checked parts."""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.sources.scratch import written

#: Versions of the documents.
PRESET_VERSION, MANIFEST_VERSION = 1, 1
PRESET = "version int, box array<double>, dilate_px int, feather_px int, margin_px int"
#: Folders that records lie in, tasks that write them for each core, and files that are in memory at once.
FOLDERS, TASKS, AT_ONCE = 1024, 4, 256
MANIFEST = "version int, fingerprint string, cuts array<long>, frames long, part_frames long"


def parsed(text: Column, schema: str, version: int) -> Column:
    """The document in ``text``, or null if it is malformed or of another version."""
    doc = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    return F.when(doc["version"] == version, doc)


def write_records(records: DataFrame, path: str) -> int:
    """A file for each row of ``records`` (name, value) under ``path``; how many were written.

    Tasks write files, each under another name first, so that it is there whole or not at all; a task that is run again writes the same ones. Rows that
    share a name are numbered. Files lie in ``FOLDERS`` folders, so that none gets too long to list.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = fs.FileSystem.from_uri(path)
        made, last, again = set(), None, 0
        for batch in batches:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if not name or name[0] in "._" or "/" in name:
                    raise ValueError(f"{name!r} is no name for a file")
                last, again = name, again + 1 if name == last else 0
                folder = f"{base}/{zlib.crc32(name.encode()) % FOLDERS}"
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                staged = f"{folder}/_{uuid.uuid4().hex}"
                with files.open_output_stream(staged) as file:
                    file.write((value or "").encode())
                files.move(staged, f"{folder}/{name}{f'-{again}' if again else ''}.json")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    tasks = records.sparkSession.sparkContext.defaultParallelism * TASKS
    dealt = records.select(F.col("name").cast("string"), F.col("value").cast("string")).repartition(tasks, "name").sortWithinPartitions("name", "value")
    return dealt.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def record_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, text) of every file under ``path``, by name; hidden ones are left out, a text that is in no encoding of JSON is null."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = re.sub("^file:/(?!/)", "file:///", where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString())

    def decoded(names: list[str], contents: list[bytes]) -> pa.RecordBatch:
        texts = []
        for content in contents:
            try:
                texts.append(content.decode(json.detect_encoding(content)))
            except UnicodeDecodeError:
                texts.append(None)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["file_name", "text"])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield decoded(batch.column("file_name").to_pylist(), batch.column("content").to_pylist())

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                paths, contents = batch.column("path")[at : at + AT_ONCE].to_pylist(), []
                for one in paths:
                    with files.open_input_stream(one) as file:
                        contents.append(file.read())
                yield decoded([p.rsplit("/", 1)[-1] for p in paths], contents)

    try:
        files, base = fs.FileSystem.from_uri(uri)
    except (ValueError, OSError):  # a store that only Spark opens
        whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        return whole.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content").orderBy("file_name").mapInArrow(told, "file_name string, text string")
    hidden = lambda p: any(x[0] in "._" for x in p[len(base) :].split("/") if x)
    of = files.get_file_info(base)
    within = [of] if of.is_file else files.get_file_info(fs.FileSelector(base, recursive=True))
    found = sorted((f.path.rsplit("/", 1)[-1], f.path) for f in within if f.is_file and not hidden(f.path))
    listed = spark.createDataFrame(pa.table({"path": pa.array([p for _, p in found], pa.string())}))
    return listed.mapInArrow(opened, "file_name string, text string")


def read_records(spark: SparkSession, path: str, schema: str, name: str | None = None) -> DataFrame:
    """One JSON document per file; unreadable ones are left out, the rest sorted by file name, which is kept as ``name``.

    The driver lists the files; tasks read many each, in order, so that nothing is sorted again.
    """
    text = F.col("text")
    documents = F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))  # or more in an array
    doc = F.from_json("document", f"{schema}, _unread string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"})
    rows = record_texts(spark, path).where("text IS NOT NULL").select("file_name", F.explode(documents).alias("document")).select("file_name", doc.alias("doc"))
    rows = rows.where("doc IS NOT NULL AND doc._unread IS NULL").select("file_name", "doc.*").drop("_unread")
    return rows.withColumnRenamed("file_name", name) if name else rows.drop("file_name")


def write_parts(frames: DataFrame, path: str, part_frames: int, parts: int) -> None:
    """Frames in a folder per part of ``part_frames`` frames, sorted, replaced as a whole."""
    placed = frames.withColumn("part", F.floor(F.col("t") / part_frames).cast("long"))
    placed.repartitionByRange(parts, "part").sortWithinPartitions("part", "t").write.mode("overwrite").partitionBy("part").parquet(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def incomplete_parts(stored: DataFrame, part_frames: int, total: int) -> DataFrame:
    """(part, counted, expected) of the parts whose frames are not all there; missing ones count 0."""
    spark = stored.sparkSession
    expected = spark.range(0, max(1, -(-total // part_frames))).select(F.col("id").alias("part"), F.least(F.lit(part_frames), F.lit(total) - F.col("id") * part_frames).alias("expected"))
    counted = stored.groupBy("part").agg(F.count("*").alias("counted"))
    both = expected.join(counted.withColumn("part", F.col("part").cast("long")), "part", "left").withColumn("counted", F.coalesce("counted", F.lit(0)))
    return both.where("counted <> expected").select("part", "counted", "expected")


def part_states(spark: SparkSession, path: str) -> DataFrame:
    """(part, counted, first, last, written) of the parts under ``path``; ``written`` is when a part's files were written."""
    stored = spark.read.parquet(path).select("part", "t", F.col("_metadata.file_modification_time").alias("at"))
    return stored.groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("counted"), F.min("t").alias("first"), F.max("t").alias("last"), F.max("at").alias("written"))


def resume_parts(frames: DataFrame, path: str, part_frames: int, fingerprint: str) -> int:
    """Write ``frames`` (with t) in parts of ``part_frames`` under ``path``, but for those that are whole there already; how many were written.

    A part is whole if it holds as many frames as it should. Parts of another fingerprint count for nothing. A part replaces what
    stood in its folder when the whole write succeeds, so that a run which breaks off leaves whole parts or none.
    """
    spark, manifest = frames.sparkSession, f"{path}-manifest"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    known = files.exists(where) and files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(manifest))
    if known:
        doc = spark.read.text(manifest).select(parsed(F.col("value"), MANIFEST, MANIFEST_VERSION).alias("d")).first()
        known = doc is not None and doc.d is not None and (doc.d.fingerprint, doc.d.part_frames) == (fingerprint, part_frames)
    placed = frames.withColumn("part", F.floor(F.col("t") / part_frames).cast("long"))
    wanted = placed.groupBy("part").agg(F.count("*").alias("expected"))
    if known:
        stored = part_states(spark, path).select("part", "counted")
        todo = wanted.join(stored, "part", "left").where("counted IS NULL OR counted <> expected").select("part")
    else:
        files.delete(where, True)
        text = F.to_json(F.struct(F.lit(MANIFEST_VERSION).alias("version"), F.lit(fingerprint).alias("fingerprint"), F.lit(part_frames).cast("long").alias("part_frames")))
        spark.range(1).select(text.alias("value")).coalesce(1).write.mode("overwrite").text(manifest)
        todo = wanted.select("part")
    todo = written(todo, "todo")  # a row per part, fixed before any of them is replaced
    count = todo.count()
    if count:
        some = placed.join(todo, "part", "left_semi").repartition("part").sortWithinPartitions("part", "t")
        some.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return count


def read_whole(spark: SparkSession, path: str, part_frames: int) -> DataFrame:
    """The frames of all parts under ``path``, after proof that parts follow each other without a gap, each full but the last."""
    states = part_states(spark, path).agg(F.count("*").alias("n"), F.max("part").alias("most")).first()
    odd = part_states(spark, path).where(
        (F.col("first") != F.col("part") * part_frames) | (F.col("last") - F.col("first") + 1 != F.col("counted")) | ((F.col("part") < F.lit(states.most)) & (F.col("counted") != part_frames))
    )
    if states.n and states.n != states.most + 1 or not odd.isEmpty():
        raise ValueError(f"the parts under {path} are not contiguous")
    return spark.read.parquet(path).orderBy("t")
