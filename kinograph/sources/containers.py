"""A container of parts: a file for each part of a clip's frames, that is there whole or not at all.

    frames.write.format("frame_parts").option("path", ...).option("part_frames", 12).mode("append").save()
    spark.read.format("frame_parts").load(path).where("part = 3")

Rows have clip, part, i (the frame's number in its clip), expected (how many frames the part should hold) and what else
belongs to a frame. Tasks write parts into a staging folder and prove them: numbers that start at the part's place, follow each other and
are as many as expected. The commit moves proven parts into place, each over an older file of the same part; an abort drops the
staging folder. Names tell clip, part and frames, so that a filter on clip or part opens no other file.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

NAME = re.compile(r"clip-(-?\d+)\.part-(\d+)\.frames-(\d+)\.parquet")
#: Files and bytes of them that a task reads at most; batches of a few frames that go to Spark together, and bytes from which one goes alone.
TASK_PARTS, TASK_BYTES, BATCHES, BATCH_BYTES = 256, 32 << 20, 64, 1 << 20
_TESTS = {
    EqualTo: lambda have, want: have == want,
    In: lambda have, want: have in want,
    GreaterThan: lambda have, want: have > want,
    GreaterThanOrEqual: lambda have, want: have >= want,
    LessThan: lambda have, want: have < want,
    LessThanOrEqual: lambda have, want: have <= want,
}


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class Part:
    """One file of a container."""

    clip: int
    part: int
    frames: int
    path: str
    size: int


def _listed(path: str) -> list[Part]:
    files, base = _opened(path)
    found = files.get_file_info(fs.FileSelector(base, allow_not_found=True))
    named = [(NAME.fullmatch(f.base_name), f.path, f.size) for f in found if f.is_file]
    return sorted((Part(*map(int, m.groups()), p, n) for m, p, n in named if m), key=lambda p: (p.clip, p.part))


class SomeParts(InputPartition):
    """A task reads some parts, one after the other."""

    def __init__(self, paths: list[str]):
        self.paths = paths


def _grouped(parts: list[Part]) -> list[SomeParts]:
    """``parts`` in groups that a task reads, of at most so many files and bytes (or one file)."""
    groups, size = [], 0
    for p in parts:
        if not groups or len(groups[-1]) == TASK_PARTS or size + p.size > TASK_BYTES:
            groups.append([])
            size = 0
        groups[-1].append(p.path)
        size += p.size
    return [SomeParts(g) for g in groups]


class PartReader(DataSourceReader):
    """Parts that the filters on clip and part leave."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.tests = path, to_arrow_schema(schema), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            test = _TESTS.get(type(f))
            if test is None or f.attribute not in (("clip",), ("part",)):
                yield f  # left to Spark
            else:
                self.tests.append((f.attribute[0], test, f.value))

    def partitions(self) -> list[SomeParts]:
        return _grouped([p for p in _listed(self.path) if all(test(getattr(p, name), value) for name, test, value in self.tests)])

    def read(self, partition: SomeParts) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a container without parts
            return
        files, _ = _opened(self.path)
        held: list[pa.RecordBatch] = []  # of short parts, to be sent together
        for path in partition.paths:
            with files.open_input_file(path) as file:
                for batch in pq.ParquetFile(file).iter_batches(columns=self.schema.names):
                    held.append(batch.select(self.schema.names).cast(self.schema))  # asked for as other types, perhaps
                    if sum(b.nbytes for b in held[-2:]) > BATCH_BYTES or len(held) == BATCHES:
                        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                        held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()


@dataclass
class Staged(WriterCommitMessage):
    """The parts that a task wrote and proved: (staged path, clip, part, frames) of each."""

    parts: list


class _Open:
    """A part that a task is writing."""

    def __init__(self, files: fs.FileSystem, path: str, clip: int, part: int, expected: int, first: int, schema: pa.Schema):
        self.path, self.clip, self.part, self.expected, self.next, self.frames = path, clip, part, expected, first, 0
        self.file = files.open_output_stream(path)
        self.writer = pq.ParquetWriter(self.file, schema)

    def add(self, rows: pa.RecordBatch | pa.Table) -> None:
        for i in rows.column("i").to_pylist():
            if i != self.next:
                raise ValueError(f"part {self.part} of clip {self.clip}: frame {i} where {self.next} should be")
            self.next += 1
        self.frames += len(rows)
        self.writer.write(rows)

    def close(self) -> tuple:
        self.drop()
        if self.frames != self.expected:
            raise ValueError(f"part {self.part} of clip {self.clip} holds {self.frames} frames of {self.expected}")
        return self.path, self.clip, self.part, self.frames

    def drop(self) -> None:
        self.writer.close()
        self.file.close()


class PartWriter(DataSourceArrowWriter):
    """Writes sorted rows of whole parts; one part is open at a time, and a batch of its rows in memory."""

    def __init__(self, path: str, part_frames: int):
        self.path, self.part_frames = path.rstrip("/"), part_frames
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files, base = _opened(self.path)
        files.create_dir(f"{base}/{self.staging}", recursive=True)
        done, now = [], None
        try:
            for batch in iterator:
                keys = list(zip(*(batch.column(c).to_pylist() for c in ("clip", "part", "expected")), strict=True))
                rows = batch.drop_columns(["expected"])
                starts = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
                for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
                    clip, part, expected = keys[a]
                    if now is None or (now.clip, now.part) != (clip, part):
                        if now is not None:
                            done.append(now.close())
                        now = _Open(files, f"{base}/{self.staging}/{uuid.uuid4().hex}", clip, part, expected, part * self.part_frames, rows.schema)
                    now.add(rows.slice(a, b - a))
            if now is not None:
                done.append(now.close())
        except BaseException:
            if now is not None:
                now.drop()
            raise
        return Staged(done)

    def commit(self, messages: list[Staged | None]) -> None:
        parts = [p for m in messages if m is not None for p in m.parts]
        files, base = _opened(self.path)
        if len({p[1:3] for p in parts}) < len(parts):
            self.abort(messages)
            raise ValueError("a part was written by more than one task: partition by clip and part")
        before = {(p.clip, p.part): p.path for p in _listed(self.path)}
        for staged, clip, part, frames in parts:
            final = f"{base}/clip-{clip}.part-{part}.frames-{frames}.parquet"
            files.move(staged, final)
            old = before.get((clip, part))
            if old is not None and old.rsplit("/", 1)[-1] != final.rsplit("/", 1)[-1]:
                files.delete_file(old)
        self._sweep()

    def abort(self, messages: list[Staged | None]) -> None:
        self._sweep()

    def _sweep(self) -> None:
        files, base = _opened(self.path)
        if files.get_file_info(f"{base}/{self.staging}").type == fs.FileType.Directory:
            files.delete_dir(f"{base}/{self.staging}")


class FrameParts(DataSource):
    """The data source ``frame_parts``."""

    @classmethod
    def name(cls) -> str:
        return "frame_parts"

    def schema(self) -> StructType:
        path = self.options["path"]
        parts = _listed(path)
        if not parts:
            raise ValueError(f"no parts under {path}: give their schema")
        with _opened(path)[0].open_input_file(parts[0].path) as file:
            return from_arrow_schema(pq.read_schema(file))

    def reader(self, schema: StructType) -> PartReader:
        return PartReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> PartWriter:
        if overwrite:
            raise ValueError("parts are replaced one by one: use mode append")
        return PartWriter(self.options["path"], int(self.options["part_frames"]))


def register(spark: SparkSession) -> None:
    """Make the source known to the session, with its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameParts)


def write_container(frames: DataFrame, path: str, part_frames: int) -> None:
    """``frames`` (clip, part, i, expected, ...) as parts under ``path``: all of them, or none if a task finds one that is not whole."""
    register(frames.sparkSession)
    sorted_parts = frames.repartition("clip", "part").sortWithinPartitions("clip", "part", "i")
    sorted_parts.write.format("frame_parts").option("path", path).option("part_frames", part_frames).mode("append").save()


def read_container(spark: SparkSession, path: str) -> DataFrame:
    """The frames of all parts under ``path``."""
    register(spark)
    return spark.read.format("frame_parts").load(path)


def container_states(spark: SparkSession, path: str) -> DataFrame:
    """(clip, part, frames) of the parts under ``path``, from their names, which the driver lists."""
    parts = _listed(path)
    names = ("clip", "part", "frames")
    return spark.createDataFrame(pa.table({n: pa.array([getattr(p, n) for p in parts], pa.int64()) for n in names}), ", ".join(f"{n} long" for n in names))


@dataclass(frozen=True)
class Staging:
    """A folder in a container, from which tasks put parts into place as soon as they have proven them."""

    path: str
    name: str = field(default_factory=lambda: f"_staging-{uuid.uuid4().hex}")

    def commit(self, clip: int, parts: list[tuple[int, int, int | None, pa.Table]]) -> None:
        """Put ``parts`` (part, its first frame, frames of the file that it replaces, rows) of a clip into place, once all of them are written."""
        files, base = _opened(self.path)
        files.create_dir(f"{base}/{self.name}", recursive=True)
        staged = []
        for part, first, stale, rows in parts:
            now = _Open(files, f"{base}/{self.name}/{uuid.uuid4().hex}", clip, part, rows.num_rows, first, rows.schema)
            now.add(rows)
            staged.append((*now.close(), stale))
        for at, _, part, frames, stale in staged:
            files.move(at, f"{base}/clip-{clip}.part-{part}.frames-{frames}.parquet")
            if stale is not None and stale != frames:
                files.delete_file(f"{base}/clip-{clip}.part-{part}.frames-{stale}.parquet")

    def sweep(self) -> None:
        """Drop what tasks that failed have left."""
        files, base = _opened(self.path)
        if files.get_file_info(f"{base}/{self.name}").type == fs.FileType.Directory:
            files.delete_dir(f"{base}/{self.name}")
