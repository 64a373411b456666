"""The segment driver: plan, context, repair, parts and the proof that they join, as one run that can be taken up again."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kinograph.operators.repair import Repairer, repairer_of
from kinograph.operators.shots import segments, thinned
from kinograph.sources.containers import Staging, container_states, read_container, write_container
from kinograph.sources.records import MANIFEST, MANIFEST_VERSION, parsed
from kinograph.sources.scratch import written

#: A block of fewer frames is not halved, nor one halved this often; frames of context that halves give each other.
LEAST_BLOCK, DEEPEST, JOIN_CONTEXT = 32, 3, 16


@dataclass(frozen=True)
class Settings:
    """What decides the rows of a run, besides its frames, cuts and mask."""

    repairer: str
    least: int  # frames of a shot
    segment: int
    overlap: int
    part_frames: int


def out_of_memory(failure: BaseException) -> bool:
    """Whether a failure is one of memory, by its type or its words."""
    return isinstance(failure, MemoryError) or "out of memory" in str(failure).lower() or "outofmemory" in type(failure).__name__.lower()


def repaired_or_halved(repairer: Repairer, block: np.ndarray, mask: np.ndarray, depth: int = 0) -> tuple[np.ndarray, int]:
    """(``block`` repaired, how often it was halved): a block that memory fails for is done in halves that see frames of each other."""
    try:
        return np.where(mask, repairer(block, mask), block), 0
    except Exception as failure:
        if not out_of_memory(failure) or len(block) < LEAST_BLOCK or depth >= DEEPEST:
            raise
    middle = len(block) // 2
    reach = min(JOIN_CONTEXT, middle)
    before, n = repaired_or_halved(repairer, block[: middle + reach], mask, depth + 1)
    after, m = repaired_or_halved(repairer, block[middle - reach :], mask, depth + 1)
    return np.concatenate([before[:middle], after[reach:]]), n + m + 1


def _repair(repairer: Repairer, mask: np.ndarray):
    """Over one segment with its context: the frames of its body, repaired."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        px = rows.column("px").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, *mask.shape)
        done, halved = repaired_or_halved(repairer, px, mask)
        body = rows.column("body").to_numpy()
        kept, n = done[body].reshape(-1), int(body.sum())
        size = mask.size
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * size + 1, size, dtype=np.int32)), pa.array(kept))
        own = rows.filter(rows.column("body"))
        return pa.table([own.column("clip"), own.column("s"), own.column("i"), lists, pa.array(np.full(n, halved, np.int32))], ["clip", "s", "i", "px", "halved"])

    return run


def _manifest(spark: SparkSession, path: str, settings: Settings, mask: np.ndarray) -> None:
    """Keep the parts under ``path`` if they were made with these settings; drop them if not."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    told = json.dumps({**asdict(settings), "mask": hashlib.sha256(np.packbits(mask).tobytes() + repr(mask.shape).encode()).hexdigest()}, sort_keys=True)
    if files.exists(hadoop(f"{path}-manifest")):
        doc = spark.read.text(f"{path}-manifest").select(parsed(F.col("value"), MANIFEST, MANIFEST_VERSION).alias("d")).first()
        if doc is not None and doc.d is not None and doc.d.fingerprint == told:
            return
    files.delete(hadoop(path), True)
    text = F.to_json(F.struct(F.lit(MANIFEST_VERSION).alias("version"), F.lit(told).alias("fingerprint"), F.lit(settings.part_frames).cast("long").alias("part_frames")))
    spark.range(1).select(text.alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}-manifest")


def planned(frames: DataFrame, cuts: DataFrame, settings: Settings) -> DataFrame:
    """(clip, total, s, e, left, right): the segments of every clip."""
    totals = frames.groupBy("clip").agg(F.count("*").alias("total"))
    starts = totals.select("clip", F.lit(0).cast("long").alias("i"))
    bounds = thinned(cuts.select("clip", F.col("i").cast("long").alias("i")).unionByName(starts), "clip", "i", settings.least)
    return segments(bounds, totals, "clip", settings.least, settings.segment, settings.overlap)


def drive(frames: DataFrame, cuts: DataFrame, mask: np.ndarray, path: str, settings: Settings, stride: int | None = None) -> dict[str, int]:
    """Repair ``frames`` (clip, i, px) under ``mask`` into parts under ``path``; what was done: segments, frames, halved (frames of halved blocks), parts, waves.

    ``i`` counts a clip's frames from 0; ``cuts`` (clip, i) are where shots begin. Parts that are whole already stay, if the manifest tells of the same settings; a
    segment of which a frame is missing is repaired as a whole, since it is reproducible only so. With ``stride``, that many parts of a clip are
    committed at a time, by the tasks that repair them, in the order of these waves; a run that breaks off keeps what was committed. Without, all are committed at once.
    A task ends at the first failure of a repair (tried again as often as Spark tries tasks) and the others go on, so that what can be done is; then the failure of
    the earliest wave is raised. At the end all parts are proven to join. A null clip is refused, an empty table gives no parts.
    """
    spark, size, repairer = frames.sparkSession, settings.part_frames, repairer_of(settings.repairer)
    if not frames.where("clip IS NULL").isEmpty():
        raise ValueError("a frame has no clip")
    _manifest(spark, path, settings, mask)
    plan = written(planned(frames, cuts, settings), "plan")
    wanted = plan.select("clip", "total").distinct().withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / size))))
    wanted = wanted.select("clip", "part", F.least(F.lit(size), F.col("total") - F.col("part") * size).cast("long").alias("expected"))
    missing = wanted.join(container_states(spark, path), ["clip", "part"], "left").where("frames IS NULL OR frames <> expected")
    wave = F.floor(F.col("part") / stride) if stride else F.lit(0).cast("long")
    todo = written(missing.select("clip", "part", "expected", F.col("frames").alias("stale"), wave.alias("wave")), "todo")
    told = todo.agg(F.count("*").alias("parts"), F.count_distinct("wave").alias("waves"), F.count_distinct("wave", "clip").alias("pieces")).first()
    report = {"segments": 0, "frames": 0, "halved": 0, "parts": told.parts, "waves": told.waves}
    if told.parts and stride:
        report |= _driven(frames, plan, todo, repairer, mask, path, size, stride, told.pieces)
    elif told.parts:
        done = _wave(frames, plan, todo.drop("wave", "stale"), repairer, mask, size)
        seen = Observation()
        counted = done.observe(seen, F.count("*").alias("frames"), F.count_if("head").alias("segments"), F.count_if(F.col("halved") > 0).alias("halved"))
        write_container(counted.select("clip", "part", "i", "px", "expected"), path, size)
        report |= seen.get
    joined = wanted.join(container_states(spark, path), ["clip", "part"], "full").where("NOT (frames <=> expected)")
    if not joined.isEmpty():
        raise ValueError(f"the parts under {path} do not join: {joined.first()}")
    return report


#: Pieces (the parts of a clip that are committed at a time) that a task works on, and tasks for each core where there are few.
PIECES, TASKS = 512, 3


def _driven(frames: DataFrame, plan: DataFrame, todo: DataFrame, repairer: Repairer, mask: np.ndarray, path: str, size: int, stride: int, pieces: int) -> dict[str, int]:
    """Repair the parts in ``todo`` and commit them, ``stride`` of a clip at a time; segments, frames, halved.

    A piece is the segments that reach into these parts, with their context. It is worked on by one task, and a task goes through its own by wave.
    """
    context = frames.sparkSession.sparkContext
    of = plan.withColumn("wave", F.explode(F.sequence(F.floor(F.col("s") / (size * stride)), F.floor((F.col("e") - 1) / (size * stride)))))
    parts = todo.groupBy("clip", "wave").agg(F.sort_array(F.collect_list(F.struct("part", "expected", "stale"))).alias("parts"))
    some = of.join(parts, ["clip", "wave"])
    bodies = lambda p: (F.col("s") < p["part"] * size + p["expected"]) & (F.col("e") > p["part"] * size)
    some = some.where(F.exists("parts", bodies))
    seen = some.select("clip", "wave", "parts", "s", "e", F.explode(F.sequence(F.col("s") - F.col("left"), F.col("e") + F.col("right") - 1)).alias("i"))
    tasks = max(1, min(pieces, max(TASKS * context.defaultParallelism, -(-pieces // PIECES))))
    rows = seen.join(frames.select("clip", "i", "px"), ["clip", "i"]).select("clip", "wave", "parts", "s", "e", "i", "px")
    dealt = rows.repartition(tasks, "wave", "clip").sortWithinPartitions("wave", "clip", "s", "i")
    staging = Staging(path)
    tries = 1 if context.master.split("[")[0] == "local" else int(context.getConf().get("spark.task.maxFailures", "4"))
    try:
        done = dealt.mapInArrow(_pieces(repairer, mask, size, staging, tries), "wave long, clip long, segments long, frames long, halved long, failure string")
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("segments", "frames", "halved")]
        told = done.agg(*sums, F.min(F.when(F.col("failure").isNotNull(), F.struct("wave", "clip", "failure"))).alias("failed")).first()
    finally:
        staging.sweep()
    if told.failed:
        raise RuntimeError(f"wave {told.failed.wave} of clip {told.failed.clip}: {told.failed.failure}")
    return {c: told[c] for c in ("segments", "frames", "halved")}


def _pieces(repairer: Repairer, mask: np.ndarray, size: int, staging: Staging, tries: int):
    """Over rows of pieces, by wave, clip, segment and frame: each piece repaired and committed."""

    def finished(batches: list[pa.RecordBatch]) -> tuple[int, int, int]:
        rows = pa.Table.from_batches(batches).combine_chunks()
        clip, parts = rows.column("clip")[0].as_py(), rows.column("parts")[0].as_py()
        s, e, i = (rows.column(c).to_numpy() for c in ("s", "e", "i"))
        px = rows.column("px").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, *mask.shape)
        body, halved, out = (i >= s) & (i < e), np.zeros(len(i), np.int64), np.empty_like(px)
        ends = np.append(np.flatnonzero(np.diff(s)) + 1, len(s))
        for a, z in zip([0, *ends[:-1]], ends, strict=True):
            out[a:z], halved[a:z] = repaired_or_halved(repairer, px[a:z], mask)
        at, out, halved, heads = i[body], out[body], halved[body], (i == s)[body]
        proven, told = [], np.zeros(3, np.int64)
        for part in parts:
            first = part["part"] * size
            a, z = np.searchsorted(at, (first, first + part["expected"]))
            if z - a != part["expected"]:
                raise ValueError(f"part {part['part']} of clip {clip} holds {z - a} frames of {part['expected']}")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (z - a) * mask.size + 1, mask.size, dtype=np.int32)), pa.array(out[a:z].reshape(-1)))
            columns = [pa.array(np.full(z - a, clip)), pa.array(np.full(z - a, part["part"])), pa.array(at[a:z]), lists]
            proven.append((part["part"], first, part["stale"], pa.table(columns, ["clip", "part", "i", "px"])))
            told += (heads[a:z].sum(), z - a, (halved[a:z] > 0).sum())
        staging.commit(clip, proven)
        return tuple(told.tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last, failed = None, False

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal failed
            told, failure = (0, 0, 0), None
            if not held or failed:
                return
            try:
                told = finished(held)
            except Exception as error:
                if TaskContext.get().attemptNumber() + 1 < tries:
                    raise
                failed, failure = True, f"{type(error).__name__}: {error}"
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*last, *told, failure), kinds, strict=True)], ["wave", "clip", "segments", "frames", "halved", "failure"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("wave", "clip")], axis=1)
            starts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist()] if len(keys) else []
            for a, z in zip(starts, [*starts[1:], len(keys)], strict=True):
                key = tuple(keys[a].tolist())
                if key != last:
                    yield from done()
                    held, last = [], key
                held.append(batch.slice(a, z - a))
        yield from done()

    return run


def _wave(frames: DataFrame, plan: DataFrame, todo: DataFrame, repairer: Repairer, mask: np.ndarray, size: int) -> DataFrame:
    """(clip, part, expected, i, px, halved, head) of the parts in ``todo``; a head is the first of these frames in its segment."""
    of = plan.withColumn("part", F.explode(F.sequence(F.floor(F.col("s") / size), F.floor((F.col("e") - 1) / size))))
    some = of.join(todo, ["clip", "part"], "left_semi").drop("part").distinct()
    seen = some.select("clip", "s", "e", F.explode(F.sequence(F.col("s") - F.col("left"), F.col("e") + F.col("right") - 1)).alias("i"))
    blocks = seen.join(frames.select("clip", "i", "px"), ["clip", "i"]).withColumn("body", (F.col("i") >= F.col("s")) & (F.col("i") < F.col("e")))
    done = blocks.select("clip", "s", "i", "px", "body").groupBy("clip", "s").applyInArrow(_repair(repairer, mask), "clip long, s long, i long, px array<double>, halved int")
    placed = done.withColumn("part", F.floor(F.col("i") / size)).join(todo, ["clip", "part"])
    return placed.select("clip", "part", F.col("expected").cast("long").alias("expected"), "i", "px", "halved", (F.col("i") == F.col("s")).alias("head"))


def repaired(spark: SparkSession, path: str) -> DataFrame:
    """(clip, part, i, px) of all parts that ``drive`` left under ``path``."""
    return read_container(spark, path)
