"""What the corpus operators share: scratch tables, text folding and row keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z and nothing else, over bytes.
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

#: Characters that separate words: ASCII white space and nothing else.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


#: Temporary folders of applications with a local master.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder for the application; a cluster is refused, because
    its machines do not share one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="kinograph-")
        delete_on_exit(spark, _LOCAL[context.applicationId])
    return _LOCAL[context.applicationId]


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Ask the file system to drop ``path`` when the application ends."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, dropped when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    return path


#: For a table with megabytes of binary values in a row, ``squeezed`` already. Parquet looks at the size of what it holds only after 100 rows, its reader
#: decodes a row group at once, and its codecs take buffers of a page's size out of the heap: so a size of 8 MB that is looked at after each row, and no codec.
LONG_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(8 << 20), "parquet.enable.dictionary": "false", "compression": "none"}


def squeezed(values: np.ndarray) -> bytes:
    """An array as one compressed binary value."""
    return len(values.tobytes()).to_bytes(8, "little") + pa.compress(values.tobytes(), "zstd", asbytes=True)


def expanded(value: pa.Scalar, kind: type) -> np.ndarray:
    """The array of numpy type ``kind`` in a binary value."""
    told = value.as_buffer()
    size = int.from_bytes(told[:8].to_pybytes(), "little")
    return np.frombuffer(pa.decompress(told[8:], size, "zstd"), kind)


def materialize(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, with ``options`` of the writer, and read it back: a cut of the lineage that outlives executors.

    ``scratch`` of the result is its path.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def row_key(*columns: str) -> Column:
    """A key of a row from its values (nulls included): repeated rows share it, and retries give it again."""
    return F.xxhash64(*[F.struct(F.col(c).isNull(), F.col(c)) for c in columns])


#: Keys up to which a list of rows is broadcast (16 bytes each).
BROADCAST_KEYS = 2_000_000
#: Bits, as a power of two, of the filter that is broadcast instead of a longer list (32 MB).
FILTER_BITS = 28


def split_rows(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose long ``key`` is surely not among ``keys`` (one column), and all others.

    A bitmap of hashed keys, of one size whatever their number, tells them apart, so that of a long table
    only rows that are in the list, and a few more, have to be shuffled.
    """
    spread = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS)) + 1
    marks = keys.select(spread(F.col(keys.columns[0])).alias("h"))
    marks = marks.groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    marks = F.broadcast(materialize(marks, "marks"))
    names = rows.columns
    seen = rows.select(F.struct("*").alias("of_row"), spread(F.col(key)).alias("h")).withColumns({"bucket": F.bitmap_bucket_number("h"), "at": F.bitmap_bit_position("h")}).join(marks, "bucket", "left")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(F.col("at") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    hit = F.coalesce(F.call_function("getbit", byte, (F.col("at") % 8).cast("int")) == 1, F.lit(False))
    back = lambda df: df.select(*[F.col(f"of_row.`{c}`").alias(c) for c in names])
    return back(seen.where(~hit)), back(seen.where(hit))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, row): each row of ``docs`` (doc_id, text) as a struct, with its row key."""
    return docs.select(F.struct("*").alias("doc"), row_key("doc_id", "text").alias("row"))


def unkeyed(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names`` of the struct ``doc``."""
    return rows.select(*[F.col(f"doc.`{c}`").alias(c) for c in names])


def drop_rows(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key of (doc_id, text) is in ``keys`` (row)."""
    keys = materialize(keys.select("row"), "keys")
    if keys.count() <= BROADCAST_KEYS:
        left = keyed(docs).join(F.broadcast(keys), "row", "left_anti")
    else:
        left, others = split_rows(keyed(docs), "row", keys)
        left = left.unionByName(others.join(keys.hint("merge"), "row", "left_anti"))
    return unkeyed(left, docs.columns)


#: Bytes of rows that go to a Python worker at once, unless the session sets its own.
BATCH_BYTES = 4 << 20
_UNBOUNDED = 64 << 20


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, however long the texts are.

    The bound is a setting of the session: it is set here, once, unless the session has one of its own.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        bound = int(conf.get(name).rstrip("b"))
    except ValueError:
        bound = 0  # set with a unit, by the user
    if bound >= _UNBOUNDED:
        conf.set(name, str(BATCH_BYTES))

    return df.mapInArrow(released(function), schema)


def give_back() -> None:
    """Return freed memory to the system, where the C library can: a worker lives on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(function):
    """``function`` over batches, which gives back its memory at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return run


def strings(column: pa.Array) -> list:
    """The values of a string column as bytes; None where null."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the text of ``column`` in one holds about ``most`` bytes, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin = total = 0
        for i, n in enumerate(sizes):
            if i > begin and total + n > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += int(n)
        if begin < batch.num_rows:
            yield batch.slice(begin)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data set."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
