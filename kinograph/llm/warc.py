"""WARC archives: written and read in parallel, with records found by boundary-chain verification.

Writing is one text write: a record per row, revisit records for repeated payloads. Reading splits
archives anywhere: Hadoop's line reader cuts them at every line ``WARC/1.0``, real or inside a
payload (a ``.gz`` archive is one split, of however many members it is made), and each task emits for every such candidate the offset of its successor, from the
Content-Length of what would be its header. Chains are first shortened within a split to where
they leave it; pointer jumping from the start of each file over what is left, one row a split, then
tells the splits' true entries. Only candidates on the chain from an entry are records, so a magic
line inside a payload, even with a whole forged record after it, is read as payload.

Defined results: a null payload is written as empty; a null page_id or url leaves its header out
and reads back as null; line ends in a url are percent-encoded; rows with equal page_id and
payload are equal records, all of them responses if theirs is the smallest page_id; a chain that
breaks (a damaged record) ends its file's records there, and a record cut short by the end of
the file is not returned; an empty table gives an empty archive; other columns are ignored.
A header ends at its first empty line, however long it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinograph.llm.common import drop, map_arrow, materialize, split_rows

MAGIC = "WARC/1.0\r\n"
SEPARATOR = "\r\n" + MAGIC
#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 100
#: Rows up to which a table of known small rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000

_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d{1,15})[ \t]*\r?$")


def decide_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, bytes, digest and refers_to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    copied = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copied = materialize(copied.select(F.xxhash64("digest").alias("key"), F.col("digest").alias("copied"), "first"), "copied")
    if copied.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(copied.drop("key")), rows.digest == F.col("copied"), "left")
    else:  # only payloads that have copies are shuffled, and Spark can split a digest that many rows share
        alone, others = split_rows(rows.withColumn("key", F.xxhash64("digest")), "key", copied.select("key"))
        joined = others.join(copied.drop("key").hint("merge"), others.digest == F.col("copied"), "left").unionByName(alone, allowMissingColumns=True)
    return joined.select("page_id", "url", "payload", "bytes", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, path: str, least: int = REVISIT_BYTES, compression: str = "none") -> None:
    """One WARC record per row of ``pages`` (page_id, url, html) into archives under ``path``, plain or ``gzip``."""
    rows = decide_revisits(pages, least)
    revisit = F.col("refers_to").isNotNull()
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda name, value: F.coalesce(header(name, value), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat(
        F.lit(MAGIC),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        optional("WARC-Record-ID", urn(F.col("page_id"))),
        optional("WARC-Target-URI", url),
        header("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        optional("WARC-Refers-To", urn(F.col("refers_to"))),
        F.when(revisit, header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))).otherwise(""),
        header("X-Payload-Length", F.col("bytes").cast("string")),
        header("Content-Type", F.lit("text/html; charset=utf-8")),
        header("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.col("payload").cast("string")),
        F.lit("\r\n\r"),
    )
    rows.select(record.alias("value")).write.option("lineSep", "\n").option("compression", compression).text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): what stands between magic lines, in file order within a split."""
    return spark.read.option("lineSep", SEPARATOR).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )


def _header_end(head: bytes) -> tuple[int, int]:
    """Bytes of header with its empty line, and the Content-Length; (0, 0) if it is no header."""
    end = head.find(b"\r\n\r\n")
    length = _LENGTH.search(head, 0, end + 2) if end >= 0 else None
    return (end + 4, int(length[1])) if length else (0, 0)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per candidate its offset, where its chain leaves the split and the last record before; per split its bytes."""
    names = ["file", "block", "pos", "exit", "last", "len"]
    types = [pa.string(), *[pa.int64()] * 5]

    def flush(key, found, total):
        ends = {}  # offset -> (exit, last)
        for pos, to in reversed(found):
            ends[pos] = (None, pos) if to is None else ends[to] if to in ends else ((to, pos) if to >= total - len(SEPARATOR) else (None, pos))
        rows = [(*key, pos, *ends[pos], None) for pos, _ in found] + [(*key, None, None, None, total)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    key, found, at = None, [], 0
    for batch in batches:
        for file, block, head, n in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "head", "n")), strict=True):
            if (file, block) != key:
                if key:
                    yield flush(key, found, at)
                key, found, at = (file, block), [], 0
            first = at == 0 and block == 0
            if not first or head.startswith(MAGIC.encode()):
                skip = len(MAGIC) if first else 0
                size, length = _header_end(head[skip:] + b"\r\n\r\n") if len(head) + 4 <= n else (0, 0)
                found.append((0 if first else at - len(MAGIC), at + skip + size + length + 4 if size else None))
            at += n + len(SEPARATOR)
    if key:
        yield flush(key, found, at)


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """Per split: file, block, base, entry (offset of its first record in the split or null), and the
    record (owner) that the bytes before it belong to, with its end."""
    head = F.substring_index(F.col("value").cast("string"), "\r\n\r\n", 1).cast("binary")  # no payload goes to Python
    lines = _lines(spark, path).select("file", "block", head.alias("head"), F.octet_length("value").cast("long").alias("n"))
    marks = materialize(map_arrow(lines, _candidates, "file string, block long, pos long, exit long, last long, len long"), "candidates")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialize(marks.where("pos IS NULL").select("file", "block", F.coalesce(F.sum("len").over(before), F.lit(0)).alias("base")), "blocks")
    placed = marks.where("pos IS NOT NULL").join(blocks, ["file", "block"]).select("file", "block", (F.col("base") + F.col("pos")).alias("pos"), (F.col("base") + F.col("exit")).alias("jump"), (F.col("base") + F.col("last")).alias("last"))
    targets = placed.where("jump IS NOT NULL").select("file", F.col("jump").alias("pos")).distinct()
    starts = placed.where("pos = 0")
    heads = materialize(placed.where("pos > 0").join(targets, ["file", "pos"], "left_semi").select(starts.columns).unionByName(starts), "heads")
    reached = heads.where("pos = 0").select("file", "pos")
    jumps, known = heads.select("file", "pos", "jump").where("jump IS NOT NULL"), reached.count()
    while True:  # 2^k splits further after k rounds
        onward = reached.join(jumps, ["file", "pos"]).select("file", F.col("jump").alias("pos"))
        reached = materialize(reached.unionByName(onward.join(heads.select("file", "pos"), ["file", "pos"], "left_semi")).distinct(), "reached")
        if (now := reached.count()) == known:
            break
        known = now
        further = jumps.select("file", F.col("pos").alias("jump"), F.col("jump").alias("beyond"))
        jumps = materialize(jumps.join(further, ["file", "jump"]).select("file", "pos", F.col("beyond").alias("jump")), "jumps")
    entries = heads.join(reached, ["file", "pos"]).select("file", "block", "pos", "last", "jump")
    owner = F.last(F.when(F.col("last").isNotNull(), F.struct("last", "jump")), ignorenulls=True).over(before)
    plan = blocks.join(entries, ["file", "block"], "left").withColumn("owner", owner)
    plan = plan.select("file", "block", "base", (F.col("pos") - F.col("base")).alias("entry"), F.col("owner.last").alias("owner"), F.col("owner.jump").alias("owner_end"))
    plan = materialize(plan, "entries")
    drop(spark, marks.scratch)
    return plan


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records on the chain from each split's entry; parts of those that reach into later splits."""
    names = ["file", "pos", "at", "headers", "need", "data"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.binary()]

    def batched(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    key, at, wanted, record, rows, held = None, 0, None, None, [], 0
    for batch in batches:
        columns = [batch.column(c) for c in ("file", "block", "base", "entry", "owner", "owner_end", "value")]
        for i in range(batch.num_rows):
            file, block, base, entry, owner, owner_end, value = (c[i].as_py() for c in columns)
            if (file, block) != key:
                if record:
                    rows.append(record)
                key, at, wanted, record = (file, block), 0, entry, None
            first = at == 0 and block == 0
            pos, skip = (0, len(MAGIC)) if first else (at - len(MAGIC), 0)
            if wanted is not None and pos == wanted:
                size, length = _header_end(value[skip:])
                if size:
                    lines = value[skip : skip + size - 4].split(b"\r\n")
                    headers = {a.strip().lower().decode("utf-8", "replace"): b.strip().decode("utf-8", "replace") for a, _, b in (x.partition(b":") for x in lines)}
                    record = (file, base + pos, base + pos, list(headers.items()), length, value[skip + size :])
                    wanted = at + skip + size + length + 4
                else:
                    wanted = None
            elif record:
                record = (*record[:5], record[5] + SEPARATOR.encode() + value)
            elif owner is not None and (wanted is None or pos < wanted) and base + at < owner_end:
                rows.append((file, owner, base + at, None, None, SEPARATOR.encode() + value))
                held += len(value)
            if record and len(record[5]) >= record[4]:
                rows.append((*record[:5], record[5][: record[4]]))
                held, record = held + record[4], None
            at += len(value) + len(SEPARATOR)
            if held > 8 << 20 or len(rows) > 4096:
                yield batched(rows)
                rows, held = [], 0
    if record:
        rows.append(record)
    if rows:
        yield batched(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, headers, payload) for each reachable record of the archives under ``path``.

    ``headers`` maps lower-case names to values; ``pos`` is the record's offset in its file.
    """
    plan = _entries(spark, path)
    ragged = not plan.where("base > 0 AND (entry IS NULL OR entry > -10) AND owner_end > base").isEmpty()
    lines = _lines(spark, path)
    if plan.count() <= BROADCAST_ROWS:
        placed = lines.join(F.broadcast(plan), ["file", "block"])
    else:  # shuffled by split, whose size bounds a group, and put back in order
        placed = lines.withColumn("i", F.monotonically_increasing_id()).join(plan.hint("merge"), ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "i")
    placed = placed.select("file", "block", "base", "entry", "owner", "owner_end", "value")
    parts = map_arrow(placed, _records, "file string, pos long, at long, headers map<string,string>, need long, data binary")
    whole = parts.where("need IS NOT NULL AND octet_length(data) = need").select("file", "pos", "headers", F.col("data").alias("payload"))
    if not ragged:
        return whole
    torn = parts.where("need IS NULL OR octet_length(data) < need").groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("at", "data"))).alias("parts"), F.first("headers", ignorenulls=True).alias("headers"), F.max("need").alias("need"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["data"]))
    torn = torn.withColumn("payload", joined).where("octet_length(payload) >= need")
    return whole.unionByName(torn.select("file", "pos", "headers", F.substring("payload", F.lit(1), F.col("need").cast("int")).alias("payload")))
