"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash (h = 2h + gear[byte], here its low 16 bits, so that it depends on the last 16 bytes)
cuts a text after white space where its top bits fall under a threshold, and anywhere else where a
rarer condition holds. From ``FAR`` bytes after the last ASCII white space on, and before the first, it cuts after
any character, as densely in bytes as after words, so texts without such spaces have chunks as short. Cuts depend on nearby bytes only:
an insertion shifts nothing beyond the next cut. From each chunk on, and up to each chunk, the shortest
run of consecutive chunks of at least ``least`` bytes is a window. Windows are counted by the 64-bit digest
of their whole text; one that stands in another document too is repeated, and repeated windows that meet
or overlap are a passage, if they cover ``passage`` bytes. A window goes where it stands in a document of a smaller id, so that the first
copy stays, and where windows that go cover as much.
Repeats within one document stay. Short chunks that many texts share cannot make a window unless they
stand together elsewhere.

Counts are combined before the shuffle and written as a table; occurrences then meet them in a join of
two plain tables, which Spark splits where a window is in very many documents.

Defined results: rows of one doc_id count as one document, so they take nothing from each
other; a null doc_id comes after all others; a null text has no chunks and stays null; a text that is
all repeats becomes empty; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.llm.common import keyed, map_arrow, materialize, row_key, slices, split_rows, strings

#: Bytes that a window has at least, and bytes that windows which meet or overlap cover where they are a repeated passage: some
#: 35 words, what the chunks within a passage of over 50 words nearly always come to.
LEAST_BYTES, PASSAGE_BYTES = 90, 210
#: Spans up to which the rows that lose text are broadcast rather than shuffled with the texts.
BROADCAST_SPANS = 500_000

WINDOW = 16
#: A random number for each byte; zero for NUL, which stands before a text's start.
GEAR = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 16, 256, dtype=np.uint16)
GEAR[0] = 0
#: The hash's top byte is under this after white space in one of about five words ...
AT_SPACE = 68
#: ... and the whole hash under this within words, once in about 2,000 bytes.
WITHIN = 32
#: Bytes without ASCII white space after which a cut may follow any character ...
FAR = 64
#: ... where the hash is under this for each byte of it, once in about 25 bytes.
UNSPACED = 2621
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The low 16 bits of the gear hash at each byte, by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        shifted = h.copy()
        shifted[step:] += h[:-step] << np.uint16(step)
        h = shifted
    return h


def cuts(texts: list[bytes]) -> list[np.ndarray]:
    """For each text, the offsets after which a chunk ends, its length last."""
    pad = b"\0" * WINDOW
    data = np.frombuffer(pad + pad.join(texts) + b"\0", np.uint8)
    h = gear_hashes(data)
    start = (data[1:] & 0xC0) != 0x80  # the next byte begins a character
    space = _SPACE[data]
    end = np.where(space[:-1], h[:-1] >> 8 < AT_SPACE, (h[:-1] < WITHIN) & start)
    # white space, and the NULs between texts, that stand last at each byte
    places = np.flatnonzero(space | (data == 0))
    gaps = np.diff(places)
    for k in np.flatnonzero((gaps > FAR) | (~space[places[:-1]] & (gaps > 1))).tolist():
        a, b = int(places[k]) + (FAR if space[places[k]] else 1), int(places[k + 1])
        begins = np.flatnonzero(start[a - 1 : b - 1])  # characters that begin in a:b
        width = np.diff(np.append(begins, b - a))
        last = a + begins + width - 1
        end[last] |= h[last] < UNSPACED * width
    ends, out, at = np.flatnonzero(end) + 1, [], WINDOW
    for text in texts:
        i, j = np.searchsorted(ends, (at + 1, at + len(text)))
        out.append(np.append(ends[i:j] - at, len(text)) if text else np.empty(0, np.int64))
        at += len(text) + WINDOW
    return out


def windows(ends: np.ndarray, least: int) -> np.ndarray:
    """The shortest runs of chunks with ``least`` bytes from each chunk on and up to each chunk: start << 32 | end, sorted."""
    starts = np.append(0, ends[:-1])[: len(ends)]
    on, up = np.searchsorted(ends, starts + least), np.searchsorted(starts, ends - least, "right") - 1
    begun, ended = on < len(ends), up >= 0
    return np.unique(np.concatenate([starts[begun] << 32 | ends[on[begun]], starts[up[ended]] << 32 | ends[ended]]))


def _windows(least: int):
    digest = xxhash.xxh3_64_intdigest

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            texts = [t or b"" for t in strings(batch.column("text"))]
            spans = [windows(c, least) for c in cuts(texts)]
            counts = [len(s) for s in spans]
            digests = np.fromiter((digest(t[a:b]) for t, s in zip(texts, spans, strict=True) for a, b in zip((s >> 32).tolist(), (s & 0xFFFFFFFF).tolist(), strict=True)), np.uint64, sum(counts))
            rows = pa.array(np.repeat(np.arange(len(texts)), counts))
            yield pa.RecordBatch.from_arrays([pa.array(digests.view(np.int64)), batch.column("doc_id").take(rows), batch.column("row").take(rows), pa.array(np.concatenate([np.empty(0, np.int64), *spans]))], ["digest", "doc_id", "row", "span"])

    return found


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """(digest, doc_id, row, span) for each window; span holds its start and end, in bytes, as 32 bits each."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key("doc_id", "text").alias("row"))
    return map_arrow(rows, _windows(least), "digest long, doc_id long, row long, span long")


def _runs(spans: list[tuple]) -> list[tuple]:
    """(begin, end, ids) of what (begin, end, id) that meet or overlap cover; they come sorted."""
    runs: list = []
    for a, b, i in spans:
        if runs and runs[-1][1] >= a:
            runs[-1][1] = max(runs[-1][1], b)
            runs[-1][2].add(i)
        else:
            runs.append([a, b, {i}])
    return [tuple(r) for r in runs]


def _passages(passage: int):
    """Per row with repeats: the spans that go, and the documents that hold the first copies."""

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (_passages_of(batch, lambda spans: [r for r in _runs(spans) if r[1] - r[0] >= passage]) for batch in batches)

    return passages


def _passages_of(batch: pa.RecordBatch, runs) -> pa.RecordBatch:
    """One row for each of ``batch`` (row, doc_id, found)."""
    out = []
    for row, own, found in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "found")), strict=True):
        first = {f["span"]: f["first"] for f in found}
        order = [(span >> 32, span & 0xFFFFFFFF, first[span]) for span in sorted(first)]
        shared = sum(b - a for a, b, _ in runs(order))
        gone = runs([x for x in order if x[2] is not None and x[2] != own])
        out.append((row, shared, [{"begin": a, "end": b} for a, b, _ in gone], sorted({x for *_, ids in gone for x in ids})))
    columns = list(zip(*out, strict=True)) or [()] * 4
    types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["row", "shared", "gone", "first_ids"])


def repeated_spans(docs: DataFrame, least: int = LEAST_BYTES, passage: int = PASSAGE_BYTES) -> DataFrame:
    """(row, shared, gone, first_ids) for each row key with a repeated passage.

    ``shared``: bytes in passages that stand elsewhere too; ``gone``: spans of bytes to remove;
    ``first_ids``: the documents that hold the copies that stay.
    """
    found = occurrences(docs, least)
    counted = found.groupBy("digest").agg(F.count("*").alias("n"), F.count("doc_id").alias("named"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    counted = counted.where("first < last OR named BETWEEN 1 AND n - 1").select("digest", "first")
    repeated = materialize(counted, "windows")
    met = found.join(repeated, "digest")  # rows repeated as a whole give each span again: a set holds it once
    of_row = met.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_set(F.struct("span", "first")).alias("found"))
    return map_arrow(of_row, _passages(passage), "row long, shared long, gone array<struct<begin:long,end:long>>, first_ids array<long>").where("shared > 0")


def without(text, gone):
    """``text`` without the spans of bytes ``gone``, as a column."""
    data, size = text.cast("binary"), F.octet_length(text).cast("long")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(gone, lambda g: g["end"]))
    begins = F.concat(F.transform(gone, lambda g: g["begin"]), F.array(size))
    kept = F.transform(F.arrays_zip(ends.alias("a"), begins.alias("b")), lambda p: F.substring(data, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")))
    return F.aggregate(kept, F.lit(b""), lambda x, y: F.concat(x, y)).cast("string")


def remove_repeats(docs: DataFrame, least: int = LEAST_BYTES, passage: int = PASSAGE_BYTES) -> DataFrame:
    """``docs`` with its columns, its texts without repeated passages (and n_chars, if there, to match)."""
    spans = materialize(repeated_spans(docs, least, passage).where("size(gone) > 0").select("row", "gone"), "spans")
    size = spans.agg(F.sum(F.size("gone") + 1)).first()[0] or 0
    if size <= BROADCAST_SPANS:
        marked = keyed(docs).join(F.broadcast(spans), "row", "left")
    else:  # only texts that lose something are shuffled
        same, others = split_rows(keyed(docs), "row", spans.select("row"))
        marked = others.join(spans.hint("merge"), "row", "left").unionByName(same.withColumn("gone", F.lit(None).cast(spans.schema["gone"].dataType)))
    text = F.when(F.col("gone").isNotNull(), without(F.col("doc.text"), F.col("gone"))).otherwise(F.col("doc.text"))
    out = {c: F.col(f"doc.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("gone").isNotNull(), F.length(text).cast("long")).otherwise(F.col("doc.n_chars"))
    return marked.select(*[v.alias(c) for c, v in out.items()])
