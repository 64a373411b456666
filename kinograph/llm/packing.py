"""Best-fit packing of documents into bins of equal capacity, under conflicts.

A document's tokens and one end are split into full bins and a rest. The rests, longest first, go to bins
ordered by what they have left; each bin carries bitmaps of the sources and duplicate clusters in it, and
a document may not share a bin with its source or its cluster. The search begins at the
smallest residual that holds the document and goes on to the next, until the tightest compatible
bin is found; without one a new bin opens. Bins are built in shards of about ``SHARD`` documents
of equal size whatever their sources, so that no task grows with the input; a shard leaves a few bins
open at its end. Clusters are near-duplicate classes: what links of at most 3 bits join between SimHash fingerprints of
three-word shingles, made here from hashes of words in the pass that counts tokens.

Defined results: a null or empty text is one end token; a null source conflicts with nothing, nor does a text without
words by its cluster; repeated rows are packed each; equal lengths go in the order of their row keys; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.llm import simhash
from kinograph.llm.common import LOWER, SPACES, map_arrow, materialize, row_key, slices, strings
from kinograph.llm.components import connected_components
from kinograph.llm.token_counts import Counter

CAPACITY = 4096
#: Documents of a shard, about.
SHARD = 4096
#: Equal rows that are numbered in one task.
_COPIES = 1 << 16


class Bins:
    """Open bins by residual, oldest first, with bitmaps of what is in them."""

    def __init__(self, capacity: int):
        self.capacity, self.left, self.sources, self.clusters = capacity, [], [], []
        self.by_left: dict[int, list[int]] = {}
        self.some = 0  # bit r: there is a bin with r left

    def place(self, size: int, source: int, cluster: int) -> int:
        """The bin for an item; ``source`` and ``cluster`` are bitmaps of one bit, or 0."""
        residuals, r = self.some >> size, size
        while residuals:
            step = (residuals & -residuals).bit_length() - 1
            r += step
            for bin in self.by_left[r]:
                if not (self.sources[bin] & source or self.clusters[bin] & cluster):
                    self._move(bin, r, size, source, cluster)
                    return bin
            residuals >>= step + 1
            r += 1
        self.left.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        bin = len(self.left) - 1
        self._move(bin, None, size, source, cluster)
        return bin

    def _move(self, bin: int, r: int | None, size: int, source: int, cluster: int) -> None:
        if r is not None:
            self.by_left[r].remove(bin)
            if not self.by_left[r]:
                self.some &= ~(1 << r)
        left = self.left[bin] = self.left[bin] - size
        self.sources[bin] |= source
        self.clusters[bin] |= cluster
        if left:
            insort(self.by_left.setdefault(left, []), bin)
            self.some |= 1 << left


def pack(items: list[tuple], capacity: int = CAPACITY) -> list[tuple]:
    """(bin, position, item number, piece, begin, tokens) for items (tokens, source, cluster), in the order given."""
    bins, out, full, sources, clusters = Bins(capacity), [], [], {}, {}
    rests = []
    for i, (tokens, source, cluster) in enumerate(items):
        whole, rest = divmod(tokens, capacity)
        full += [(i, k, k * capacity, capacity) for k in range(whole)]
        if rest:
            rests.append((rest, i, whole, source, cluster))
    counts: dict = {}
    for rest, i, whole, source, cluster in sorted(rests, key=lambda x: (-x[0], x[1])):
        s = 0 if source is None else 1 << sources.setdefault(source, len(sources))
        c = 0 if cluster is None else 1 << clusters.setdefault(cluster, len(clusters))
        bin = bins.place(rest, s, c)
        out.append((bin, counts.get(bin, 0), i, whole, whole * capacity, rest))
        counts[bin] = counts.get(bin, 0) + 1
    first = len(bins.left)
    return out + [(first + k, 0, *piece) for k, piece in enumerate(full)]


_MIX = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_FACTOR = np.uint64(0x9FB21C651E98DF25)
#: Bytes whose words are hashed at once, about.
_BLOCK = 1 << 17
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, how many each text has): polynomials in their bytes, made for many at once."""
    data = np.frombuffer(b" ".join(texts).translate(LOWER), np.uint8)
    space, begin = _SPACE[data], 0
    found, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    while begin < len(data):
        end = begin + _BLOCK
        if end < len(data):  # blocks end at a space
            end += int(np.argmax(space[end:]))
        if end >= len(data) or not space[end]:
            end = len(data)
        inside = np.concatenate([[False], ~space[begin:end], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        if len(starts):
            powers = np.cumprod(np.append(np.uint64(1), np.full(int(sizes.max()) - 1, _FACTOR, np.uint64)))
            firsts = np.cumsum(sizes) - sizes
            place = np.arange(sizes.sum()) - np.repeat(firsts, sizes)
            h = np.add.reduceat(_BYTES[data[begin:end][inside[1:-1]]] * powers[place], firsts)
            found.append(starts + begin)
            hashes.append(h ^ (h >> np.uint64(32)))
        begin = end
    lasts = np.cumsum([len(t) + 1 for t in texts])
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(found), lasts), prepend=0)


def fingerprints(texts: list[bytes | None]) -> list[int | None]:
    """SimHash of each text's three-word shingles (of a shorter text as a whole) over hashes of words; None without words."""
    hashes, counts = word_hashes([t or b"" for t in texts])
    out: list = []
    for n, end in zip(counts.tolist(), np.cumsum(counts).tolist(), strict=True):
        h, size = hashes[end - n : end], min(3, n)
        mixed = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            mixed = (mixed ^ h[k : n - size + 1 + k]) * _MIX[k]
            mixed ^= mixed >> np.uint64(32)
        out.append(simhash.majority(mixed) if n else None)
    return out


def fingerprint(words: list[bytes], memo: dict | None = None) -> int | None:
    """The fingerprint of one text, from its words."""
    return fingerprints([b" ".join(words)])[0]


def measure(docs: DataFrame, vocabulary: tuple) -> DataFrame:
    """(row, doc_id, source, fp, tokens) for each row; fp is null for a text without words."""
    shared = docs.sparkSession.sparkContext.broadcast(Counter(vocabulary))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            tokens = [n + 1 for n in shared.value.texts(batch.column("text").to_pylist())]
            prints = fingerprints(strings(batch.column("text")))
            signed = [None if p is None else p - (1 << 64) if p >> 63 else p for p in prints]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "doc_id", "source")], pa.array(signed, pa.int64()), pa.array(tokens, pa.int64())], ["row", "doc_id", "source", "fp", "tokens"])

    rows = docs.select(row_key("doc_id", "text", "source").alias("row"), F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return map_arrow(rows, measured, "row long, doc_id long, source string, fp long, tokens long")


def pack_documents(docs: DataFrame, vocabulary: tuple, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(bin_id, position, doc_id, piece, begin, tokens) for each piece of each row of ``docs`` (doc_id, text, source)."""
    # equal rows become one with a number, and each copy then goes to a shard of its own
    each = measure(docs, vocabulary).groupBy("row", "doc_id", "source", "fp", "tokens").agg(F.count("*").alias("n"))
    each = materialize(each, "items")
    prints = materialize(each.where("fp IS NOT NULL").select("fp").distinct(), "prints")
    roots = materialize(connected_components(simhash.links(prints)).select(F.col("node").alias("fp"), "root"), "roots")
    each = each.join(roots, "fp", "left").withColumn("cluster", F.coalesce("root", "fp")).drop("root", "fp")
    total, most = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    shards = 1 + total // shard
    if most > _COPIES:  # the copies of one row are numbered in several tasks
        each = each.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_COPIES).cast("long")))).repartition("row", "from")
    else:
        each = each.withColumn("from", F.lit(0).cast("long"))
    items = each.withColumn("copy", F.explode(F.sequence(F.col("from") + 1, F.least(F.col("n"), F.col("from") + _COPIES)))).drop("n", "from")
    items = items.withColumn("shard", F.pmod(F.xxhash64("row", "copy"), F.lit(shards)))

    def packed(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["tokens", "source", "cluster", "row", "copy", "doc_id", "shard"]).to_pylist(), key=lambda r: (r["row"], r["copy"]))
        placed = pack([(r["tokens"], r["source"], r["cluster"]) for r in rows], capacity)
        base = rows[0]["shard"] << 32
        out = [(base + b, p, rows[i]["doc_id"], k, a, n) for b, p, i, k, a, n in placed]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["bin_id", "position", "doc_id", "piece", "begin", "tokens"])

    return items.groupBy("shard").applyInArrow(packed, "bin_id long, position long, doc_id long, piece long, begin long, tokens long")
