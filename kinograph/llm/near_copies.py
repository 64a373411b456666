"""SimHash near-dedup for texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts with equal folded words are one class before any comparison. SimHash over the same shingles comes first: classes that
differ in 3 bits or fewer meet in the covering tables of ``simhash``, and those that are near copies by their whole sets form
groups. But a pair at 0.8 differs in about 10 bits, for which no covering family of 64 bits is small enough to be of use; so
MinHash looks for what is near between these groups: 24 bands of 4 hashes each, so that a pair at 0.8 shares none with a chance
of 3e-6, and one that is more alike with less. Buckets and pairs within one group are left out before any text is read
for them. Each other candidate is compared by its whole sets, so that what is linked is similar by count and not by estimate.
In a bucket of at most ``direct`` classes all pairs of fitting sizes are compared. In a larger one each is
compared with the smallest; where that leaves more than one component, its members are dealt into blocks, and a search
from class to class over the sets of each two blocks gives the links, so that no task holds more than two blocks.

Defined results: a text of fewer words than a shingle is one shingle; a text without words is like others
without words only; a null doc_id comes after all others; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.llm import simhash
from kinograph.llm.common import BROADCAST_KEYS, LOWER, keyed, map_arrow, materialize, row_key, slices, split_rows, strings
from kinograph.llm.components import connected_components

SHINGLE = 5
BANDS, ROWS = 24, 4
#: Members of a block of a large bucket, about.
BLOCK = 512
_FACTORS = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.Generator(np.random.PCG64(6)).integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None) -> tuple[int, np.ndarray]:
    """The digest of a UTF-8 text's folded words, and the sorted hashes of its distinct shingles."""
    words = (text or b"").translate(LOWER).split()
    joined, digest = b" ".join(words), xxhash.xxh3_64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: max(len(words) - SHINGLE + 1, min(len(words), 1))].tolist()
    stops = ends[SHINGLE - 1 :].tolist() or ends[-1:].tolist()
    found = np.array([digest(joined[a:b]) for a, b in zip(starts, stops, strict=True)], np.uint64)
    return digest(joined), np.unique(found)


def alike(common, one, other):
    """Whether sets of these sizes have a Jaccard similarity of 0.8 or more."""
    return 5 * common >= 4 * (one + other - common)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 2 << 20):
        found = [shingles(t) for t in strings(batch.column("text"))]
        sizes = np.array([len(s) for _, s in found])
        full = np.flatnonzero(sizes)
        keys = np.zeros((len(full), BANDS), np.uint64)
        if len(full):
            hashes = np.concatenate([s for _, s in found])
            starts = (np.cumsum(sizes) - sizes)[full]
            for band in range(BANDS):
                for row in range(ROWS):
                    keys[:, band] = (keys[:, band] ^ np.minimum.reduceat(hashes * _FACTORS[band, row], starts)) * _MIX[row]
                    keys[:, band] ^= keys[:, band] >> np.uint64(29)
                keys[:, band] += np.uint64(band)
        prints = np.array([simhash.majority(s) for _, s in found], np.uint64).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
        copies = np.array([c for c, _ in found], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(copies), pa.array(sizes), pa.array(prints), lists], ["doc_id", "row", "copy", "n", "fp", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 2 << 20):
        found = [shingles(t) for t in strings(batch.column("text"))]
        copies = np.array([c for c, _ in found], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(copies), pa.array([s.tobytes() for _, s in found], pa.binary())], ["copy", "words"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("x", "y")]
        near = pa.array([bool(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))) for x, y in zip(*sets, strict=True)], pa.bool_())
        yield batch.select(["a", "b"]).filter(near)


def _search(table: pa.Table) -> pa.Table:
    """Edges that join all near copies of one bucket (copy, words)."""
    copies = table.column("copy").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
    sizes = np.array(list(map(len, sets)))
    flat, starts = np.concatenate(sets), np.cumsum(sizes) - sizes
    left, edges = np.ones(len(sets), bool), []
    while left.any():
        front = [int(np.argmax(left))]
        left[front] = False
        while front:
            at = front.pop()
            i = np.searchsorted(sets[at], flat)
            common = np.add.reduceat((sets[at][np.minimum(i, sizes[at] - 1)] == flat).astype(np.int64), starts)
            for near in np.flatnonzero(left & alike(common, sizes[at], sizes)).tolist():
                edges.append((int(copies[at]), int(copies[near])))
                left[near] = False
                front.append(near)
    return pa.table([pa.array(c, pa.int64()) for c in (list(zip(*edges, strict=True)) or [(), ()])], ["a", "b"])


def _sets_of(docs: DataFrame, signatures: DataFrame, wanted: DataFrame) -> DataFrame:
    """(copy, words): the sets of the classes ``wanted`` (copy), each from one of its rows."""
    rows = materialize(signatures.join(wanted, "copy").groupBy("copy").agg(F.min("row").alias("row")).select("row"), "rows")
    texts = keyed(docs.select("doc_id", "text"))
    if rows.count() <= BROADCAST_KEYS:
        texts = texts.join(F.broadcast(rows), "row", "left_semi")
    else:
        _, texts = split_rows(texts, "row", rows)
        texts = texts.join(rows.hint("merge"), "row", "left_semi")
    texts = texts.groupBy("row").agg(F.first(F.col("doc.text").cast("string")).alias("text"))
    return materialize(map_arrow(texts.select("text"), _sets, "copy long, words binary"), "sets")


def _near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that are near copies by their whole sets."""
    both = pairs.join(sets.select(F.col("copy").alias("a"), F.col("words").alias("x")), "a").join(sets.select(F.col("copy").alias("b"), F.col("words").alias("y")), "b")
    return materialize(map_arrow(both, _compare, "a long, b long"), "near")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("copy")).unionByName(pairs.select(F.col("b").alias("copy")))


def links(docs: DataFrame, signatures: DataFrame, direct: int = 16) -> DataFrame:
    """Edges (a, b) between classes (``copy``) that join all near copies."""
    close = materialize(_close(signatures).distinct(), "close")
    first = _near(close, _sets_of(docs, signatures, _ends(close).distinct()))
    groups = materialize(connected_components(first).select(F.col("node").alias("copy"), F.col("root").alias("group")), "groups")
    grouped = signatures.select("copy", "n", "keys").join(groups, "copy", "left").withColumn("group", F.coalesce("group", "copy"))
    keys = grouped.select("copy", "n", "group", F.explode("keys").alias("key")).distinct()
    # a bucket whose classes SimHash has joined already has nothing left to find
    shared = keys.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("copy", "n", "group")).alias("head"), F.min("group").alias("low"), F.max("group").alias("high")).where("low < high")
    shared = shared.select("key", "m", F.col("head.copy").alias("head"), F.col("head.n").alias("head_n"), F.col("head.group").alias("head_group"))
    members = materialize(keys.join(shared, "key"), "members")
    fits = "group <> head_group AND 5 * least(n, head_n) >= 4 * greatest(n, head_n)"
    small = members.where(f"m <= {direct}").select("key", "copy", "n", "group")
    other = small.select("key", F.col("copy").alias("head"), F.col("n").alias("head_n"), F.col("group").alias("head_group"))
    near = small.join(other, "key").where(f"copy > head AND {fits}").select(F.col("head").alias("a"), F.col("copy").alias("b"))
    star = members.where(f"m > {direct} AND copy <> head AND {fits}").select(F.col("head").alias("a"), F.col("copy").alias("b"))
    pairs = materialize(near.unionByName(star).distinct(), "pairs")
    large = members.where(f"m > {direct}").select("copy")
    sets = _sets_of(docs, signatures, _ends(pairs).unionByName(large).distinct())
    edges = first.unionByName(_near(pairs, sets))
    if large.isEmpty():
        return edges
    roots = connected_components(edges).withColumnRenamed("node", "copy")
    placed = members.where(f"m > {direct}").select("key", "copy").join(roots, "copy", "left").withColumn("root", F.coalesce("root", "copy"))
    split = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / BLOCK).alias("blocks")).where("low < high")
    dealt = placed.join(materialize(split.select("key", "blocks"), "split"), "key")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("copy"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = dealt.select("key", "copy", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    cells = cells.join(sets, "copy").select("key", "low", "high", "copy", "words")
    return edges.unionByName(cells.groupBy("key", "low", "high").applyInArrow(_search, "a long, b long"))


def _close(signatures: DataFrame) -> DataFrame:
    """Pairs (a, b) that join the classes whose fingerprints differ in 3 bits or fewer."""
    prints = signatures.where("n > 0").groupBy("fp", "copy").agg(F.lit(1)).select("fp", "copy")
    heads = materialize(prints.groupBy("fp").agg(F.min("copy").alias("head")), "prints")
    equal = prints.join(heads, "fp").where("copy <> head").select(F.col("head").alias("a"), F.col("copy").alias("b"))
    edges = simhash.links(heads.select("fp"))
    named = lambda side: heads.select(F.col("fp").alias(side), F.col("head").alias(f"head_{side}"))
    linked = edges.join(named("a"), "a").join(named("b"), "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    return equal.unionByName(linked)


def near_copies(docs: DataFrame, direct: int = 16) -> DataFrame:
    """(doc_id, row, root) for each row: ``root`` is the same for all that near copies join."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key("doc_id", "text").alias("row"))
    signatures = materialize(map_arrow(rows, _signatures, "doc_id long, row long, copy long, n long, fp long, keys array<long>"), "signatures")
    roots = materialize(connected_components(links(docs, signatures, direct)).withColumnRenamed("node", "copy"), "roots")
    return signatures.join(roots, "copy", "left").select("doc_id", "row", F.coalesce("root", "copy").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of its smallest doc_id (of those, of the smallest row key)."""
    return simhash.keep_first(docs, near_copies(docs))
