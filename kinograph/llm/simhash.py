"""SimHash near-duplicates with covering locality-sensitive hashing.

A covering family for radius 3: bit i of a fingerprint gets the vector ``i mod 15 + 1`` of F_2^4, and
table v (15 of them) keeps the bits whose vector has an odd product with v. The vectors of any
three differing bits leave some v orthogonal to them all, so each pair within the radius has
equal keys in some table: no link can be missed.

Equal fingerprints are one class before any join. A bucket of at most ``direct`` classes is
searched as it is; a larger one is split by a second covering of its free bits, which leaves at
most 2^14 fingerprints with equal keys whatever the data. Within a bucket a search from class
to class gives one edge per class, never all pairs.

Defined results: a null text has no words, so its fingerprint is zero; texts of fewer words than a
shingle are hashed whole; repeated rows give repeated result rows; a null doc_id is fingerprinted
and linked, and counts as no id for the smallest; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.llm.common import BROADCAST_KEYS, LOWER, drop_rows, keyed, map_arrow, materialize, row_key, slices, split_rows, strings, unkeyed
from kinograph.llm.components import connected_components

RADIUS = 3
TABLES = 15
SEED = 42


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a UTF-8 text's word shingles, repeats included."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], "<u8")
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of ``hashes`` (64 bits each)."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4080):
        bits = np.unpackbits(hashes[i : i + 4080].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255  # bytes hold the sums of 255 bits
        votes += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = np.array([fingerprint(t) for t in strings(batch.column("text"))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(found)], ["doc_id", "row", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, row, fp) for each row of ``docs``; row is its row key."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key("doc_id", "text").alias("row"))
    return map_arrow(rows, _fingerprints, "doc_id long, row long, fp long")


def covering_masks(bits: list[int]) -> list[int]:
    """For each of the 15 tables, the mask of those ``bits`` that its key keeps."""
    return [sum(1 << bit for i, bit in enumerate(bits) if ((i % TABLES + 1) & v).bit_count() % 2) for v in range(1, TABLES + 1)]


MASKS = covering_masks(list(range(64)))
#: For table t, the keys of the second covering: the bits of t and half of the others.
FINER = [[m | x for x in covering_masks([b for b in range(64) if not m >> b & 1])] for m in MASKS]


def _lit(mask: int):
    return F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) within runs of equal (t, k); the rows come sorted by them."""

    def flush(t, k, fp, last):
        new = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
        cuts = np.concatenate([[0], new, [len(t)]]) if last else np.concatenate([[0], new])
        sizes, edges = np.diff(cuts), []
        two = cuts[:-1][sizes == 2]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS
        edges.append(np.stack([fp[two[near]], fp[two[near] + 1]], 1))
        for i in np.flatnonzero(sizes > 2):
            edges.append(_forest(fp[cuts[i] : cuts[i + 1]]))
        return np.concatenate(edges).view(np.int64), cuts[-1]

    held = None
    for batch in batches:
        now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        if len(held[0]) > 1:
            edges, done = flush(*held, last=False)
            held = [x[done:] for x in held]
            if len(edges):
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])
    if held is not None and len(held[0]) > 1:
        edges, _ = flush(*held, last=True)
        if len(edges):
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])


def _forest(fp: np.ndarray) -> np.ndarray:
    """An edge from each fingerprint to the first of its component within the radius."""
    rest, edges = np.unique(fp), []
    while len(rest) > 1:
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for i in range(0, len(front), 256):
                far = np.flatnonzero(~near)
                near[far] = (np.bitwise_count(front[i : i + 256, None] ^ rest[far][None, :]) <= RADIUS).any(0)
            front, rest = rest[near], rest[~near]
            edges.append(np.stack([np.full(len(front), root, np.uint64), front], 1))
    return np.concatenate(edges) if edges else np.empty((0, 2), np.uint64)


def _edges(keyed: DataFrame) -> DataFrame:
    return keyed.repartition("t", "k").sortWithinPartitions("t", "k").mapInArrow(_bucket_edges, "a long, b long")


def links(classes: DataFrame, direct: int = 4096) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that join all those within the radius."""
    keys = classes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(_lit(m)) for m in MASKS])).alias("t", "k"))
    shared = materialize(keys.groupBy("t", "k").count().where("count > 1"), "buckets")
    light, heavy = (shared.where(f"count {op} {direct}").select("t", "k") for op in ("<=", ">"))
    edges = _edges(keys.join(light, ["t", "k"]).select("t", "k", "fp"))
    if heavy.isEmpty():
        return edges
    table = F.array(*[F.array(*[_lit(m) for m in row]) for row in FINER])
    finer = keys.join(heavy, ["t", "k"]).select("fp", "t", F.posexplode(table[F.col("t")]).alias("v", "mask"))
    finer = finer.select((F.col("t") * TABLES + F.col("v")).alias("t"), F.col("fp").bitwiseAND(F.col("mask")).alias("k"), "fp")
    return edges.unionByName(_edges(finer))


def near_duplicates(docs: DataFrame, direct: int = 4096) -> DataFrame:
    """(doc_id, row, fp, root, component_id) for each row: the smallest doc_id reachable by links of at most 3 bits.

    ``root`` is the component's smallest fingerprint, as a signed number.
    """
    found = materialize(fingerprints(docs), "fingerprints")
    classes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = connected_components(links(classes, direct)).withColumnRenamed("node", "fp")
    linked = materialize(roots.join(classes, "fp"), "linked")
    firsts = materialize(linked.groupBy("root").agg(F.min("first").alias("component_id")), "firsts")
    named = linked.join(firsts, "root").select("fp", "root", "component_id")
    labels = classes.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id"))
    return found.join(materialize(labels, "components"), "fp").select("doc_id", "row", "fp", "root", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of its smallest doc_id (of those, of the smallest row key)."""
    return keep_first(docs, near_duplicates(docs))


def keep_first(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with one row of each ``root`` of ``labels`` (row, root, doc_id)."""
    labels = materialize(labels.select("row", "root", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id")), "labels")
    kept = materialize(labels.groupBy("root").agg(F.min(F.struct("id", "row"))["row"].alias("kept")), "kept")
    dropped = labels.join(kept, "root").where("row <> kept").select("row").distinct()
    out = drop_rows(docs, dropped)
    # equal rows have one key, so some stay together
    tied = materialize(labels.join(kept, "root").where("row = kept").groupBy("row").count().where("count > 1").select("row"), "tied")
    ties = tied.count()
    if not ties:
        return out
    if ties <= BROADCAST_KEYS:
        rest, again = keyed(out).join(F.broadcast(tied), "row", "left_anti"), keyed(out).join(F.broadcast(tied), "row", "left_semi")
    else:
        rest, again = split_rows(keyed(out), "row", tied)
    return unkeyed(rest.select("doc").unionByName(again.groupBy("row").agg(F.first("doc").alias("doc")).select("doc")), out.columns)
