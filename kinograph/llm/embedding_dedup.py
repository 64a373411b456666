"""Embedding near-dedup by spherical-cap filters with random product codes.

A filter is a direction put together from one code word per block of dimensions, and a vector is in
the filters whose caps it stands highest in. The cap's height is the vector's own, such that it is in
``aim_for(classes)`` filters: under one height for all, random product codes of few dimensions leave some vectors in
hundreds of filters and others in none. List decoding finds a vector's filters without looking at all:
of two lists of block products, best first, the i-th and the j-th can only be among the best sums where i * j is
at most their number. Vectors
meet in the filters they share, and a pair counts where its cosine, in double precision, reaches the
threshold, in the first of its common filters only; so no pair is counted twice and none is written
out. A pair that shares no filter is missed; how rarely, the tests measure at the threshold itself.

Equal directions are one class first, and of filters with the same members one is searched. A filter with more members than ``BLOCK`` is searched in
pairs of blocks, so a task's work is bounded and nothing is left out. The numbers of code words and of filters a
vector is in grow with the number of classes.

Defined results: a null, empty, zero or non-finite vector, or one with a null component, links with
nothing; vectors of different lengths do not link; repeated ids are a node each time they have
another vector and share their label; a null vec_id is a vector without an id of its own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.llm.common import map_arrow, materialize
from kinograph.llm.components import connected_components

THRESHOLD = 0.95
#: Filters that a vector is in among 100,000 classes or fewer, and members of a filter that one task compares.
AIM = 64
BLOCK = 2048
_SEED = 11


class Code:
    """A random product code for vectors of ``dim`` components: up to four blocks of ``words`` code words."""

    def __init__(self, dim: int, words: int):
        rng = np.random.default_rng([_SEED, dim, words])
        self.cuts = np.linspace(0, dim, min(4, dim) + 1).astype(int)
        self.books = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            book = rng.normal(size=(words, b - a)) if b - a > 1 else np.array([[1.0], [-1.0]])
            self.books.append(book / np.linalg.norm(book, axis=1, keepdims=True))

    def decode(self, x: np.ndarray, aim: int) -> np.ndarray:
        """For each row of ``x``, the sorted numbers of the ``aim`` filters highest along it (all, if there are fewer)."""
        ranked, size = [], [len(book) for book in self.books]
        for book, a, b in zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True):
            values = x[:, a:b] @ book.T
            order = np.argsort(-values, axis=1, kind="stable")[:, :aim]
            ranked.append((np.take_along_axis(values, order, 1), order))
        while len(ranked) > 1:  # blocks join in pairs, then the halves
            joined = [_best_sums(*ranked[k], *ranked[k + 1], size[k + 1], aim) for k in range(0, len(ranked) - 1, 2)]
            joined, widths = joined + ranked[len(joined) * 2 :], [size[k] * size[k + 1] for k in range(0, len(ranked) - 1, 2)]
            ranked, size = joined, widths + size[len(widths) * 2 :]
        return np.sort(ranked[0][1], axis=1)


@lru_cache(maxsize=64)
def _pairs(left: int, right: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks (from 0) in two lists, best first, whose sum can be among the ``n`` best sums."""
    i, j = (r.ravel() for r in np.meshgrid(np.arange(left), np.arange(right), indexing="ij"))
    can = (i + 1) * (j + 1) <= n
    return i[can], j[can]


def _best_sums(left, left_ids, right, right_ids, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    i, j = _pairs(left.shape[1], right.shape[1], n)
    values = left[:, i] + right[:, j]
    order = np.argsort(-values, axis=1, kind="stable")[:, :n]
    ids = np.take_along_axis(left_ids[:, i].astype(np.int64) * width + right_ids[:, j], order, 1)
    return np.take_along_axis(values, order, 1), ids


def aim_for(classes: int) -> int:
    """Filters that a vector is in: a quarter of ``AIM`` more for each power of ten beyond 100,000 classes."""
    return int(AIM * (1 + max(0.0, np.log10(max(classes, 1) / 1e5)) / 4))


def code_words(classes: int) -> int:
    """Code words per block: filters (their fourth power) grow with the number of classes."""
    return int(max(8, np.ceil((classes * AIM * 8.0) ** 0.25)))


@lru_cache(maxsize=8)
def code(dim: int, words: int) -> Code:
    """The code, kept in a worker between tasks."""
    return Code(dim, words)


_CLASSES = "vec_id long, class long, dim int"


def _unit(v) -> np.ndarray | None:
    """The direction of ``v`` in double precision; None where it has none."""
    x = np.array(v, np.float64) if v is not None and len(v) and None not in v else np.zeros(0)
    with np.errstate(over="ignore", invalid="ignore"):
        scale = np.abs(x).max() if len(x) else 0.0
        x = x / scale if scale > 0 and np.isfinite(scale) else x
        norm = np.sqrt((x * x).sum())
    return x / norm if len(x) and np.isfinite(norm) and norm > 0 else None


def _directions(column: pa.Array) -> np.ndarray:
    """The directions of vectors of one length, all of which have one."""
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = [_unit(v) for v in batch.column("embedding").to_pylist()]
        keys = [None if x is None else xxhash.xxh3_64_intdigest((x + 0.0).tobytes()) - (1 << 63) for x in units]
        dims = [None if x is None else len(x) for x in units]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.int64()), pa.array(dims, pa.int32()), batch.column("embedding")], ["vec_id", "class", "dim", "vector"])


def _filters(words: int, aim: int):
    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = whole.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                batch = whole.filter(pa.array(dims == dim))
                out = code(dim, words).decode(_directions(batch.column("vector")), aim)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("dim"), lists], ["class", "dim", "filters"])

    return filters


def _compare(threshold: float):
    """Per class of a cell: links to add (a row with links), and edges that join its neighbours (with other)."""

    def search(here, low, high, block, names, size, x, own):
        left = np.flatnonzero(block == low)
        right = left if low == high else np.flatnonzero(block == high)
        links, edges, bits = np.zeros(len(names), np.int64), [], None
        for k in range(0, len(left), 256):
            rows = left[k : k + 256]
            near = x[rows] @ x[right].T >= threshold
            if low == high:
                near &= right[None, :] > rows[:, None]
            a, b = np.nonzero(near)
            if len(a) and bits is None:
                bits = _earlier(here, own)
            for s in range(0, len(a), 1 << 16):
                i, j = rows[a[s : s + (1 << 16)]], right[b[s : s + (1 << 16)]]
                new = ~(bits[i] & bits[j]).any(1)
                i, j = i[new], j[new]
                np.add.at(links, i, size[j])
                np.add.at(links, j, size[i])
                edges.append(_forest(i, j))
        edges = np.concatenate([np.empty((0, 2), np.int64), *edges])
        edges = _forest(edges[:, 0], edges[:, 1])
        some = np.flatnonzero(links)
        return [(names[i], links[i], None) for i in some] + [(names[i], None, names[j]) for i, j in edges]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted by cell."""
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            if held is None or not held.num_rows:
                continue
            key = [held.column(c).to_numpy() for c in ("dim", "filter", "low", "high")]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            cuts = np.concatenate([[0], new, [held.num_rows]] if batch is None else [[0], new])
            rows, now = [], held.slice(0, cuts[-1]).combine_chunks()
            names, size, block = (now.column(c).to_numpy() for c in ("class", "n", "block"))
            dims, filters = key[0][: cuts[-1]], now.column("filters")
            for dim in np.unique(dims).tolist():  # sorted by it, so the cells of each stand together
                low, high = np.searchsorted(dims, (dim, dim + 1))
                vectors = now.column("vector")
                units = _directions((vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors)[low:high])
                begins = cuts[:-1][(cuts[:-1] >= low) & (cuts[:-1] < high)]
                sizes = np.append(begins[1:], high) - begins
                two = begins[sizes == 2] - low
                apart = set((two[np.einsum("ij,ij->i", units[two], units[two + 1]) < threshold] + low).tolist())
                for a, b in zip(begins.tolist(), (begins + sizes).tolist(), strict=True):
                    if b - a > 1 and a not in apart:
                        own = [filters[i].values.to_numpy() for i in range(a, b)]
                        rows += search(key[1][a], key[2][a], key[3][a], block[a:b], names[a:b], size[a:b], units[a - low : b - low], own)
            held = held.slice(cuts[-1])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["class", "links", "other"])

    return compare


def _with_end(batches):
    yield from batches
    yield None


def _earlier(here: int, own: list[np.ndarray]) -> np.ndarray:
    """For each member, bits of the filters before ``here`` that more than one member is in."""
    own = [f[f < here] for f in own]
    seen, counts = np.unique(np.concatenate(own), return_counts=True)
    seen = seen[counts > 1]
    bits = np.zeros((len(own), max(1, -(-len(seen) // 8))), np.uint8)
    for k, f in enumerate(own if len(seen) else ()):
        bits[k] = np.packbits(np.isin(seen, f, assume_unique=True))
    return bits


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the pairs, those that join what earlier ones have not: at most one per vector."""
    root: dict = {}

    def find(v):
        while root.setdefault(v, v) != v:
            root[v] = v = root[root[v]]
        return v

    kept = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        i, j, pair = find(i), find(j), (i, j)
        if i != j:
            root[max(i, j)] = min(i, j)
            kept.append(pair)
    return np.array(kept, np.int64).reshape(-1, 2)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, aim: int | None = None, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id) for each row of ``vectors`` (vec_id, embedding)."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    given = f"array<{kind if kind in ('float', 'double') else 'double'}>"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(given))
    rows = materialize(map_arrow(rows, _units, f"{_CLASSES}, vector {given}"), "units")
    live = rows.where("class IS NOT NULL")
    classes = materialize(live.groupBy("class").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.min("dim").alias("dim"), F.first("vector").alias("vector")), "classes")
    many = classes.count()
    entered = map_arrow(classes.select("class", "dim", "vector"), _filters(code_words(many), aim or aim_for(many)), "class long, dim int, filters array<long>")
    entered = materialize(entered, "entered").select("class", "dim", F.explode("filters").alias("filter"))
    members = [F.bit_xor(F.xxhash64("class", F.lit(k))).alias(f"members{k}") for k in (0, 1)]
    sizes = entered.groupBy("dim", "filter").agg(F.count("*").alias("size"), *members).where("size > 1")
    # of filters with the same members the first is enough
    sizes = sizes.groupBy("dim", "size", "members0", "members1").agg(F.min("filter").alias("filter")).select("dim", "filter", "size")
    sizes = materialize(sizes.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")), "filters")
    shared = entered.join(sizes, ["dim", "filter"]).groupBy("class").agg(F.collect_list(F.struct("filter", "blocks")).alias("shared"))
    met = classes.join(shared, "class").withColumn("filters", F.array_sort(F.transform("shared", lambda s: s["filter"])))
    cells = met.select("class", "n", "dim", "vector", "filters", F.explode("shared").alias("in"))
    cells = cells.select("*", F.col("in.filter").alias("filter"), F.pmod(F.xxhash64("class"), F.col("in.blocks").cast("long")).cast("int").alias("block"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("in.blocks") - 1)))
    cells = cells.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("in", "other")
    cell = ["dim", "filter", "low", "high"]
    found = map_arrow(cells.repartition(*cell).sortWithinPartitions(*cell), _compare(threshold), "class long, links long, other long")
    found = materialize(found, "found")
    degree = found.where("links IS NOT NULL").groupBy("class").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("other IS NOT NULL").select(F.col("class").alias("a"), F.col("other").alias("b")))
    named = materialize(roots.withColumnRenamed("node", "class").join(classes.select("class", "least"), "class"), "named")
    firsts = materialize(named.groupBy("root").agg(F.min("least").alias("component_id")), "firsts")
    linked = named.join(firsts, "root").select("class", "component_id")
    labels = classes.join(degree, "class", "left").join(linked, "class", "left")
    labels = materialize(labels.select("class", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "labels")
    out = rows.select("vec_id", "class").join(labels, "class", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
