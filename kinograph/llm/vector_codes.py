"""Vector codes by product quantization in whole numbers.

Every component x becomes floor(scale * x); a vector is cut into equal consecutive parts, and each part is
told by the number of its codebook's nearest entry. The vectors are held as columnar NumPy part blocks (a row
for each dimension), written once in the narrowest integers that hold them. A round of training is one
``treeAggregate`` over the blocks: distances accumulate dimension by dimension, ``np.add.at`` adds parts to
int64 tensors of sums and counts, and the tensors, whose size does not depend on the input, merge through a reduction tree.
Whole numbers make the result the same under any order of merging, partitioning and retry.

Defined results: rows whose vector is null or holds a null or non-finite component are left out; vectors of another length form a
code of their own, with codebooks of their own; where a length is not a multiple of the parts, parts k begin at floor(k * length / parts);
an empty vector has empty parts, code 0 and error 0; the codebooks begin with the smallest ids, nulls last, equal ids by their
components; repeated rows count each; components beyond 2^27 in size are worked on as Python's integers, so that nothing overflows, and an
error beyond a long is the largest long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.llm.common import map_arrow, materialize

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors whose distances are worked out together.
STRIDE = 512
#: Size of components up to which int64 distances and sums (of 2^35 parts) are exact.
_SMALL = 1 << 27
_LONG = (1 << 63) - 1
_BLOCK = "dim int, n int, kind string, data binary, vec_id array<long>, label array<string>"


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), in the narrowest integers that hold all."""
    scaled = x.astype(np.float64) * scale
    most = np.abs(scaled).max(initial=0)
    if most > _SMALL or not np.isfinite(most):
        return np.array([int(v) * scale if v == int(v) else int(np.floor(v * scale)) for v in x.astype(np.float64).ravel().tolist()], object).reshape(x.shape)
    floored = np.floor(scaled).astype(np.int64)
    return floored.astype(np.int16 if most < 1 << 14 else np.int32)


def _pack(parts: np.ndarray) -> tuple[str, bytes]:
    return ("object", ",".join(map(str, parts.ravel())).encode()) if parts.dtype == object else (parts.dtype.str, parts.tobytes())


def _unpack(kind: str, data: bytes, dim: int, n: int) -> np.ndarray:
    """(dim, n) integers of a block."""
    if kind == "object":
        return np.array([int(v) for v in bytes(data).split(b",") if v], object).reshape(dim, n)
    return np.frombuffer(data, np.dtype(kind)).reshape(dim, n)


def _blocks(scale: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes).tolist():
                rows = batch.filter(pa.array(sizes == dim))
                x = rows.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, dim)
                columns = np.ascontiguousarray(whole_numbers(x, scale).T)
                kind, data = _pack(columns)
                lists = [pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(c)) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([rows.num_rows], pa.int32()), pa.array([kind]), pa.array([data], pa.binary()), *lists], ["dim", "n", "kind", "data", "vec_id", "label"])

    return blocks


def cuts(dim: int, parts: int) -> list[int]:
    return [k * dim // parts for k in range(parts + 1)]


def assign(columns: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry, the lowest of equals, and squared distance of each part; ``columns`` (size, n), ``book`` (entries, size)."""
    size, n = columns.shape
    most = max((int(np.abs(a).max()) for a in (columns, book) if a.size), default=0)
    kind = object if object in (columns.dtype, book.dtype) else np.int32 if size * (2 * most) ** 2 < 1 << 31 else np.int64
    book = book.astype(kind)
    near, far = np.zeros(n, np.int64), np.zeros(n, kind)
    for i in range(0, n, STRIDE):
        some = columns[:, i : i + STRIDE].astype(kind)
        sums = np.zeros((some.shape[1], len(book)), kind)
        step = np.empty_like(sums)
        for d in range(size):
            np.subtract(some[d][:, None], book[:, d][None, :], out=step)
            np.multiply(step, step, out=step)
            np.add(sums, step, out=sums)
        best = sums.argmin(axis=1)
        near[i : i + STRIDE], far[i : i + STRIDE] = best, sums[np.arange(len(best)), best]
    return near, far.astype(object if kind is object else np.int64)


def _first(state: dict, block, entries: int) -> dict:
    """The ``entries`` smallest (id, vector) of each length so far."""
    columns = _unpack(block.kind, block.data, block.dim, block.n)
    order = sorted(range(block.n), key=lambda i: (block.vec_id[i] is None, block.vec_id[i] or 0))
    last = order[min(entries, block.n) - 1]
    bound = (block.vec_id[last] is None, block.vec_id[last] or 0)
    own = [((v is None, v or 0), tuple(columns[:, i].tolist())) for i, v in enumerate(block.vec_id) if (v is None, v or 0) <= bound]
    return _smallest(state, {block.dim: own}, entries)


def _smallest(a: dict, b: dict, entries: int) -> dict:
    return {dim: heapq.nsmallest(entries, [*a.get(dim, ()), *b.get(dim, ())]) for dim in a.keys() | b.keys()}


def _exact(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``sums``, as Python's integers once so many parts are in them that int64 might not hold them."""
    return sums.astype(object) if sums.dtype != object and counts.max(initial=0) > 1 << 35 else sums


def _train(state: dict, block, books: dict, parts: int) -> dict:
    columns, at = _unpack(block.kind, block.data, block.dim, block.n), cuts(block.dim, parts)
    if block.dim not in state:
        state[block.dim] = [[np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)] for book in books[block.dim]]
    for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        near, _ = assign(columns[a:b], books[block.dim][k])
        sums, counts = state[block.dim][k]
        if columns.dtype == object and sums.dtype != object:
            sums = sums.astype(object)
        np.add.at(sums, near, columns[a:b].T if columns.dtype == object else columns[a:b].T.astype(np.int64))
        np.add.at(counts, near, 1)
        state[block.dim][k] = [_exact(sums, counts), counts]
    return state


def _merge(a: dict, b: dict) -> dict:
    for dim, theirs in b.items():
        mine = a.get(dim)
        a[dim] = theirs if mine is None else [[_exact(s + t, m + n), m + n] for (s, m), (t, n) in zip(mine, theirs, strict=True)]
    return a


def _replaced(book: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    used = counts > 0
    out = book.astype(object) if sums.dtype == object else book.copy()
    divisor = counts[used][:, None].astype(sums.dtype)
    out[used] = sums[used] // divisor
    return out


def train(blocks: DataFrame, parts: int, entries: int, rounds: int) -> dict:
    """Codebooks by length: for each, an (entries, size) array for each part."""
    rows = blocks.select("dim", "n", "kind", "data", "vec_id").rdd
    first = rows.treeAggregate({}, lambda s, b: _first(s, b, entries), lambda a, b: _smallest(a, b, entries))
    books = {}
    for dim, own in first.items():
        big = any(abs(x) > _SMALL for _, v in own for x in v)
        vectors = np.array([v for _, v in own], object if big else np.int64).reshape(len(own), dim)
        at = cuts(dim, parts)
        books[dim] = [vectors[:, a:b].copy() for a, b in zip(at[:-1], at[1:], strict=True)]
    rows = blocks.select("dim", "n", "kind", "data").rdd
    for _ in range(rounds if books else 0):
        told = rows.context.broadcast(books)
        found = rows.treeAggregate({}, lambda s, b: _train(s, b, told.value, parts), _merge)  # noqa: B023
        books = {dim: [_replaced(book, *found[dim][k]) for k, book in enumerate(own)] for dim, own in books.items()}
        told.unpersist()
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def _encode(books: dict, parts: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                dim, n = block["dim"], block["n"]
                columns, at = _unpack(block["kind"], block["data"], dim, n), cuts(dim, parts)
                near, far = zip(*(assign(columns[a:b], book) for a, b, book in zip(at[:-1], at[1:], books.value[dim], strict=True)), strict=True)
                codes = ["".join(f"{c:02x}" for c in own) for own in zip(*(c.tolist() for c in near), strict=True)]
                error = [min(sum(e), _LONG) for e in zip(*(e.tolist() for e in far), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block["vec_id"], pa.int64()), pa.array(block["label"], pa.string()), pa.array([dim] * n, pa.int32()), pa.array(codes), pa.array(error, pa.int64())], ["vec_id", "label", "dim", "code", "error"])

    return encode


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each row of ``vectors`` (vec_id, embedding, label) that has a whole vector.

    ``entries`` are at most 256, two hex digits each.
    """
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull()).where(finite)
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), F.size("embedding").alias("dim"), x.alias("vector"))
    blocks = materialize(map_arrow(rows, _blocks(scale), _BLOCK), "blocks")
    books = train(blocks, parts, entries, rounds)
    told = spark.sparkContext.broadcast(books)
    codes = materialize(map_arrow(blocks, _encode(told, parts), "vec_id long, label string, dim int, code string, error long"), "codes")
    totals = codes.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG)).cast("long").alias("label_error"))
    names = F.lit(None).cast("string")
    for dim, own in books.items():
        names = F.when(F.col("dim") == dim, digest(own)).otherwise(names)
    out = codes.join(totals, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", names.alias("codebooks_sha256"))
