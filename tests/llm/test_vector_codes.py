import hashlib
import math
import random
from collections import Counter

import numpy as np

from kinograph.llm.vector_codes import assign, compress, whole_numbers

SCHEMA = "vec_id long, embedding array<double>, label int, dim int, code string, of string, data string"


def plain(rows, parts, entries, rounds, scale=1024):
    """Codes by loops over Python's integers; (vec_id, code, error, label_error, digest) of each row."""
    kept = [(i, [math.floor(int(x) * scale if x == int(x) else x * scale) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    errors, out = Counter(), []
    for dim in {len(v) for _, v, _ in kept}:
        own = sorted([r for r in kept if len(r[1]) == dim], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        at = [k * dim // parts for k in range(parts + 1)]
        cut = [[v[a:b] for a, b in zip(at[:-1], at[1:], strict=True)] for _, v, _ in own]
        books = [[c[k] for c in cut[:entries]] for k in range(parts)]

        def nearest(p, book):
            return min((sum((x - y) ** 2 for x, y in zip(p, e, strict=True)), k) for k, e in enumerate(book))

        for _ in range(rounds):
            for k, book in enumerate(books):
                near = [nearest(c[k], book)[1] for c in cut]
                groups = {j: [c[k] for c, n in zip(cut, near, strict=True) if n == j] for j in set(near)}
                books[k] = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else e for j, e in enumerate(book)]
        name = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
        for (i, _, lab), c in zip(own, cut, strict=True):
            best = [nearest(p, book) for p, book in zip(c, books, strict=True)]
            error = sum(d for d, _ in best)
            errors[lab] += error
            out.append((i, "".join(f"{j:02x}" for _, j in best), min(error, 2**63 - 1), lab, name))
    return Counter((i, c, e, min(errors[lab], 2**63 - 1), n) for i, c, e, lab, n in out)


def got(spark, rows, *args):
    df = spark.createDataFrame([(*r, 7, "x", "y", "z") for r in rows], SCHEMA)
    return Counter(tuple(r) for r in compress(df, *args).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_against_loops(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], rng.choice([1, 2, None])) for i in range(300)]
    rows += [(1000 + i, rows[i % 5][1], 1) for i in range(100)]  # copies
    rng.shuffle(rows)
    for parts, entries, rounds in ((4, 16, 4), (2, 256, 1), (4, 256, 4)):
        assert got(spark, rows, parts, entries, rounds) == plain(rows, parts, entries, rounds)


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, [1.0, None, 2.0, 3.0], 1), (3, [1.0, float("nan"), 2.0, 3.0], 1), (4, [float("inf"), 0.0, 0.0, 0.0], 2), (5, [], None)]
    rows += [(None, [0.25, -0.3, 0.0, 1.0], None), (7, [0.25, -0.3, 0.0, 1.0], None), (7, [0.1, -0.3, 0.0, 1.0], 3), (7, [0.1, -0.3, 0.0, 1.0], 3)]
    rows += [(8, [1e300, -1e300, 0.5, 1e-300], 4), (9, [2.0**18, -(2.0**20), 0.1, 0.2], 4), (10, [1.0, 2.0, 3.0], 5), (11, [-0.0005, 2.5, 3.0], 5)]
    want = plain(rows, 4, 2, 3)
    assert got(spark, rows, 4, 2, 3) == want and sum(want.values()) == 9
    assert compress(spark.createDataFrame([], SCHEMA)).count() == 0
    assert compress(spark.createDataFrame([(*rows[0], 7, "x", "y", "z")], SCHEMA)).count() == 0


def test_partitions_change_nothing(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, [rng.uniform(-1, 1) for _ in range(8)], i % 3) for i in range(500)], "vec_id long, embedding array<float>, label int")
    a, b = (Counter(map(tuple, compress(df.repartition(n), 4, 32).collect())) for n in (1, 13))
    assert a == b


def test_whole_numbers_and_ties():
    assert whole_numbers(np.array([[-0.0001, 0.5, 1e20]]), 1024).tolist() == [[-1, 512, int(1e20) * 1024]]
    assert whole_numbers(np.array([[3.0]], np.float32), 1024).dtype == np.int16 and whole_numbers(np.array([[300.0]]), 1024).dtype == np.int32
    near, far = assign(np.array([[0, 5, 100_000]]), np.array([[-1], [1], [1], [9]]))
    assert near.tolist() == [0, 1, 3] and far.tolist() == [1, 16, 99_991**2]
