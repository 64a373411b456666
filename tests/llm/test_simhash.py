import random
import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from kinograph.llm.components import connected_components
from kinograph.llm.simhash import MASKS, fingerprint, keep_one, near_duplicates


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprint_is_the_plain_one():
    rng = random.Random(1)
    texts = ["", None, " \t\n", "One", "one two", "É ß x Y\x1cz", "a b c"] + [" ".join(rng.choice("aA bß ü c\n".split(" ")) for _ in range(rng.randint(1, 300))) for _ in range(50)]
    texts.append(" ".join(f"w{rng.randint(0, 5000)}" for _ in range(40_000)))
    for t in texts:
        assert fingerprint(t.encode() if t is not None else None) == plain(t)


def test_every_close_pair_shares_a_key():
    for n in (1, 2, 3):
        for bits in combinations(range(64), n):
            diff = sum(1 << b for b in bits)
            assert any(not m & diff for m in MASKS)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 200))) for _ in range(60)]
    texts = list(base)
    for t in base[:30]:
        w = t.split()
        for _ in range(8):
            w = list(w)
            w[rng.randrange(len(w))] = "x"
            texts.append(" ".join(w))
    rows = [(i, t, "noise") for i, t in enumerate(texts)] + [(7, base[7], "again"), (500, None, ""), (501, "", ""), (502, " ", ""), (None, base[3], "")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    for direct in (4096, 2):
        got = near_duplicates(df, direct).collect()
        assert len(got) == len(rows)
        ids = [r[0] for r in rows if r[0] is not None]
        f = {r[0]: plain(r[1]) for r in rows}
        want = components(set(ids), [(a, b) for a, b in combinations(sorted(set(ids)), 2) if (f[a] ^ f[b]).bit_count() <= 3])
        for r in got:
            assert r.fp % (1 << 64) == f[r.doc_id]
            assert r.component_id == (want[r.doc_id] if r.doc_id is not None else want[3])
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    rng = np.random.default_rng(3)
    chain = rng.permutation(400)
    edges = [(int(a), int(b)) for a, b in zip(chain, chain[1:])] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (7, 6), (6, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: 0 for n in range(400)} | {n: 1000 for n in range(1000, 1100)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert connected_components(spark.range(1).select(F.lit(None).cast("long").alias("a"), F.col("id").alias("b"))).count() == 0


def test_one_of_each_component_stays(spark):
    rows = [(5, "a b c d e", 1), (2, "A b  c d e", 2), (9, "other words than these", 3), (9, "other words than these", 3), (None, None, 4), (7, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long")
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [(2, "A b  c d e", 2), (7, "", 5), (9, "other words than these", 3)]
    assert keep_one(df.limit(0)).count() == 0
