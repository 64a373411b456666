import glob
import random
import re

import pyarrow.parquet as pq
from kinograph.llm.decontaminate import build_index, find_contamination, hit_words
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def plain(docs, items, size):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for win, owners in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids |= owners
        out.append((d, len(w), len(hit), sorted(x for x in ids if x is not None)))
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, matches string")
    i = spark.createDataFrame(items, "item_id long, text string")
    out = find_contamination(d, i, **options).select("doc_id", "n_words", hit_words(F.col("matches")), F.array_distinct(F.transform(F.filter("matches", lambda m: m["exact"] & m["item_id"].isNotNull()), lambda m: m["item_id"])), "matches")
    return out.collect()


def case(seed):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice("a B, ß c. d9 the".split()) for _ in range(n))
    items = [(i, say(rng.randint(1, 12))) for i in range(12)] + [(50, ""), (51, None), (None, say(4)), (3, say(5)), (52, "a b"), (53, "x")]
    docs = [(i, say(rng.randint(0, 80)) + " " + (rng.choice(items)[1] or "")) for i in range(60)] + [(100, None), (101, ""), (102, "..."), (None, items[0][1]), (5, "a b"), (5, "a b")]
    return docs, items


def test_matches_brute_force(spark, monkeypatch):
    for seed, size, chars in ((1, 4, 1 << 25), (2, 10, 1 << 25), (3, 3, 40)):
        monkeypatch.setattr("kinograph.llm.decontaminate.BLOCK_CHARS", chars)
        docs, items = case(seed)
        got = sorted(((r[0], r[1], r[2], sorted(r[3])) for r in run(spark, docs, items, size=size)), key=str)
        assert got == plain(docs, items, size)


def test_proximity(spark):
    docs = [(1, "one two x three four"), (2, "four one two three"), (3, "one two three four"), (4, "one two"), (5, "three four")]
    got = {r[0]: [(m.item_id, m.begin, m.end, m.exact) for m in r[4]] for r in run(spark, docs, [(7, "one two three four")], size=4, slop=1)}
    assert got[3] == [(7, 0, 4, True)] and got[4] == got[5] == []
    assert got[1] and not any(m[3] for m in got[1])
    assert got[2] == []


def near_plain(docs, items, size, slop):
    """(doc, item) pairs with an exact match, and those with a near one, by trying every begin."""
    exact, near = set(), set()
    for d, t in docs:
        w = words(t)
        for i, x in items:
            iw = words(x)
            for k in range(max(1, len(iw) - size + 1) if iw else 0):
                win = iw[k : k + size]
                for c in range(-slop, len(w) + slop):
                    if all(any(0 <= c + p + e < len(w) and w[c + p + e] == x for e in range(-slop, slop + 1)) for p, x in enumerate(win)):
                        near.add((d, i))
                        if all(0 <= c + p < len(w) and w[c + p] == x for p, x in enumerate(win)):
                            exact.add((d, i))
    return exact, near


def test_proximity_matches_brute_force(spark, monkeypatch):
    """Many short documents side by side in one segment."""
    for seed, size, slop, chars in ((5, 4, 1, 1 << 25), (6, 6, 2, 1 << 25), (7, 3, 2, 60)):
        monkeypatch.setattr("kinograph.llm.decontaminate.BLOCK_CHARS", chars)
        rng = random.Random(seed)
        say = lambda n: " ".join(rng.choice("a b c d e f g".split()) for _ in range(n))  # noqa: E731, B023
        items = [(i, say(rng.randint(1, 9))) for i in range(10)]
        docs = [(i, say(rng.randint(0, 9))) for i in range(150)]
        got = [(r[0], m) for r in run(spark, docs, items, size=size, slop=slop) for m in r[4]]
        exact, near = near_plain(docs, items, size, slop)
        assert {(d, m.item_id) for d, m in got if m.exact} == exact
        assert {(d, m.item_id) for d, m in got} == near and len(near) > len(exact) > 0
        length = {d: len(words(t)) for d, t in docs}
        assert all(0 <= m.begin < m.end <= length[d] for d, m in got)


def test_a_near_match_before_its_document_is_its_own(spark):
    docs = [(1, "alpha beta"), (2, "k0 k1 k2 extra k3 k4 k5 k6 k7 k8 k9"), (3, "k1 k2")]
    got = {r[0]: [(m.item_id, m.exact) for m in r[4]] for r in run(spark, docs, [(7, "k0 k1 k2 k3 k4 k5 k6 k7 k8 k9")], slop=2)}
    assert got == {1: [], 2: [(7, False)], 3: []}
    long = " ".join(f"w{i}" for i in range(120_000))
    got = {r[0]: r[2] for r in run(spark, [(1, long), (2, long + " tail"), (3, None)], [(1, " ".join(f"w{i}" for i in range(100_000, 100_030)))], slop=2)}
    assert got == {1: 30, 2: 30, 3: 0}


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert [r[2] for r in run(spark, [(1, "a")], [])] == [0]


def test_memory_of_the_index_does_not_grow_with_a_task(spark):
    text = "concat_ws(' ', transform(sequence(1, 100000), x -> hex(hash(id, x))))"
    docs = spark.range(0, 20, 1, 1).selectExpr("id AS doc_id", f"{text} AS text")  # 18 MB of text in one task
    index = build_index(docs)
    assert not [f.name for f in index.schema if isinstance(f.dataType, ArrayType)]  # Spark's reader holds levels of all elements of a file's arrays
    (file,) = glob.glob(f"{index.scratch.removeprefix('file://')}/*.parquet")
    told = pq.ParquetFile(file).metadata
    sizes = [told.row_group(k).total_byte_size for k in range(told.num_row_groups)]
    assert told.num_rows >= 4 and max(sizes) < 24 << 20 and len(sizes) >= told.num_rows // 2
