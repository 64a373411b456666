import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from kinograph.llm import conversation_trie
from kinograph.llm.conversation_trie import RESULT, cartesian, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, pos long, g string, depth string"


def plain(rows, family=20, head=4):
    """The trie by dictionaries of whole prefixes."""
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    own = {c: [t[2] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % head
        rebuilt[c] = tuple(own.get(c - c % family, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children, saved, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for p, own in members.items():
        if p:
            children[p[:-1]] += 1
    words = lambda p: len(p[-1][1].encode().split()) if p else 0
    for p, own in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(own) - 1) * words(p)
            leaves[p[:d]] += not children[p]
    out = []
    for p, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if rebuilt[c] == p)))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, n=3, **args):
    df = spark.createDataFrame([(*r, 1, "g", "d") for r in rows], SCHEMA).repartition(n)
    out = prefix_trie(df, **args)
    assert [f"{c} {t}" for c, t in out.dtypes] == [x.replace("long", "bigint") for x in RESULT.split(", ")]
    return sorted(map(tuple, out.collect()), key=str)


def some(seed, convs, texts, longest):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice("ab"), " ".join("w" * rng.randint(0, 2) for _ in range(rng.randint(0, texts)))) for c in range(convs) for t in range(rng.randint(1, longest))]
    return rows


@pytest.mark.parametrize(("block", "shape"), [(1, (1, 150, 1, 6)), (3, (3, 120, 0, 9)), (50, (2, 160, 4, 5)), (100_000, (4, 150, 1, 6))])
def test_against_dictionaries(spark, block, shape):
    rows = some(*shape)
    assert got(spark, rows, block=block) == plain(rows)


def test_one_beginning_many_copies_and_other_families(spark):
    rows = [(c, t, "user", "same start" if t == 0 else f"x{c % 7} {t}") for c in range(90) for t in range(4)]
    rows += [(1000 + c, t, "u", f"copy {t}") for c in range(200) for t in range(3)]
    assert got(spark, rows, family=1, head=1, block=9) == plain(rows, 1, 1)
    assert got(spark, rows, family=7, head=3, block=40) == plain(rows, 7, 3)


def test_odd_rows(spark):
    rows = [(21, 0, "a", "x"), (21, 0, "a", "x"), (21, None, None, "first"), (22, 0, "a", None), (23, 0, None, None), (24, None, None, ""), (40, 1, "a", "word " * 40_000), (41, 1, "a", "word " * 40_000)]
    rows += [(None, 0, "a", "x"), (-1, 0, "a", "b"), (-45, 3, "é ", "　 \x0b one\x00two")]
    kept = [r for r in rows if r[0] is None or r[0] >= 0]
    assert got(spark, kept) == plain(kept)
    assert len(got(spark, rows)) == len({*got(spark, rows)})
    assert got(spark, rows[:1]) == plain(rows[:1])
    assert got(spark, [(None, 0, "a", "x")]) == [] == got(spark, [(None, 0, "a", "x")][:0] or [(None, 1, "b", "y")])
    # a conversation that becomes turnless is a member of the root alone
    bare = [(c, 0, "a", "x") for c in range(61, 70)]
    assert got(spark, bare) == plain(bare) and any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in plain(bare))


def test_ids_are_joined_in_several_strings(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "IDS", 7)
    rows = [(c, 0, "a", "x") for c in range(300)]
    assert got(spark, rows, family=1, head=1) == plain(rows, 1, 1)


def test_stack():
    nodes, of, rising = cartesian([-1, 2, 1, 1, 3, 0], [5, 4, 3, 2, 1, 0], 0)
    assert nodes == [[2, 0, 2, 1, 4], [1, 0, 5, 2, 1], [3, 3, 5, 1, 1], [0, 0, None, 1, 0]]
    assert of == [None, 0, 1, 1, 2, 3] and rising == [(-1, 0), (0, 5)]
