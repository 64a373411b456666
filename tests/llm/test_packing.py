import random
from collections import Counter, defaultdict

from kinograph.llm import packing
from tests_llm_common import components
from kinograph.llm.packing import fingerprint, pack, pack_documents
from kinograph.llm.token_counts import Counter as Tokens
from kinograph.llm.token_counts import load_vocabulary


def plain(items, capacity):
    """Best fit, by looking at every bin."""
    bins, out = [], {}
    rests = [(n % capacity, i, s, c) for i, (n, s, c) in enumerate(items) if n % capacity]
    for n, i, s, c in sorted(rests, key=lambda x: (-x[0], x[1])):
        fits = [b for b in bins if b["left"] >= n and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
        best = min(fits, key=lambda b: b["left"], default=None)
        if best is None:
            best = {"left": capacity, "s": set(), "c": set(), "i": []}
            bins.append(best)
        best["left"] -= n
        best["s"].add(s)
        best["c"].add(c)
        best["i"].append(i)
    for b in bins:
        for i in b["i"]:
            out[i] = b["left"]
    return out


def test_best_fit_under_conflicts():
    rng = random.Random(5)
    for _ in range(20):
        items = [(rng.randint(1, 150), rng.choice([None, "a", "b", "c", "d"]), rng.choice([None, *range(30)])) for _ in range(150)]
        got = pack(items, 64)
        used, sources, clusters, pieces = Counter(), defaultdict(list), defaultdict(list), defaultdict(list)
        for b, p, i, k, a, n in got:
            used[b] += n
            pieces[i].append((k, a, n))
            sources[b] += [items[i][1]] * (items[i][1] is not None)
            clusters[b] += [items[i][2]] * (items[i][2] is not None)
        assert max(used.values()) <= 64
        assert all(len(set(v)) == len(v) for v in [*sources.values(), *clusters.values()])
        for i, (n, *_) in enumerate(items):
            own = sorted(pieces[i])
            assert [k for k, *_ in own] == list(range(len(own))) and sum(x for *_, x in own) == n
            assert [a for _, a, _ in own] == [64 * k for k, *_ in own]
        want = plain(items, 64)
        left = {i: 64 - used[b] for b, p, i, k, a, n in got if n < 64 or i in want and k == items[i][0] // 64}
        assert sorted(left[i] for i in want) == sorted(want.values())


def test_documents(spark):
    v = load_vocabulary()
    t = Tokens(v)
    rng = random.Random(6)
    rows = [(i, " ".join("word" for _ in range(rng.randint(0, 40))), rng.choice(["s", "t", None]), "x") for i in range(200)]
    rows += [(1000, None, "s", "x"), (1001, "", "s", "x"), (None, "a", "s", "x"), (7, "same", "s", "x"), (7, "same", "s", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")
    got = pack_documents(df, v, 32, 50).collect()
    total = Counter()
    for r in got:
        total[r.doc_id] += r.tokens
    want = Counter()
    for i, x, *_ in rows:
        want[i] += t.texts([x])[0] + 1
    assert total == want
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
    assert all(sum(r.tokens for r in b) <= 32 and sorted(r.position for r in b) == list(range(len(b))) for b in bins.values())
    assert pack_documents(df.limit(0), v).count() == 0


def test_near_copies_never_share_a_bin(spark):
    v, rng = load_vocabulary(), random.Random(8)
    say = lambda n: " ".join(f"w{rng.randint(0, 999)}" for _ in range(n))
    long = say(400)
    rows = [(i, f"{long} tail{i}" if i < 12 else say(8), f"s{i}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    prints = {i: fingerprint(t.encode().split(), {}) for i, t, _ in rows}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    roots = components(prints, links)
    assert len({roots[i] for i in range(12)}) < 12 and len({roots[i] for i in range(12, 120)}) == 108
    bins = defaultdict(list)
    for r in pack_documents(df, v, 8000, 10_000).collect():
        bins[r.bin_id].append(roots[r.doc_id])
    assert all(len(set(b)) == len(b) for b in bins.values()) and max(map(len, bins.values())) > 20
    assert fingerprint([], {}) is None and fingerprint([b"a"], {}) != fingerprint([b"b"], {}) is not None


def test_copies_of_one_row_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "_COPIES", 7)
    df = spark.createDataFrame([(1, "a b", "s")] * 50 + [(2, "c", None)], "doc_id long, text string, source string")
    got = pack_documents(df, load_vocabulary(), 64, 8).collect()
    assert Counter(r.doc_id for r in got) == {1: 50, 2: 1} and len({r.bin_id for r in got if r.doc_id == 1}) == 50


def test_words_are_hashed_many_at_a_time(monkeypatch):
    texts = [b"a B\tc\x0bd\n e  f", None, b"", b" ", b"A  b C d", "\u00fc  zz".encode(), b"x" * 1000 + b" y", b"q"]
    words = [w for t in texts for w in (t or b"").lower().split()]
    one = [int(packing.word_hashes([w])[0][0]) for w in words]
    assert len(set(one)) == len(set(words))
    for block in (1, 7, 1 << 17):
        monkeypatch.setattr(packing, "_BLOCK", block)
        hashes, counts = packing.word_hashes([t or b"" for t in texts])
        assert hashes.tolist() == one and counts.tolist() == [len((t or b"").split()) for t in texts]
        assert packing.fingerprints(texts) == [fingerprint((t or b"").lower().split(), {}) for t in texts]
    assert packing.fingerprints([]) == [] and packing.word_hashes([b""])[1].tolist() == [0]
