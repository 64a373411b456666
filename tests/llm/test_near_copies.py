import random

import corpus_pipeline
from kinograph.llm import near_copies as module
from kinograph.llm.near_copies import keep_one, near_copies
from tests_llm_common import components

SCHEMA = "doc_id long, text string, lang string, root string"


def similarity(a, b):
    one, two = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a.lower().split(), b.lower().split()))
    return len(one & two) / max(1, len(one | two)) if one | two else 1.0


def changed(rng, text, times):
    w = text.split()
    for at in rng.sample(range(len(w)), times):
        w[at] = f"x{rng.randint(0, 9)}"
    return " ".join(w)


def test_near_copies_match_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    texts = [say(rng.randint(1, 150)) for _ in range(40)]
    texts += [changed(rng, t, k) for t in texts[:20] for k in (1, 2, 4) if len(t.split()) > k]
    base = say(120)
    texts += [changed(rng, base, rng.randint(1, 6)) for _ in range(40)]
    texts += [texts[0].upper().replace(" ", "\n "), "", " ", "a b", "A  b"]
    rows = list(enumerate(texts))
    links = [(a, b) for a, x in rows for b, y in rows[a + 1 :] if similarity(x, y) >= 0.8]
    want = components(range(len(rows)), links)
    df = spark.createDataFrame([(i, t, "en", "z") for i, t in rows], SCHEMA)
    for direct, block in ((16, 512), (2, 512), (2, 5)):
        monkeypatch.setattr("kinograph.llm.near_copies.BLOCK", block)
        got = {r.doc_id: r.root for r in near_copies(df, direct).collect()}
        assert len(set(got.values())) == len(set(want.values()))
        assert len({(got[i], want[i]) for i in want}) == len(set(want.values()))
    odd = df.unionByName(spark.createDataFrame([(None, texts[25], "en", "z"), (None, None, "en", "z"), (3, texts[3], "fr", "z")], SCHEMA))
    kept = keep_one(odd).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values())) and keep_one(df.limit(0)).count() == 0


def test_pipeline_drops_copies_with_a_word_changed(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(60)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, changed(rng, t, 1)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for _, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, None).cache()
    ids = sorted(r.doc_id for r in docs.collect())
    assert ids == [i for i, t in enumerate(texts)]


def test_what_simhash_joins_is_not_searched_again(spark, monkeypatch):
    rng, seen = random.Random(6), {}

    def kept(df, label, plain=module.materialize):
        seen[label] = plain(df, label)
        return seen[label]

    monkeypatch.setattr(module, "materialize", kept)
    base = " ".join(f"w{rng.randint(0, 9999)}" for _ in range(4000))
    rows = [(i, f"{base} tail{i}") for i in range(8)] + [(10 + i, " ".join(f"v{rng.randint(0, 9999)}" for _ in range(30))) for i in range(8)]
    docs = spark.createDataFrame([*rows, (20, rows[9][1] + " end")], "doc_id long, text string")
    got = []
    for direct in (16, 2):
        roots = {r.doc_id: r.root for r in near_copies(docs, direct).collect()}
        assert len({roots[i] for i in range(8)}) == 1 and len(set(roots.values())) == 9
        got.append(seen["pairs"].count())
    monkeypatch.setattr(module, "_close", lambda signatures: spark.range(0).selectExpr("id AS a", "id AS b"))
    for direct, n in zip((16, 2), got, strict=True):
        roots = {r.doc_id: r.root for r in near_copies(docs, direct).collect()}
        assert len({roots[i] for i in range(8)}) == 1 and len(set(roots.values())) == 9
        assert n <= 1 < seen["pairs"].count()
