import numpy as np

from kinograph.llm.embedding_dedup import Code, aim_for, code_words, near_duplicates
from tests_llm_common import components

SCHEMA = "vec_id long, embedding array<float>, n_links string"


def brute(rows):
    """(links by row number, component by vec_id) for usable rows."""
    use = [(k, i, np.array(v, float)) for k, (i, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links, pairs = {k: 0 for k in range(len(rows))}, []
    for dim in {len(v) for *_, v in use}:
        own = [u for u in use if len(u[2]) == dim]
        x = np.stack([v / np.linalg.norm(v) for *_, v in own])
        a, b = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
        for i, j in zip(a, b):
            links[own[i][0]] += 1
            links[own[j][0]] += 1
            pairs.append((own[i][0], own[j][0]))
    return links, pairs


def test_links_match_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 64))
    rows = [b for b in base]
    for b in base[:40]:
        rows += [b + rng.normal(size=64) * s for s in (0.05, 0.1, 0.2, 0.3, 0.33)]
    rows += [base[0] + rng.normal(size=64) * 0.15 for _ in range(120)] + [base[1]] * 7 + [base[2] * 3]
    rows = [[float(np.float32(c)) for c in r] for r in rows]
    rows += [[], None, [0.0] * 64, [None] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [1.0], [5.0], [-1.0]]
    table = list(enumerate(rows))
    want, pairs = brute(table)
    label = components(range(len(rows)), pairs)
    df = spark.createDataFrame([(i, v, "x") for i, v in table], SCHEMA)
    for block in (2048, 16):
        got = {r.vec_id: r for r in near_duplicates(df, block=block).collect()}
        assert len(got) == len(rows)
        assert all(got[k].n_links <= n for k, n in want.items())
        assert sum(r.n_links for r in got.values()) >= 0.98 * sum(want.values())
        assert sum(got[k].component_id == label[k] for k in label) >= 0.98 * len(label)
    assert near_duplicates(df.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    v = [1.0] * 8
    rows = [(None, v, ""), (3, v, ""), (3, v, ""), (None, [0.0], ""), (9, [1.0] * 7 + [-50.0], "")]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 2, 3), (3, 2, 3), (3, 2, 3), (None, 0, None), (9, 0, 9)], key=str)


def test_decoding_finds_the_highest_filters():
    for dim, words in ((16, 6), (14, 5), (3, 6), (2, 6), (1, 6)):
        code = Code(dim, words)
        some = np.random.default_rng(5).normal(size=(5, dim))
        for x, got in zip(some, code.decode(some, 20), strict=True):
            every = [(sum(book[k] @ x[a:b] for book, k, a, b in zip(code.books, place, code.cuts[:-1], code.cuts[1:])), place) for place in np.ndindex(*map(len, code.books))]
            best = sorted(every, key=lambda e: e[0])[-20:]
            assert got.tolist() == sorted(int(np.ravel_multi_index(place, [len(b) for b in code.books])) for _, place in best)


def test_recall_at_the_threshold_itself():
    """The share of pairs at cosine 0.95 exactly that have a filter in common, by number of classes."""
    rng = np.random.default_rng(9)
    for dim in (64, 384):
        x = rng.normal(size=(400, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.normal(size=(400, dim))
        y -= (x * y).sum(1, keepdims=True) * x
        y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        for classes in (5_000, 50_000, 10**6, 10**8):
            code, aim = Code(dim, code_words(classes)), aim_for(classes)
            found = [bool(set(a) & set(b)) for a, b in zip(code.decode(x, aim).tolist(), code.decode(y, aim).tolist())]
            print(dim, classes, aim, np.mean(found))
            assert np.mean(found) >= 0.97
