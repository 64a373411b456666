import math
import zlib

import numpy as np

from kinograph.llm.q_toxicity import op4_toxicity
from kinograph.llm.toxicity import LEAST_G, Machine, choose_bins, drop_toxic, fit_labels, sample, score, word_bins, pair_gains

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [r for r in op4_toxicity(spark, SF).collect()]
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [(truth[r.doc_id], r.predicted, r.score) for r in got if r.held_out and r.doc_id in truth]
    assert all(0 <= s <= 1 for *_, s in held)
    assert np.mean([t == p for t, p, _ in held]) >= 0.98
    assert np.mean([p for t, p, _ in held if t]) >= 0.85  # some labelled texts hold no toxic word
    assert np.mean([p for t, p, _ in held if not t]) <= 0.02


def rows_of(spark, texts):
    docs = spark.createDataFrame([(i, t, 0.0) for i, (t, _) in enumerate(texts)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    return docs, labels


def test_pairs_matter(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(900):
        a, b = rng.random(2) < 0.3
        rows.append((" ".join(["plain words here"] + ["alpha"] * int(a) + ["omega"] * int(b)), int(a and not b or b and not a)))
    m = fit_labels(*rows_of(spark, rows))
    alpha, omega, both = m.scores(["alpha", "omega", "alpha omega"])
    assert alpha > 0.5 and omega > 0.5 and both < 0.5


def test_score_is_that_of_all_pairs():
    rng = np.random.default_rng(2)
    words = [f"term{i}x" for i in range(30)]
    bins = {b: i for i, b in enumerate(sorted({b for w in words for b in word_bins(w)}))}
    m = Machine(bins, rng.normal(size=len(bins)) / 9, rng.normal(size=(len(bins), 4)) / 9, -0.3)
    texts = [" ".join(rng.choice(words, rng.integers(0, 12))) for _ in range(50)] + [None, "", "none of these", " ".join(words * 20_000)]
    for text, got in zip(texts, m.scores(texts), strict=True):
        own = sorted({bins[b] for w in set((text or "").split()) for b in word_bins(w) if b in bins})
        z = m.bias + sum(m.weights[i] for i in own) + sum(m.factors[i] @ m.factors[j] for k, i in enumerate(own) for j in own[k + 1 :])
        assert math.isclose(got, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_bins_are_those_of_the_largest_g(spark):
    rng = np.random.default_rng(3)
    words = [f"q{i}" for i in range(60)]
    rows = []
    for _ in range(400):
        toxic = int(rng.random() < 0.3)
        rows.append((" ".join(w for i, w in enumerate(words) if rng.random() < (0.1 + 0.4 * toxic * (i % 3 == 0))), toxic))
    held = sample(*rows_of(spark, rows))
    ids = {r.doc_id for r in held.collect()}
    used = [({b for w in set(t.split()) for b in word_bins(w)}, y) for i, (t, y) in enumerate(rows) if i in ids]
    assert ids == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5}
    total, positives = len(used), sum(y for _, y in used)
    g = {}
    for b in set().union(*(s for s, _ in used)):
        cells = [(sum(1 for s, y in used if (b in s) == has and y == label), sum(1 for s, _ in used if (b in s) == has) * (positives if label else total - positives) / total) for has in (0, 1) for label in (0, 1)]
        if sum(1 for s, y in used if b in s and y) >= 3:
            g[b] = 2 * sum(o * math.log(o / e) for o, e in cells if o)
    want = sorted((b for b in g if g[b] >= LEAST_G), key=lambda b: (-round(g[b], 6), b))
    assert len(want) > 12
    assert choose_bins(held) == sorted(want) and choose_bins(held, 10) == sorted(want[:10])


def test_a_pair_without_any_marginal_is_learned(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(2500):
        a, b = i % 2, i // 2 % 2
        words = ["alpha"] * a + ["omega"] * b + [f"filler{k}" for k in rng.integers(0, 40, 6)]
        rows.append((" ".join(words), a ^ b))
    m = fit_labels(*rows_of(spark, rows))
    held = [(t, y) for i, (t, y) in enumerate(rows) if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [(s >= 0.5) == bool(y) for s, (_, y) in zip(m.scores([t for t, _ in held]), held, strict=True)]
    assert sum(right) / len(right) > 0.97


def test_gains_of_pairs_are_those_of_their_tables():
    rng = np.random.default_rng(6)
    x, y = (rng.random((200, 4)) < 0.4).astype(float), (rng.random(200) < 0.3).astype(float)
    y[x[:, 0] * x[:, 1] > 0] = 1

    def g(kinds):
        total = 0.0
        for kind in set(kinds):
            own = np.array([k == kind for k in kinds])
            for label in (0, 1):
                seen = ((y == label) & own).sum()
                total += 2 * seen * math.log(seen / (own.sum() * (y == label).mean())) if seen else 0
        return total

    got = pair_gains(x, y)
    for i in range(4):
        for j in range(4):
            if i != j:
                assert math.isclose(got[i, j], g(list(zip(x[:, i], x[:, j], strict=True))) - g(list(x[:, i])) - g(list(x[:, j])), abs_tol=1e-8)


def test_drop_toxic_filters_in_place(spark):
    docs, labels = rows_of(spark, [("vile thing" if i % 2 else "good thing", i % 2) for i in range(60)])
    m = fit_labels(docs, labels)
    kept = drop_toxic(docs.unionByName(spark.createDataFrame([(None, None, 1.0), (7, "vile thing", 2.0)], docs.schema)), m)
    assert sorted((str(r.doc_id), r.score) for r in kept.collect()) == sorted([(str(i), 0.0) for i in range(0, 60, 2)] + [("None", 1.0)])
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString().split("Union")[0]
    assert drop_toxic(docs, None).count() == 60 and drop_toxic(docs.limit(0), m).count() == 0


def test_edges(spark):
    docs = spark.createDataFrame([(1, "bad word", 0.0), (1, "bad word", 0.0), (None, None, 0.0), (2, "", 0.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert fit_labels(docs, none) is None
    assert [r.score for r in score(docs, None).collect()] == [0.0] * 4
    some = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    many = spark.createDataFrame([(i, "vile thing" if i % 2 else "good thing") for i in range(40)], "doc_id long, text string")
    m = fit_labels(many, some)
    vile, good, none = m.scores(["vile", "good", None])
    assert vile > 0.5 > good and 0 <= none <= 1
    assert score(docs.limit(0), m).count() == 0
