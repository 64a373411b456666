import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from tokenizers import Tokenizer

from kinograph.llm import retrieval_packing
from kinograph.llm.retrieval_packing import K1, QUERY_TERMS, RESULT, B, Ids, Index, fill, inverse_frequency, pack_by_retrieval, routes, terms

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, row long, n string, ids string, shard string, held string"
ODD = ["", " ", "a", "  a  b ", "a\n b\t c", "a  b　c", "don't we'll I'd", "été ça — “x” 你好 世界", "x<|endoftext|>y", "<|", "1234 5,678.90", "\x1c \x85 z", "e" * 5000, " " * 3000, "a b" * 900, "  ​ q", "🙂 👍🏽", "a \nb", "a\r\n b"]


@pytest.fixture(scope="module")
def exact():
    tool = Tokenizer.from_file(PATH)
    return lambda text: [*tool.encode(text or "", add_special_tokens=False).ids, 0]


def test_ids_are_the_tokenizers(exact):
    tool, rng = Ids(PATH, PATTERN).open(), random.Random(3)
    letters = "ab é\n\t,.'s1  　<|>ß你  -"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for some in (texts[:50], texts, ["one  two", None, "x" * 70 + " b"]):
        ids, sizes = tool.texts(pa.array(["left out", *some])[1:])
        assert len(sizes) == len(some)
        for text, own in zip(some, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert own.tolist() == exact(text), repr(text)


def check(rows, got, exact, window):
    """All ids of all rows in gapless sequences, only the tails shorter than a window, those powers of two."""
    names = RESULT.replace(" long", "").split(", ")
    got = [dict(zip(names, r, strict=True)) for r in got]
    want = Counter((i, len(exact(t))) for i, t, *_ in rows)
    assert sum(want.values()) == sum(r["start"] == 0 for r in got) and sum(r["length"] for r in got) == sum(n * k for (_, n), k in want.items())
    ids = {}
    for i, t, *_ in rows:
        ids.setdefault(i, []).append(exact(t))
    cover = Counter()
    for r in got:
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        cover.update((r["doc_id"], r["doc_tokens"], k) for k in range(r["start"], r["start"] + r["length"]))
    assert all(n == want[i, size] for (i, size, _), n in cover.items())
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    lengths = []
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        lengths.append(sum(n for _, n in own))
    assert all(n == window or n < window and n & (n - 1) == 0 for n in lengths)
    return got


def test_documents(spark, exact):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", f"word{i % 9}"]) for _ in range(rng.randint(0, 80)))) for i in range(150)]
    rows += [(1000 + k, t) for k, t in enumerate(ODD)] + [(7, "same row")] * 5 + [(None, "no id"), (9, None), (2000, "long text " * 40_000)]
    df = spark.createDataFrame([(*r, 1, "n", "i", "s", "h") for r in rows], SCHEMA)
    for window, shard in ((64, 500), (1024, 1 << 21)):
        out = pack_by_retrieval(df.repartition(3), PATH, PATTERN, window, shard)
        assert out.columns == RESULT.replace(" long", "").split(", ")
        check(rows, map(tuple, out.collect()), exact, window)
    assert pack_by_retrieval(df.limit(0), PATH, PATTERN).count() == 0
    assert [r.length for r in pack_by_retrieval(spark.createDataFrame([(1, None)], "doc_id long, text string"), PATH, PATTERN).collect()] == [1]


def test_terms_and_routes():
    begins = np.array([False, True, False])
    ids = np.array([1, 2, 1, 2, 2, 0, 2, 1, 2, 0, 0], np.uint16)
    doc, term, times = terms(ids, np.array([6, 4, 1]), begins)
    # words 12, 122 | 2, 12 | none
    assert doc.tolist() == [0, 0, 1, 1] and times.tolist() == [1, 1, 1, 1] and len(set(term[:2]) & set(term[2:])) == 1
    back = retrieval_packing._unpacked_terms(pa.array([zstandard.compress(t) for t in retrieval_packing._packed_terms(doc, term, times, 3)]))
    assert all((a == b).all() for a, b in zip(back, (doc, term, times), strict=True))
    idf = np.zeros(1 << 20)
    idf[term[2:]] = [1.0, 2.0]
    assert routes(doc, term, times, idf, 3).tolist()[1:] == [int(term[2:][np.argmax(idf[term[2:]])]), 0]


def test_neighbours_are_those_of_plain_bm25():
    rng = random.Random(5)
    docs = [Counter(rng.choices(range(60), [1 / (k + 1) for k in range(60)], k=rng.randint(0, 90))) for _ in range(120)]
    holding = np.array([sum(t in d for d in docs) for t in range(60)])
    idf = inverse_frequency(holding, len(docs))
    sizes, mean = [sum(d.values()) for d in docs], sum(map(lambda d: sum(d.values()), docs)) / len(docs)
    doc, term, times = (np.array(x) for x in zip(*((i, t, n) for i, d in enumerate(docs) for t, n in sorted(d.items())), strict=True))
    index = Index(doc, term, times, np.array(sizes), idf, mean)
    for seed, own in enumerate(docs):
        asked = sorted((t for t in own if holding[t] > 1), key=lambda t: (-own[t] * idf[t], t))[:QUERY_TERMS]
        want = {}
        for i, d in enumerate(docs):
            score = sum(idf[t] * d[t] * (K1 + 1) / (d[t] + K1 * (1 - B + B * sizes[i] / mean)) for t in asked if t in d)
            if score:
                want[i] = score
        found, scores = index.neighbours(seed)
        assert found.tolist() == sorted(want) and all(math.isclose(s, want[i]) for i, s in zip(found.tolist(), scores, strict=True))


def plain_fill(sizes, scores, window):
    """Windows token by token: the seed is the document of a window's first token; where a document ends, the best unused one follows."""
    unused, tokens, seed, at = list(range(len(sizes))), [], None, None
    while unused or at:
        if not at:
            near = [d for d in unused if seed is not None and len(tokens) % window and scores[seed][d] > 0]
            d = min(near, key=lambda x: (-scores[seed][x], x)) if near else unused[0]
            unused.remove(d)
            at = [d, 0]
        if len(tokens) % window == 0:
            seed = at[0]
        tokens.append(tuple(at))
        at = [at[0], at[1] + 1] if at[1] + 1 < sizes[at[0]] else None
    return tokens


def test_windows_are_filled_best_first():
    rng = random.Random(6)
    for _ in range(30):
        n, window = rng.randint(1, 40), rng.choice([8, 16])
        sizes = [rng.choice([1, 3, 8, 16, 40, rng.randint(1, 30)]) for _ in range(n)]
        scores = np.array([[rng.choice([0, 0, 1, 2, 3.5]) for _ in range(n)] for _ in range(n)])

        def near(seed, scores=scores):
            found = np.flatnonzero(scores[seed])
            return found, scores[seed][found]

        pieces = fill(sizes, near, window)
        assert [(d, k) for d, a, m, *_ in pieces for k in range(a, a + m)] == plain_fill(sizes, scores, window)
        assert [s for *_, s, _ in pieces] == sorted(s for *_, s, _ in pieces)
