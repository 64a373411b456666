"""Each stage over all rows of its input, against a plain version."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinograph.llm.common import drop_rows
from kinograph.llm.decontaminate import WINDOW
from kinograph.llm.packing import CAPACITY
from kinograph.llm.substring_dedup import PASSAGE_BYTES
from kinograph.llm.token_counts import Counter as Tokens
from kinograph.llm.token_counts import load_vocabulary
from kinograph.llm.toxicity import fit_labels
from test_decontaminate import words
from test_substring_dedup import plain_spans
from tests_llm_common import components

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, rows before, rows after, columns) of each stage, as run() chains them."""
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        out[name] = (docs.collect(), after.collect(), after.columns)
        docs = after
    assert all(c == columns for _, _, c in [*out.values()][:-1])
    return out


def test_toxicity(spark, stages):
    before, after, _ = stages["toxicity"]
    docs = spark.createDataFrame(before)
    machine = fit_labels(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = machine.scores([r.text for r in before])
    assert sorted(after) == sorted(r for r, s in zip(before, scores, strict=True) if s < 0.5)
    assert 0 < len(before) - len(after) < 0.3 * len(before)


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup(stages):
    before, after, _ = stages["simhash_near_dedup"]
    sets = {r.doc_id: shingles(r.text) for r in before}
    holders, links = defaultdict(list), set()
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for own in holders.values() for k, a in enumerate(own) for b in own[k + 1 :])
    links = [(a, b) for (a, b), n in common.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)]
    empty = [i for i, s in sets.items() if not s]
    links += [(empty[0], i) for i in empty[1:]]
    want = set(components(sets, links).values())
    assert sorted(after) == sorted(r for r in before if r.doc_id in want)
    assert len(after) < len(before)


def test_substring_dedup(stages):
    before, after, _ = stages["substring_dedup"]
    spans = plain_spans([(r.doc_id, r.text) for r in before], 90, PASSAGE_BYTES)
    want = []
    for r, (_, _, gone, _) in zip(before, spans, strict=True):
        text = r.text
        if gone:
            data, edges = r.text.encode(), [0, *[x for span in gone for x in span], None]
            text = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])).decode()
        want.append((r.doc_id, text, r.lang, r.source, len(text) if gone else r.n_chars))
    assert sorted(map(tuple, after), key=str) == sorted(want, key=str)
    assert any(g for _, _, g, _ in spans)


def test_decontamination(spark, stages):
    before, after, _ = stages["decontamination"]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + WINDOW]) for i in range(max(1, len(w) - WINDOW + 1) if w else 0)}
    sizes = {len(w) for w in windows}
    hit = {r.doc_id for r in before for w in [words(r.text)] if any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))}
    assert sorted(after) == sorted(r for r in before if r.doc_id not in hit) and hit


def test_packing(stages):
    before, packed, columns = stages["packing"]
    sizes, sources = dict(zip([r.doc_id for r in before], [n + 1 for n in Tokens(load_vocabulary()).texts([r.text for r in before])], strict=True)), {r.doc_id: r.source for r in before}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in packed:
        pieces[r.doc_id].append((r.piece, r.begin, r.tokens))
        bins[r.bin_id].append(r)
    assert set(pieces) == set(sizes)
    for i, own in pieces.items():
        whole = [(k, k * CAPACITY, min(CAPACITY, sizes[i] - k * CAPACITY)) for k in range(-(-sizes[i] // CAPACITY))]
        assert sorted(own) == whole
    for own in bins.values():
        rests = [sources[r.doc_id] for r in own if r.tokens < CAPACITY and sources[r.doc_id] is not None]
        assert sum(r.tokens for r in own) <= CAPACITY and len(set(rests)) == len(rests)


def test_odd_rows_pass_every_stage(spark):
    rng = random.Random(1)
    say = lambda n: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(n))
    long = say(60_000)
    rows = [(i, say(30), "en", "s", 1, "x", "y") for i in range(30)]
    rows += [(None, None, None, None, None, None, None), (100, "", "en", "s", 0, "x", "y"), (101, long, "en", "s", 9, "x", "y"), (102, long, None, "s", 9, "x", "y"), (103, say(5), "en", "s", 1, "x", "y"), (None, say(40), "en", "s", 1, "x", "y")]
    rows += [rows[3], rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, gone string")
    for docs in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF).cache()
            assert docs.columns == df.columns
        kept = docs.collect()
        ids = [r.doc_id for r in kept]
        if kept:
            assert ids.count(3) == 1 and 101 in ids and 102 not in ids and ids.count(None) == 1
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(kept)


def test_long_lists_of_rows_shuffle_no_other_texts(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i % 400, f"text {i % 400} {rng.random() if i < 300 else 0}", i) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    keys = docs.where("doc_id % 7 = 0")
    from kinograph.llm.common import row_key

    keys = keys.select(row_key("doc_id", "text").alias("row")).distinct()
    want = sorted(drop_rows(docs, keys).collect())
    assert want == sorted(r for r in docs.collect() if r.doc_id % 7)
    for module in ("common", "simhash", "near_copies"):
        monkeypatch.setattr(f"kinograph.llm.{module}.BROADCAST_KEYS", 0)
    assert sorted(drop_rows(docs, keys).collect()) == want
    _, stage = corpus_pipeline.STAGES[1]
    few = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (3, "other words stand here now"), (None, None)], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in stage(spark, few, SF).collect()) == [0, 1, 3]
    assert stage(spark, few, SF).agg(F.count("*")).first()[0] == 3


def test_a_worker_gives_back_the_memory_of_a_task():
    from kinograph.llm import common

    held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    pins = []

    def function(batches):
        for _ in batches:
            parts = [bytearray(60_000) for _ in range(4000)]  # too small to be mapped each by itself
            pins.append(parts[-1])
            yield held()

    before = held()
    (full,) = common.released(function)(iter([None]))
    assert full - before > 150e6 and held() - before < 50e6
