import random

import numpy as np

from kinograph.llm.common import row_key
from kinograph.llm.substring_dedup import GEAR, PASSAGE_BYTES, WINDOW, cuts, gear_hashes, remove_repeats, repeated_spans

SCHEMA = "doc_id long, text string, n_chars long, gone string"


def test_gear_hash_is_the_rolling_one():
    data = np.random.default_rng(1).integers(1, 256, 500).astype(np.uint8)
    h, want = 0, []
    for b in data:
        h = (2 * h + int(GEAR[b])) % (1 << 16)
        want.append(h)
    assert gear_hashes(data).tolist() == want


def test_cuts_survive_an_insertion():
    rng = random.Random(2)
    a = " ".join(f"w{rng.randint(0, 999)}" for _ in range(400)).encode()
    b = a[:500] + b"inserted words here " + a[500:]
    one, two = cuts([a, b])
    tail = {len(a) - c for c in one if c > 500 + WINDOW}
    assert tail <= {len(b) - c for c in two}
    assert [c[-1] if len(c) else 0 for c in cuts([b"", b"x", "é".encode() * 5000])] == [0, 1, 10000]
    assert all(c % 2 == 0 for c in cuts(["é".encode() * 5000])[0]) and len(cuts([bytes(rng.randint(97, 122) for _ in range(30000))])[0]) > 4


def test_passages_go_but_for_the_first(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randint(0, 99999)}" for _ in range(n))
    passages = [say(60) for _ in range(8)]
    rows = []
    for i in range(200):
        parts = [say(rng.randint(20, 80)), say(30)]
        if i % 4 == 0:
            parts.insert(1, passages[i // 4 % 8])
        rows.append((i, " ".join(parts), 7, "z"))
    rows += [(900, None, 7, "z"), (901, "", 0, "z"), (902, say(40) + " é" + "ü" * 300, 7, "z"), (None, say(9) + " " + passages[0], 7, "z"), (12, rows[13][1], 7, "z"), (11, rows[11][1], 7, "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in remove_repeats(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, t, n, _ in rows[:200]:
        (kept, *more) = got[i]
        if i in (11, 12, 13):
            continue
        if i % 4 or i < 32:
            assert kept.text == t and kept.n_chars == 7 and not more
        else:
            assert len(kept.text) < len(t) - 200 and kept.n_chars == len(kept.text)
            for part in (t.split()[:15], t.split()[-25:]):
                assert " ".join(part) in kept.text
    assert [r.text for r in got[900]] == [None] and [r.text for r in got[901]] == [""]
    assert passages[0][80:-80] not in got[None][0].text
    assert all(r.text == rows[11][1] for r in got[11]) and len(got[11]) == 2
    spans = repeated_spans(df)
    assert spans.where("shared > 0").count() >= 48
    assert remove_repeats(df.limit(0)).count() == 0


def test_phrases_from_different_documents_are_no_passage(spark):
    rng = random.Random(7)
    say = lambda n: " ".join(f"w{rng.randint(0, 99999)}" for _ in range(n))
    source = say(900).encode()
    (ends,) = cuts([source])
    phrases = [source[a:b].decode() for a, b in zip(ends[:-2], ends[1:-1]) if 24 < b - a < 60]  # all end at a cut
    own, phrases = phrases[:12], phrases[12:24]
    rows = [(i, own[i] + p + say(40), 7, "z") for i, p in enumerate(phrases)]
    rows += [(100, "".join(phrases) + say(40), 7, "z"), (101, own[0] + "".join(phrases[2:8]) + say(40), 7, "z")]
    docs = {i: t for i, t, *_ in rows}
    found = repeated_spans(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("gone", "z"), 90, 90)
    got = {r.row: r for r in found.collect()}
    keys = {r.row: r.doc_id for r in spark.createDataFrame(rows, SCHEMA).select("doc_id", row_key("doc_id", "text").alias("row")).collect()}
    removed = {keys[k]: r for k, r in got.items() if r.gone}
    assert set(removed) == {101}  # six phrases that stand together in 100; in 100 itself each is from another document
    text = docs[101].encode()
    assert all(text[g.begin : g.end] in docs[100].encode() for g in removed[101].gone)


def plain_spans(docs, least, passage):
    """For each row number: shared and removed runs and their first documents, by one table of all windows' texts."""
    order = lambda i: (i is None, i or 0)
    found, owners = [], {}
    for i, t in docs:
        data, own = (t or "").encode(), set()
        ends = [int(c) for c in cuts([data])[0]] if data else []
        starts = [0, *ends[:-1]]
        for k, a in enumerate(starts if ends else []):
            own |= {(a, e) for e in [next((e for e in ends[k:] if e - a >= least), None)] if e}
        for k, e in enumerate(ends):
            own |= {(s, e) for s in [next((s for s in reversed(starts[: k + 1]) if e - s >= least), None)] if s is not None}
        found.append((i, data, own))
        for a, e in own:
            owners.setdefault(data[a:e], set()).add(i)

    def runs(spans):
        out = []
        for a, e in sorted(spans):
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([a, e])
        return [(a, e) for a, e in out if e - a >= passage]

    result = []
    for i, data, own in found:
        shared = [(a, e) for a, e in own if len(owners[data[a:e]]) > 1]
        first = {s: min(owners[data[s[0] : s[1]]], key=order) for s in shared}
        gone = [s for s in shared if first[s] != i]
        cut = runs(gone)
        result.append((i, sum(e - a for a, e in runs(shared)), cut, sorted({first[s] for s in gone if any(a <= s[0] and s[1] <= e for a, e in cut)})))
    return result


def spans_of(spark, docs, least, passage):
    df = spark.createDataFrame([(i, t, 7, "z") for i, t in docs], SCHEMA)
    got = {r.row: (r.shared, [(g.begin, g.end) for g in r.gone], r.first_ids) for r in repeated_spans(df, least, passage).collect()}
    rows = df.select("doc_id", "text", row_key("doc_id", "text").alias("row")).collect()
    return sorted([(r.doc_id, *got.get(r.row, (0, [], []))) for r in rows], key=str)


def test_spans_match_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want = plain_spans(docs, 90, PASSAGE_BYTES)
    assert sum(bool(g) for _, _, g, _ in want) > 100
    assert spans_of(spark, docs, 90, PASSAGE_BYTES) == sorted(want, key=str)
    rng = random.Random(11)
    say = lambda n: " ".join(f"w{rng.randint(0, 60)}" for _ in range(n))
    shared, long = say(50), say(60_000)
    docs = [(i, say(rng.randint(0, 40)) + " " + rng.choice([shared, "", say(9)])) for i in range(150)]
    docs += [(200, None), (201, ""), (None, shared), (202, long), (203, long[1000:]), (3, shared + " more"), (3, shared + " more")] + [(204, shared)] * 40
    for passage in (40, 120):
        assert spans_of(spark, docs, 40, passage) == sorted(plain_spans(docs, 40, passage), key=str)


def test_lists_too_long_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr("kinograph.llm.substring_dedup.BROADCAST_SPANS", -1)
    rng = random.Random(12)
    say = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    shared = say(60)
    df = spark.createDataFrame([(i, say(20) + (" " + shared if i % 5 == 0 else ""), 7, "z") for i in range(100)], SCHEMA)
    got = {r.doc_id: r for r in remove_repeats(df).collect()}
    assert len(got) == 100 and sum(len(r.text) < 250 for r in got.values() if r.doc_id % 5 == 0 and r.doc_id) == 19
    assert all(r.n_chars == 7 for r in got.values() if r.doc_id % 5)


def test_passages_in_text_without_ascii_spaces(spark):
    rng = random.Random(8)
    for letters, gap in ((range(0x4E00, 0x5E00), 0), (range(0x430, 0x450), 7)):
        say = lambda n: "".join("\u3000" if gap and k % gap == gap - 1 else chr(rng.choice(letters)) for k in range(n))  # noqa: E731, B023
        passages = [say(150) for _ in range(20)]
        rows = [(i, say(rng.randint(0, 300)) + passages[i % 20] + say(rng.randint(0, 300)), 7, "z") for i in range(40)]
        texts = {r.doc_id: r.text for r in remove_repeats(spark.createDataFrame(rows, SCHEMA), passage=90).collect()}
        assert all(texts[i] == t for i, t, *_ in rows[:20])
        lost = [len(t) - len(texts[i]) for i, t, *_ in rows[20:]]
        assert sum(n > 60 for n in lost) == 20 and sum(lost) > 0.6 * 20 * 150 and max(lost) <= 150
    assert len(cuts([passages[0].encode()])[0]) > 4
