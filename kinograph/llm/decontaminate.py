"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments: each holds, for a few megabytes of documents, the sorted positions of every
word, and where its documents start. It is built once. A search takes windows of test words, grouped by the
word of each that is rarest in the corpus; in a segment it visits the groups whose word is there, goes through a
window's words from the rarest on, shifts each one's positions back by its place in the
window, and intersects, so that candidates are gone after a list or two. With a slop, a word may stand that many
words off its place (a proximity match). Documents never leave their segment, so nothing is
shuffled, and no passage or word can be too frequent. A match belongs to the document that its first word
stands in: documents are more words apart than any match can bridge.

The benchmark comes to the driver and to the tasks in blocks of bounded size; each is searched in the same
index, and a document's matches of all blocks are put together.

Words are known by 64-bit hashes. Defined results: a null text has no words and no matches; an item without words
matches nothing; an item with fewer words than a window is one window; a null item_id is searched, and hit words
count, but it is in no list of items; repeated rows are answered each; empty tables give no matches; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.llm.common import LONG_ROWS, expanded, map_arrow, materialize, row_key, slices, squeezed, strings

WINDOW = 10
#: Characters of benchmark text that one block holds, so that its windows fit in any task.
BLOCK_CHARS = 2 << 20
#: Characters of words: digits, letters of ASCII and everything beyond ASCII; A-Z are lower-cased.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_MEMO = 200_000

#: The lists of a segment are binary values, which cost Parquet's reader their bytes; of arrays it holds two levels for each element of a file.
_LISTS = {"starts": np.int32, "doc_ids": np.int64, "known": np.bool_, "rows": np.int64, "terms": np.int64, "ends": np.int32, "positions": np.int32}
_INDEX = f"segment long, gap int, {', '.join(f'{c} binary' for c in _LISTS)}"
_MATCHES = "array<struct<item_id:long,begin:int,end:int,exact:boolean>>"
_FOUND = f"segment long, doc int, doc_id long, row long, n_words long, matches {_MATCHES}"
_MATCH_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("exact", pa.bool_())]))


def words(text: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text."""
    return (text or b"").translate(_WORDS).split()


def term(word: bytes) -> int:
    """The number that a word is known by."""
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def build_index(docs: DataFrame, slop: int = 0) -> DataFrame:
    """The stored index of ``docs`` (doc_id, text), for matches of at most ``slop`` words off; a row per segment."""
    gap = 2 * slop + 1

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, memo = TaskContext.get().partitionId() << 32, {}
        for batch in slices(batches, "text", 4 << 20):
            starts, parts, at = [0], [], 0
            for text in strings(batch.column("text")):
                own = words(text)
                for w in own:
                    if w not in memo:
                        memo[w] = term(w)
                parts.append((np.fromiter(map(memo.__getitem__, own), np.int64, len(own)), np.arange(at, at + len(own), dtype=np.int32)))
                at += len(own) + gap
                starts.append(at)
                if len(memo) > _MEMO:
                    memo.clear()
            terms, positions = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(terms, kind="stable")
            terms = terms[order]
            ends = np.append(np.flatnonzero(np.diff(terms)) + 1, len(terms)) if len(terms) else np.empty(0, np.int64)
            ids, rows = batch.column("doc_id"), batch.column("row").to_numpy(zero_copy_only=False)
            lists = [starts, ids.fill_null(0), ids.is_valid(), rows, terms[ends - 1], ends, positions[order]]
            packed = [pa.array([squeezed(np.asarray(x).astype(t))], pa.binary()) for x, t in zip(lists, _LISTS.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([gap], pa.int32()), *packed], ["segment", "gap", *_LISTS])
            number += 1

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key("doc_id", "text").alias("row"))
    return materialize(map_arrow(rows, segments, _INDEX), "index", LONG_ROWS)


def _unpacked(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    """The list ``name`` of the segment in row ``i``."""
    return expanded(batch.column(name)[i], _LISTS[name])


def windows_of(items: list[tuple], size: int = WINDOW) -> dict[tuple, set]:
    """The items of each distinct window, a tuple of terms, of ``items`` (item_id, text)."""
    windows: dict[tuple, set] = {}
    for item, text in items:
        ids = [term(w) for w in words(text.encode() if text is not None else None)]
        for i in range(max(1, len(ids) - size + 1) if ids else 0):
            windows.setdefault(tuple(ids[i : i + size]), set()).add(item)
    return windows


def positions_of(window: list[tuple[int, int]], lists: dict[int, np.ndarray], slop: int) -> np.ndarray:
    """Starts at which each (term, place) stands at most ``slop`` words off its place; rarest term first."""
    (first, place), *rest = window
    at = lists[first] - place
    if slop:
        at = np.unique(at[:, None] + np.arange(-slop, slop + 1)[None, :])
    for other, place in rest:
        if not len(at):
            break
        there = lists[other]
        i = np.searchsorted(there, at + (place - slop))
        at = at[(i < len(there)) & (there[np.minimum(i, len(there) - 1)] <= at + (place + slop))]
    return at


def _away(near: np.ndarray, exact: np.ndarray, slop: int) -> np.ndarray:
    """Those of ``near`` with no exact match within ``slop``."""
    i = np.searchsorted(exact, near - slop)
    return near[(i == len(exact)) | (exact[np.minimum(i, len(exact) - 1)] > near + slop)] if len(exact) else near


def _occurrences(index: DataFrame, wanted: np.ndarray) -> dict[int, int]:
    """How often each of the ``wanted`` terms (sorted) is in the corpus."""
    shared = index.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                terms, ends = _unpacked(batch, "terms", i), _unpacked(batch, "ends", i)
                at = np.minimum(np.searchsorted(terms, shared.value), len(terms) - 1)
                if len(terms):
                    total += np.where(terms[at] == shared.value, np.diff(ends, prepend=0)[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(shared.value[some]), pa.array(total[some])], ["term", "n"])

    counts = map_arrow(index.select("terms", "ends"), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in counts.collect()}


def search(index: DataFrame, windows: dict[tuple, set], slop: int = 0, every: bool = True) -> DataFrame:
    """(segment, doc, doc_id, row, n_words, matches) for each document of ``index``, or each with a match.

    Of the starts of an item's windows in a document, adjacent ones are one match; begin and end count words, within the document.
    """
    counts = _occurrences(index, np.array(sorted({t for w in windows for t in w}), np.int64)) if windows else {}
    groups: dict[int, list] = {}  # by the rarest term
    for w, items in windows.items():
        if all(t in counts for t in w):
            order = sorted(((t, i) for i, t in enumerate(w)), key=lambda x: (counts[x[0]], x))
            groups.setdefault(order[0][0], []).append((order, w[0], sorted(items, key=str)))
    plan = index.sparkSession.sparkContext.broadcast((np.array(sorted(groups), np.int64), groups))

    def matches_of(lists: dict, here: list, starts: np.ndarray, gap: int) -> dict[int, list]:
        found: dict[tuple, list] = {}
        for group in here:
            for window, head, items in group:
                if not all(t in lists for t, _ in window):
                    continue
                exact = positions_of(window, lists, 0)
                near = _away(positions_of(window, lists, slop), exact, slop) if slop else exact[:0]
                for begins, sure in ((exact, True), (near, False)):
                    if len(begins):
                        first = begins if sure else lists[head][np.searchsorted(lists[head], begins - slop)]
                        for begin, doc in zip(begins.tolist(), (np.searchsorted(starts, first, "right") - 1).tolist(), strict=True):
                            for item in items:
                                found.setdefault((doc, item, sure), []).append((begin, begin + len(window)))
        matches: dict[int, list] = {}
        for (doc, item, sure), spans in found.items():
            merged: list = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            low, high = int(starts[doc]), int(starts[doc + 1]) - gap
            matches.setdefault(doc, []).extend({"item_id": item, "begin": max(a, low) - low, "end": min(b, high) - low, "exact": sure} for a, b in merged)
        return matches

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarest, groups = plan.value
        for batch in batches:
            for i in range(batch.num_rows):
                at = lambda name: _unpacked(batch, name, i)  # noqa: B023, E731
                starts, gap, terms = at("starts"), batch.column("gap")[i].as_py(), at("terms")
                lists, here = {}, []
                if len(terms):
                    present = rarest[terms[np.minimum(np.searchsorted(terms, rarest), len(terms) - 1)] == rarest]
                    here = [groups[t] for t in present.tolist()]
                    ends, positions = at("ends"), at("positions")
                    wanted = np.array(sorted({t for g in here for w, *_ in g for t, _ in w}), np.int64)
                    place = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                    for t, k in zip(wanted[terms[place] == wanted].tolist(), place[terms[place] == wanted].tolist(), strict=True):
                        lists[t] = positions[ends[k - 1] if k else 0 : ends[k]]
                matches = matches_of(lists, here, starts, gap)
                docs = range(len(starts) - 1) if every else sorted(matches)
                if docs:
                    take = pa.array(docs, pa.int32())
                    ids = pa.array(at("doc_ids"), mask=~at("known"))
                    columns = [pa.array([batch.column("segment")[i].as_py()] * len(docs), pa.int64()), take, ids.take(take), pa.array(at("rows")).take(take), pa.array((np.diff(starts) - gap).astype(np.int64)).take(take), pa.array([matches.get(d, []) for d in docs], _MATCH_TYPE)]
                    yield pa.RecordBatch.from_arrays(columns, ["segment", "doc", "doc_id", "row", "n_words", "matches"])

    return map_arrow(index, find, _FOUND)


def find_contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """(doc_id, row, n_words, matches) for each row of ``docs``: where texts of ``items`` (item_id, text) stand in it."""
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    index = build_index(docs, slop)
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + chars // BLOCK_CHARS
    found = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        part = search(index, windows_of([tuple(r) for r in own.collect()], size), slop, every=block == 0)
        found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy("segment", "doc").agg(F.first("doc_id").alias("doc_id"), F.first("row").alias("row"), F.first("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"))
    return found.select("doc_id", "row", "n_words", "matches")


def hit_words(matches):
    """How many words stand in an exact match, as a column over ``matches``."""
    spans = F.array_sort(F.transform(F.filter(matches, lambda m: m["exact"]), lambda m: F.struct(m["begin"].alias("a"), m["end"].alias("b"))))
    start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    step = lambda s, m: F.struct(F.greatest(s["to"], m["b"]).alias("to"), (s["n"] + F.greatest(m["b"] - F.greatest(s["to"], m["a"]), F.lit(0))).alias("n"))
    return F.aggregate(spans, start, step, lambda s: s["n"])
