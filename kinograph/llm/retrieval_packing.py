"""Lexical retrieval packing: documents fill windows of tokens next to what is most like them.

Documents are tokenized once and their ids written, compressed. Terms are words, that is the runs of ids that begin at a
space, told by a hash of 20 bits; how many documents hold each term is counted over all documents. A document's route is its
term of highest weight (frequency in it by inverse document frequency), and the shards lie side by side along the line of all
routes, as long as the tokens they hold: documents with a rare word in common meet, small routes share a shard, and a route of
any size is cut into as many shards as it needs, by the number of the row. Each shard is an inverted index with BM25 weights from the
statistics of all documents. A window begins with a seed; where the seed ends, the unused documents of the shard that its heaviest terms score highest
follow, and the one that crosses the window's end goes on in the next window, as its seed. Where nothing
unused shares a term with the seed, the next unused document follows. So every window is full, and the last one of a shard is
cut into windows of powers of two.

The ids are those of ``tokenizers`` under the given vocabulary file. Text is cut at single spaces, which no token crosses,
and a worker remembers such words; new ones go to ``tiktoken`` under the same vocabulary, any text where that is not safe
to ``tokenizers`` itself.

Defined results: a null or empty text is one end id; repeated rows are packed each; a null doc_id is kept; a document without words has no
neighbours; equal scores go by the number of the row; sequences' numbers depend on how the table is stored; an empty
table gives no rows; other columns are ignored. A document longer than a shard is its shard's only one, or nearly.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.llm.common import map_arrow, materialize, slices

WINDOW = 1024
END = 0
#: Hash values of terms, as a power of two, and tokens of a shard, about.
TERM_BITS = 20
SHARD = 1 << 21
#: Heaviest terms of a seed that look for neighbours.
QUERY_TERMS = 32
#: Parameters of BM25.
K1, B = 1.2, 0.75
#: Words that a worker remembers, and characters of one it remembers.
MEMO, SHORT = 800_000, 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: White space before a space, or what might be a special token.
_UNSAFE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] |<\|"
_LONG_TEXT = 1 << 20
#: Neighbours that are put in order at once.
_BEST = 64


class Ids:
    """Token ids of texts under a byte-level BPE file of ``tokenizers`` whose ids fit in 16 bits; built again where it arrives."""

    def __init__(self, path: str, pattern: str):
        self.made_of, self.memo = (path, pattern), {}

    def __getstate__(self):
        return self.made_of

    def __setstate__(self, state):
        self.__init__(*state)

    def open(self) -> Ids:
        """Ready for texts; a worker keeps it, and the words it has met, from task to task."""
        if hasattr(self, "spaced"):
            return self
        import tiktoken
        from tokenizers import Tokenizer

        path, pattern = self.made_of
        self.exact = Tokenizer.from_file(path)
        vocabulary = self.exact.get_vocab(with_added_tokens=False)
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("a vocabulary of at most 65,536 ids")
        letters = byte_letters()
        special = {t.content for t in self.exact.get_added_tokens_decoder().values()}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        size = max(self.exact.get_vocab(with_added_tokens=True).values()) + 1
        self.begins, self.spaced = np.zeros(size, bool), np.zeros(size, bool)  # ids that begin a word, by any space or by U+0020
        for token, i in ranks.items():
            self.begins[i], self.spaced[i] = token[:1].isspace(), token[:1] == b" "
        return self

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after another, each with the end after it, and how many each has."""
        column = pc.fill_null(column.cast(pa.string()), "")
        odd = pc.or_(pc.match_substring_regex(column, _UNSAFE), pc.greater(pc.utf8_length(column), _LONG_TEXT)).to_numpy(zero_copy_only=False)
        whole = {k: self.exact.encode(column[k].as_py(), add_special_tokens=False).ids for k in np.flatnonzero(odd).tolist()}
        words = pc.split_pattern(pc.if_else(pa.array(odd), "", column), " ")
        begins = words.offsets.to_numpy() - words.offsets[0].as_py()
        told = words.flatten().dictionary_encode()
        known = self._known(told.dictionary.to_numpy(zero_copy_only=False).tolist())
        # a text's first word stands without a space
        first = words.flatten().take(pa.array(begins[:-1])).to_pylist()
        known += [_bytes(whole[k] if k in whole else self.fast.encode_ordinary(w)) for k, w in enumerate(first)] + [_bytes([END])]
        at = told.indices.to_numpy().astype(np.int64)
        at[begins[:-1]] = len(told.dictionary) + np.arange(len(first))
        at = np.insert(at, begins[1:], len(known) - 1)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 2
        starts, long = np.cumsum(sizes) - sizes, sizes[at]
        ends = np.cumsum(long)
        ids = np.frombuffer(b"".join(known), "<u2")[np.repeat(starts[at] - ends + long, long) + np.arange(ends[-1])]
        return ids, np.diff(np.append(0, ends[begins[1:] + np.arange(len(first))]))

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of each of some distinct words with a space before it."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        out = list(map(self.memo.get, words))
        new = [k for k, ids in enumerate(out) if ids is None]
        if new:
            fresh = [words[k] for k in new]
            found = self._words(fresh)
            for k, ids in zip(new, found, strict=True):
                out[k] = ids
            short = max(map(len, fresh)) <= SHORT
            self.memo.update(zip(fresh, found, strict=True) if short else [(w, i) for w, i in zip(fresh, found, strict=True) if len(w) <= SHORT])
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each word with a space before it, all words in one text: an id that begins with a space begins a word."""
        if not words:
            return []
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(words)), "<u2")
        at = np.append(np.flatnonzero(self.spaced[ids]), len(ids)) * 2
        data, at = ids.tobytes(), at.tolist()
        return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, "<u2").tobytes()


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def terms(ids: np.ndarray, sizes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times) of the words in documents of ``sizes`` ids, one after another; the end ids are no word."""
    ends = np.cumsum(sizes) - 1
    docs = np.repeat(np.arange(len(sizes)), sizes)
    keep = np.ones(len(ids), bool)
    keep[ends] = False
    first = begins[ids]
    first[ends - sizes + 1] = True
    ids, docs, first = ids[keep], docs[keep], first[keep]
    starts = np.flatnonzero(first)
    if not len(starts):
        return (np.empty(0, np.int64),) * 3
    place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * (_MIX + (place.astype(np.uint64) << np.uint64(1)))
    mixed ^= mixed >> np.uint64(29)
    words = np.add.reduceat(mixed * _MIX, starts) >> np.uint64(64 - TERM_BITS)
    kind = np.uint32 if len(sizes) <= 1 << 32 - TERM_BITS else np.uint64  # sorts faster
    both, times = np.unique((docs[starts].astype(kind) << kind(TERM_BITS)) | words.astype(kind), return_counts=True)
    return (both >> kind(TERM_BITS)).astype(np.int64), (both & kind((1 << TERM_BITS) - 1)).astype(np.int64), times


def inverse_frequency(holding: np.ndarray, total: int) -> np.ndarray:
    """BM25's inverse document frequency."""
    return np.log1p((total - holding + 0.5) / (holding + 0.5))


def routes(doc: np.ndarray, term: np.ndarray, times: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """The heaviest term of each of ``n`` documents, the smallest of equals; 0 where it has none. Terms that only one document holds lead nowhere: their weight is 0."""
    out = np.zeros(n, np.int64)
    if len(doc):
        weight, begins = times * idf[term], np.flatnonzero(np.diff(doc, prepend=-1))
        most = np.repeat(np.maximum.reduceat(weight, begins), np.diff(np.append(begins, len(doc))))
        at = np.flatnonzero(weight == most)
        at = at[np.flatnonzero(np.diff(doc[at], prepend=-1))]
        out[doc[at]] = term[at]
    return out


class Index:
    """An inverted index of a shard: postings of each term that several of its documents hold, as BM25 scores under statistics of all documents."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, times: np.ndarray, words: np.ndarray, idf: np.ndarray, mean: float):
        shared = np.bincount(term, minlength=1)[term] > 1
        doc, term, times = doc[shared], term[shared], times[shared]
        self.weight = times * idf[term]
        score = self.weight * (K1 + 1) / (times + K1 * (1 - B + B * words[doc] / max(mean, 1e-9)))
        order = (np.sort((term.astype(np.uint64) << np.uint64(32)) | np.arange(len(term), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.doc, self.score, sorted_terms = doc[order], score[order], term[order]
        first = np.diff(sorted_terms, prepend=-1) > 0
        self.begins = np.append(np.flatnonzero(first), len(order))
        self.own = np.empty(len(order), np.int64)  # the place of each document's terms in ``begins``
        self.own[order] = np.cumsum(first) - 1
        self.own_begins = np.searchsorted(doc, np.arange(len(words) + 1))
        self.n = len(words)

    def neighbours(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that share a term with the seed's heaviest, in no order."""
        a, b = self.own_begins[seed], self.own_begins[seed + 1]
        asked = self.own[a:b][np.argsort(-self.weight[a:b], kind="stable")[:QUERY_TERMS]]
        begins, sizes = self.begins[asked], self.begins[asked + 1] - self.begins[asked]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + sizes, sizes)
        scores = np.bincount(self.doc[at], self.score[at], self.n)
        found = np.flatnonzero(scores)
        return found, scores[found]


def fill(sizes: list[int], neighbours, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of documents of ``sizes`` tokens.

    ``neighbours(seed)`` gives documents and scores. Each seed's unused neighbours follow it, best first.
    """
    used, out = np.zeros(len(sizes), bool), []
    sequence = place = free = 0
    seed, ranked = None, iter(())
    while True:
        following = next((d for d in ranked if not used[d]), None)
        if following is None:
            while free < len(sizes) and used[free]:
                free += 1
            if free == len(sizes):
                break
            following = free
        used[following] = True
        start, rest = 0, sizes[following]
        while rest:
            if place == 0:
                seed, ranked = following, None
            n = min(rest, window - place)
            out.append((following, start, n, sequence, place))
            start, rest, place = start + n, rest - n, place + n
            if place == window:
                sequence, place = sequence + 1, 0
        if place == 0:
            ranked = iter(())
        elif ranked is None:
            ranked = _ranked(*neighbours(seed), used)
    return _tail(out, sequence, place)


def _ranked(found: np.ndarray, scores: np.ndarray, used: np.ndarray) -> Iterator[int]:
    """Unused documents by score, best first, drawn as far as they are asked for."""
    free = ~used[found]
    found, scores = found[free], scores[free]
    if len(found) > 2 * _BEST:  # most windows ask for few
        bound = np.partition(scores, len(scores) - _BEST)[len(scores) - _BEST]
        top = scores >= bound
        yield from found[top][np.argsort(-scores[top], kind="stable")].tolist()
        found, scores = found[~top], scores[~top]
    yield from found[np.argsort(-scores, kind="stable")].tolist()


def _tail(pieces: list[tuple], sequence: int, left: int) -> list[tuple]:
    """The pieces of the last, open window, cut into windows of powers of two, the largest first."""
    cut = len(pieces)
    while cut and pieces[cut - 1][3] == sequence:
        cut -= 1
    out, room, place = pieces[:cut], 0, 0
    for doc, start, rest, _, _ in pieces[cut:]:
        while rest:
            if room == 0:
                room, place, sequence = 1 << (left.bit_length() - 1), 0, sequence + 1
                left -= room
            n = min(rest, room)
            out.append((doc, start, n, sequence - 1, place))
            start, rest, room, place = start + n, rest - n, room - n, place + n
    return out


_TOKENS = ["row", "doc_id", "n", "ids", "terms", "held"]


def _packed_terms(doc: np.ndarray, term: np.ndarray, times: np.ndarray, n: int) -> list[bytes]:
    """Each document's terms, as steps from one to the next, then how often each stands in it."""
    at = np.searchsorted(doc, np.arange(n + 1))
    steps, times = np.diff(term, prepend=0), times.astype("<u4")
    steps[at[:-1][at[:-1] < len(term)]] = term[at[:-1][at[:-1] < len(term)]]
    steps = steps.astype("<u4")
    return [steps[a:b].tobytes() + times[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _unpacked_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, times), as ``terms`` gives them."""
    unpack = zstandard.ZstdDecompressor().decompress
    both = [np.frombuffer(unpack(t), "<u4").reshape(2, -1) for t in column.to_pylist()]
    sizes = [b.shape[1] for b in both]
    return np.repeat(np.arange(len(both)), sizes), np.concatenate([b[0].cumsum(dtype=np.int64) for b in both]), np.concatenate([b[1] for b in both]).astype(np.int64)


def tokenized(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(row, doc_id, n, ids) of each row of ``docs``, and rows with ``held`` alone: counts of documents by term, for each part of the table."""
    shared = docs.sparkSession.sparkContext.broadcast(Ids(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, held, total, words = shared.value.open(), np.zeros(1 << TERM_BITS, np.int32), 0, 0
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, "text", 4 << 20):
            ids, sizes = tool.texts(batch.column("text"))
            doc, term, times = terms(ids, sizes, tool.begins)
            ids = [i.tobytes() for i in np.split(ids, np.cumsum(sizes)[:-1])]
            own = [pack(i) for i in _packed_terms(doc, term, times, len(ids))]
            held += np.bincount(term, minlength=len(held)).astype(np.int32)
            total, words = total + len(ids), words + int(times.sum())
            empty = pa.nulls(len(ids), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(sizes), pa.array(map(pack, ids), pa.binary()), pa.array(own, pa.binary()), empty], _TOKENS)
        if total:
            at = np.flatnonzero(held)
            told = pack(np.array([total, words, *at.tolist(), *held[at].tolist()], np.int64).tobytes())
            one = [pa.nulls(1, pa.int64())] * 3 + [pa.nulls(1, pa.binary())] * 2 + [pa.array([told], pa.binary())]
            yield pa.RecordBatch.from_arrays(one, _TOKENS)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_arrow(rows, run, "row long, doc_id long, n long, ids binary, terms binary, held binary")


def statistics(table: DataFrame) -> tuple[int, int, np.ndarray]:
    """Documents, words, and how many documents hold each term, summed by Spark; 2^20 numbers whatever the input."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for told in batch.column("held").to_pylist():
                own = np.frombuffer(unpack(told), np.int64)
                half = (len(own) - 2) // 2
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], own[2 : 2 + half]])), pa.array(np.concatenate([own[:2], own[2 + half :]]))], ["term", "n"])

    rows = map_arrow(table.where("held IS NOT NULL").select("held"), split, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return _dense(rows, 2)


def _dense(rows: DataFrame, more: int) -> tuple:
    """Numbers at -``more`` to -1, then an array by term."""
    out = np.zeros(more + (1 << TERM_BITS), np.int64)
    for batch in rows.toArrow().to_batches():
        out[batch.column(0).to_numpy() + more] = batch.column(1).to_numpy()
    return (*(int(x) for x in out[:more]), out[more:])


def _read(batch: pa.Table, begins: np.ndarray) -> tuple:
    """The ids of each row, and the terms of all."""
    unpack = zstandard.ZstdDecompressor().decompress
    ids = [np.frombuffer(unpack(i), "<u2") for i in batch.column("ids").to_pylist()]
    sizes = np.array([len(i) for i in ids], np.int64)
    return ids, terms(np.concatenate(ids), sizes, begins)


def _sized(table: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` tokens, or one row."""
    begin = total = 0
    for i, n in enumerate(table.column("n").to_pylist()):
        if i > begin and total + n > most:
            yield table.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < table.num_rows:
        yield table.slice(begin)


def pack_by_retrieval(docs: DataFrame, path: str, pattern: str, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, seed) for each piece of each row of ``docs`` (doc_id, text).

    ``seed`` is the number of the row that its sequence began with.
    """
    context = docs.sparkSession.sparkContext
    table = materialize(tokenized(docs, path, pattern), "tokens")
    total, words, holding = statistics(table)
    idf = np.where(holding > 1, inverse_frequency(holding, total), 0.0)
    told = context.broadcast((Ids(path, pattern).open().begins, idf))
    rows = table.where("ids IS NOT NULL").select("row", "doc_id", "n", "ids", "terms")

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, idf = told.value
        lengths = np.zeros(1 << TERM_BITS, np.int64)
        for batch in batches:
            for part in _sized(batch):
                np.add.at(lengths, routes(*_unpacked_terms(part.column("terms")), idf, part.num_rows), part.column("n").to_numpy())
        at = np.flatnonzero(lengths)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(lengths[at])], ["term", "n"])

    (lengths,) = _dense(map_arrow(rows.select("n", "terms"), routed, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), 0)
    line = context.broadcast((np.cumsum(lengths) - lengths, lengths))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, idf), (starts, lengths) = told.value, line.value
        for batch in batches:
            for part in _sized(batch):
                route, row = routes(*_unpacked_terms(part.column("terms")), idf, part.num_rows), part.column("row").to_numpy().astype(np.uint64)
                share = ((row + np.uint64(1)) * _MIX >> np.uint64(11)).astype(np.float64) / (1 << 53)
                shards = ((starts[route] + share * lengths[route]) // shard).astype(np.int64)
                part = part.drop_columns(["terms"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shards)], [*part.schema.names, "shard"])

    def packed(group: pa.Table) -> pa.Table:
        begins, idf = told.value
        group = group.sort_by("row")
        ids, (doc, term, times) = _read(group, begins)
        sizes = [len(i) for i in ids]
        index = Index(doc, term, times, np.bincount(doc, times, len(ids)), idf, words / max(total, 1))
        pieces = fill(sizes, index.neighbours, window)
        names, numbers, base = group.column("doc_id").to_pylist(), group.column("row").to_pylist(), group.column("shard")[0].as_py() << 32
        seeds = {s: numbers[d] for d, _, _, s, o in pieces if o == 0}
        out = [(names[d], a, n, zlib.crc32(ids[d][a : a + n].astype("<u4").tobytes()), sizes[d], base + s, o, seeds[s]) for d, a, n, s, o in pieces]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], RESULT.replace(" long", "").split(", "))

    placed = map_arrow(rows, dealt, "row long, doc_id long, n long, ids binary, shard long")
    return placed.groupBy("shard").applyInArrow(packed, RESULT)


RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, seed long"
