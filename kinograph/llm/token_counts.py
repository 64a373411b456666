"""Token counts by a Viterbi search that only counts.

The vocabulary is a unigram one: pieces with scores. An Aho-Corasick automaton gives all pieces that end
at each character of a word; dynamic programming carries the best score up to there and the number of
tokens on its path, never the path. Ties go, as in the exact tokenizer, to the earliest start, that is
the longest last piece; a character that is no piece costs ten less than the worst score and becomes
its UTF-8 bytes. Words begin at spaces (U+2581 counts as one), pieces never cross them, and a
worker remembers words that it has counted. Short words of known characters are counted many at a time,
a step for each byte; others one by one.

The exact tokenizer is the unigram model of the ``tokenizers`` library with byte fallback over a Metaspace
split, with the same pieces and scores; the tests hold the counts against it.

Defined results: a null or empty text has no tokens; repeated rows are counted each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.llm.common import map_arrow, slices

#: The vocabulary that queries use; the path is a parameter everywhere.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers.
MEMO = 300_000
#: Characters of the words that are counted together and remembered.
SHORT = 64


def load_vocabulary(path: str = VOCABULARY) -> tuple:
    """The (piece, score) pairs of a sentencepiece file, the unknown piece first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple((model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()))


class Automaton:
    """An Aho-Corasick automaton over UTF-8 bytes as arrays, which counts the tokens of many words at once.

    ``lengths`` and ``scores`` list, for each state, the pieces that end there, the longest first, in a
    narrow and in a wide table. A state with more than fit is marked; words that meet it are counted again with
    the wide table, or one by one.
    """

    FEW, MOST = 4, 16

    def __init__(self, vocabulary: tuple, unknown: str):
        pieces = [(p.encode(), s) for p, s in vocabulary]
        used = sorted({b for p, _ in pieces for b in p})
        self.classes = np.zeros(256, np.uint8)
        self.classes[used] = np.arange(1, len(used) + 1)
        parent, by, depth, ends, special = self._trie(pieces, unknown.encode())
        states, own = len(parent), np.fromiter(ends.keys(), np.int64)
        length, score = np.zeros(states, np.int64), np.full(states, -np.inf)
        length[own], score[own] = np.array([v[0] for v in ends.values()]), np.array([v[1] for v in ends.values()])
        kind = np.min_scalar_type(states)  # the table is by far the largest part of a counter
        self.goto, fail = np.zeros((states, len(used) + 1), kind), np.zeros(states, kind)
        self.lengths, self.scores = np.zeros((states, self.MOST), np.int64), np.full((states, self.MOST), -np.inf)
        self.marked = np.zeros(states, bool)
        self.marked[special] = True  # the unknown piece itself
        levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1])
        for level, kids in zip(levels, [*levels[1:], np.empty(0, np.int64)], strict=True):
            if depth[level[0]]:
                back = fail[level]
                self.goto[level] = self.goto[back]
                self.lengths[level], self.scores[level] = self.lengths[back], self.scores[back]
                self.marked[level] |= self.marked[back]
                new, back = level[length[level] > 0], back[length[level] > 0]
                self.marked[new] |= self.lengths[back, -1] > 0
                self.lengths[new, 1:], self.scores[new, 1:] = self.lengths[back, :-1], self.scores[back, :-1]
                self.lengths[new, 0], self.scores[new, 0] = length[new], score[new]
                fail[kids] = self.goto[fail[parent[kids]], by[kids]]
            self.goto[parent[kids], by[kids]] = kids
        self.wide = self.lengths, self.scores, self.marked
        self.narrow = tuple(np.ascontiguousarray(t[:, : self.FEW]) for t in self.wide[:2]) + (self.marked | (self.lengths[:, self.FEW] > 0),)

    def _trie(self, pieces: list, unknown: bytes) -> tuple:
        child, parent, by, depth, ends, special = {}, [0], [0], [0], {}, []
        for piece, score in pieces:
            state = 0
            for b in piece:
                c = int(self.classes[b])
                at = child.get((state, c))
                if at is None:
                    at = child[state, c] = len(parent)
                    parent.append(state)
                    by.append(c)
                    depth.append(depth[state] + 1)
                state = at
            if piece:
                ends[state] = (len(piece), score)
            if piece == unknown:
                special.append(state)
        return np.array(parent), np.array(by), np.array(depth), ends, special

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word; -1 where it has to be counted otherwise: pieces alone do not make it up, or it is marked."""
        out = self._count(words, *self.narrow)
        again = np.flatnonzero(out < 0).tolist()
        if again:
            out[again] = self._count([words[i] for i in again], *self.wide)
        return out

    def _count(self, words: list[bytes], lengths: np.ndarray, scores: np.ndarray, marked: np.ndarray) -> np.ndarray:
        sizes = np.array([len(w) for w in words])
        order = np.argsort(-sizes, kind="stable")
        sizes, most = sizes[order], int(sizes.max())
        data = self.classes[np.frombuffer(b"".join(words[i].ljust(most, b"\0") for i in order.tolist()), np.uint8).reshape(len(words), most)]
        best, tokens = np.full((len(words), most + 1), -np.inf), np.zeros((len(words), most + 1), np.int32)
        best[:, 0] = 0
        state, otherwise, rows = np.zeros(len(words), self.goto.dtype), np.zeros(len(words), bool), np.arange(len(words))
        for end in range(1, most + 1):
            n = int(np.searchsorted(-sizes, -end, "right"))  # the words that are that long come first
            s = state[:n] = self.goto[state[:n], data[:n, end - 1]]
            otherwise[:n] |= marked[s]
            start = end - lengths[s]
            sums = best[rows[:n, None], start] + scores[s]
            top = sums.argmax(1)  # the first of equals is the longest piece
            best[:n, end] = sums[rows[:n], top]
            tokens[:n, end] = tokens[rows[:n], start[rows[:n], top]] + 1
        out = np.empty(len(words), np.int64)
        out[order] = np.where(otherwise | np.isneginf(best[rows, sizes]), -1, tokens[rows, sizes])
        return out


class Counter:
    """Counts tokens of texts under a vocabulary whose piece number ``unknown`` is the unknown one.

    It travels as its vocabulary and is built again where it arrives.
    """

    def __init__(self, vocabulary: tuple, unknown: int = 0):
        self.made_of = vocabulary, unknown
        self.automaton = ahocorasick.Automaton()
        self.unknown = vocabulary[unknown][0]
        self.single = frozenset(p for p, _ in vocabulary if len(p) == 1)
        self.worst = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score, piece == self.unknown))
        self.automaton.make_automaton()
        self.arrays = Automaton(vocabulary, self.unknown)
        # with scores of at most 0 an unknown character never beats a piece that holds it
        self.cuts_lines = not any("\n" in p for p, _ in vocabulary)
        self.plain = SPACE in self.single and max(s for _, s in vocabulary) <= 0
        self.memo: dict = {}

    def __getstate__(self):
        return self.made_of

    def __setstate__(self, state):
        self.__init__(*state)

    def word(self, word: str) -> tuple[int, float]:
        """Tokens and score of one word, its leading space mark included."""
        n = len(word)
        # at each end: score, tokens of closed pieces, bytes of the run of unknown pieces before it, whether it is the unknown piece itself
        best: list = [(0.0, 0, 0, False)] + [None] * n
        pieces, at, end = self.automaton.iter(word), 0, -1
        found: list = []
        for end, piece in [*pieces, (n, None)]:
            while at <= min(end, n - 1) and (at < end or piece is None):
                best[at + 1] = self._best(word, best, at, found)
                found, at = [], at + 1
            if piece is not None:
                found.append(piece)
        score, tokens, run, alone = best[n]
        return tokens + (1 if alone else run), score

    def _best(self, word: str, best: list, at: int, found: list) -> tuple:
        top = None
        for length, score, unknown in sorted(found, reverse=True) if len(found) > 1 else found:
            before = best[at + 1 - length]
            if top is None or before[0] + score > top[0]:
                top = (before[0] + score, before, unknown)
        if word[at] not in self.single and (top is None or best[at][0] + self.worst > top[0]):
            score, tokens, run, _ = best[at]
            return (score + self.worst, tokens, run + len(word[at].encode()), False)
        score, (_, tokens, run, alone), unknown = top
        if unknown:
            return (score, tokens, run + len(self.unknown.encode()), run == 0)
        return (score, tokens + (1 if alone else run) + 1, 0, False)

    def words(self, words: list[str]) -> np.ndarray:
        """Tokens of each word, a space mark put before it; of what follows a line end, with its token."""
        cut = self.cuts_lines
        marked = [w[1:] if cut and w[:1] == "\n" else SPACE + w for w in words]
        out = np.array([-1 if w else 0 for w in marked], np.int64)
        short = [k for k, w in enumerate(marked) if 0 < len(w) <= SHORT] if self.plain else []
        for i in range(0, len(short), 10_000):
            some = short[i : i + 10_000]
            out[some] = self.arrays.count([marked[k].encode() for k in some])
        for k in np.flatnonzero(out < 0).tolist():
            out[k] = self.word(marked[k])[0]
        return out + np.array([len(m) < len(w) for m, w in zip(marked, words, strict=True)], np.int64)

    def split(self, text: str | None) -> list[str]:
        """The words of a text. Where no piece holds a line end, it is a token by itself and begins a word of its own."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        begins = text[0] == " "
        words = (text.replace("\n", " \n") if self.cuts_lines else text).split(" ")
        return words[1:] if begins else words

    def texts(self, texts: list) -> np.ndarray:
        """Tokens of whole texts; None has none."""
        memo, of = self.memo, []
        if len(memo) > MEMO:
            memo.clear()
        extra = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text and self.cuts_lines and self.unknown in text and "\n" in text:  # a run of unknown pieces may cross a line end
                plain = text.replace(SPACE, " ")
                extra[i] = sum(self.word(SPACE + w)[0] for w in plain.split(" ")[plain[0] == " " :])
                text = None
            of.append(self.split(text))
        words, sizes = list(chain.from_iterable(of)), np.array([len(w) for w in of])
        tokens = np.fromiter(map(memo.get, words, repeat(-1)), np.int64, len(words))
        miss = np.flatnonzero(tokens < 0).tolist()
        new = list(dict.fromkeys([words[i] for i in miss]))
        found = dict(zip(new, self.words(new).tolist(), strict=True))
        tokens[miss] = [found[words[i]] for i in miss]
        memo.update(found if max(map(len, new), default=0) <= SHORT else {w: n for w, n in found.items() if len(w) <= SHORT})
        ends = np.concatenate([[0], np.cumsum(tokens)])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        return ends[bounds[1:]] - ends[bounds[:-1]] + extra


def count_tokens(docs: DataFrame, vocabulary: tuple, *columns: str) -> DataFrame:
    """(doc_id, n_tokens) and ``columns`` for each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(Counter(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            tokens = shared.value.texts(batch.column("text").to_pylist())
            kept = batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(tokens, pa.int64())], [*kept.schema.names, "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *columns)
    kept = rows.drop("text")
    return map_arrow(rows, count, ", ".join(f"`{n}` {t}" for n, t in kept.dtypes) + ", n_tokens long")
