"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words and the words' beginnings of 3 to 8 characters, hashed to 2^26 bins, present or
not. A G-test on the training sample picks the bins that go with the label, by themselves or, among the most frequent, in pairs; the machine learns
a weight for each and a short vector, whose products weigh pairs (an insult with a group, a word that
is harmless beside another). Learning takes labelled rows up to a documented bound, chosen by a hash of
their ids; scoring reads every text whole. Tasks find and count the bins; the driver gets the chosen
bins and, for each row of the sample, which of them it has.

Defined results: a null text has no terms; several labels of one doc_id count as the largest, a null
label as none; without training rows every score is 0; repeated rows are scored each; a null
doc_id is scored and never learned from; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinograph.llm.common import map_arrow, materialize, slices

#: Labelled rows that the machine learns from at most.
SAMPLE_ROWS = 12_000
#: Bins that it has weights for, those of the largest G, and the positive rows and the G that a bin needs.
TERMS = 2048
LEAST_ROWS, LEAST_G = 3, 12.0
#: Most frequent bins whose pairs are tested, and the G, beyond that of its two bins, that a pair needs.
FREQUENT, LEAST_PAIR_G = 512, 40.0
FACTORS = 8
STEPS = 300
BINS = 1 << 26
_WORD = re.compile(r"\w+")
_CACHE = 300_000


def word_bins(word: str) -> list[int]:
    """The bins of a word and of its beginnings."""
    return [zlib.crc32(t.encode()) % BINS for t in (word + "$", *(word[:n] for n in range(3, min(len(word), 8) + 1)))]


def text_words(text: str | None) -> set[str]:
    """The distinct words of a text, in lower case."""
    return set(_WORD.findall((text or "").lower()))


@dataclass
class Machine:
    """A fitted model: bins to rows of ``weights`` and ``factors``, and a bias."""

    bins: dict
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def __post_init__(self):
        self.known = {}

    def __getstate__(self):
        return self.bins, self.weights, self.factors, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def terms(self, text: str | None) -> set[int]:
        """The rows of the terms that ``text`` has."""
        known, found = self.known, set()
        if len(known) > _CACHE:
            known.clear()
        for word in text_words(text):
            rows = known.get(word)
            if rows is None:
                rows = known[word] = [self.bins[b] for b in word_bins(word) if b in self.bins] or ()
            if rows:
                found.update(rows)
        return found

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of the label for each text; all pairs of its terms weigh in, by sums of squares."""
        rows = [sorted(self.terms(t)) for t in texts]
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        flat = np.array([i for r in rows for i in r], np.int64)
        total = lambda values: np.bincount(owner, values, len(rows))
        z = self.bias + total(self.weights[flat])
        for f in range(self.factors.shape[1]):
            v = self.factors[flat, f].astype(np.float64)
            z += 0.5 * (total(v) ** 2 - total(v * v))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, label, bins) for ``rows`` labelled documents at most, none of them held out; written."""
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(remainder(5) != 0)
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.col("text").cast("string")).alias("text"), (F.max("toxic") > 0).alias("label"))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            found = [sorted({b for w in text_words(t) for b in word_bins(w)}) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "label", "bins"])

    return materialize(map_arrow(own.select(F.col("doc_id").cast("long"), "label", "text"), bins, "doc_id long, label boolean, bins array<int>"), "sample")


def choose_bins(rows: DataFrame, terms: int = TERMS) -> list[int]:
    """The bins of ``rows`` (label, bins) that go with the label most, ``terms`` at most, sorted."""
    positives, total = rows.agg(F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0)), F.count("*")).first()
    counts = rows.select(F.explode("bins").alias("bin"), F.col("label").cast("long").alias("hit")).groupBy("bin").agg(F.sum("hit").alias("k"), F.count("*").alias("n"))
    best = counts.where(F.col("k") >= LEAST_ROWS).withColumn("g", g_test(F.col("k"), F.col("n"), positives, total)).where(F.col("g") >= LEAST_G)
    return sorted(r.bin for r in best.orderBy(F.desc(F.round("g", 6)), "bin").limit(terms).collect())


def g_test(k, n, positives: int, rows: int):
    """Likelihood ratio of the label in rows with and without a bin: ``k`` of the ``n`` rows with it have the label."""
    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    m, negatives = rows - n, rows - positives
    return 2 * (part(k, n * positives / rows) + part(n - k, n * negatives / rows) + part(positives - k, m * positives / rows) + part(m - (positives - k), m * negatives / rows))


def _held(rows: DataFrame, bins: list[int]) -> pa.Table:
    """(doc_id, label, own): which of ``bins`` (sorted) each row has, in the order of the ids; bounded as the sample is."""
    chosen = np.array(bins, np.int32)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.flatnonzero(np.isin(chosen, b, assume_unique=True)) for b in batch.column("bins").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(own, pa.list_(pa.int32()))], ["doc_id", "label", "own"])

    return map_arrow(rows, rows_of, "doc_id long, label boolean, own array<int>").toArrow().sort_by("doc_id")


def _matrix(held: pa.Table, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by bins, and the labels."""
    x = np.zeros((held.num_rows, bins), np.float32)
    if held.num_rows:
        own = held.column("own").combine_chunks()
        x[np.repeat(np.arange(len(x)), own.value_lengths().to_numpy()), own.flatten().to_numpy()] = 1
    return x, held.column("label").to_numpy().astype(np.float32)


def pair_bins(rows: DataFrame, frequent: int = FREQUENT) -> list[int]:
    """The bins of pairs that go with the label far more than either does: a word that is harmless alone, and one that is harmless without it.

    Pairs are those of the ``frequent`` bins that most rows have and some rows lack.
    """
    total = rows.count()
    counts = rows.select(F.explode("bins").alias("bin")).groupBy("bin").agg(F.count("*").alias("n")).where(f"n >= {LEAST_ROWS} AND n < {total}")
    bins = sorted(r.bin for r in counts.orderBy(F.desc("n"), "bin").limit(frequent).collect())
    if not bins:
        return []
    x, y = _matrix(_held(rows, bins), len(bins))
    gain = pair_gains(x.astype(np.float64), y.astype(np.float64))
    return [bins[i] for i in np.flatnonzero(gain.max(axis=1) >= LEAST_PAIR_G)]


def pair_gains(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each two columns of ``x`` (0 or 1), G of the label ``y`` over the four kinds of rows, less G over either column alone, those added up."""

    def g(both: np.ndarray, hits: np.ndarray) -> np.ndarray:
        out = np.zeros(both.shape)
        for seen, share in ((hits, y.mean()), (both - hits, 1 - y.mean())):
            ok = (seen > 0) & (both > 0)
            out[ok] += 2 * seen[ok] * np.log(seen[ok] / (both[ok] * share))
        return out

    z = 1 - x
    cells = sum(g(a.T @ b, a.T @ (b * y[:, None])) for a in (x, z) for b in (x, z))
    alone = sum(g(a.sum(0), a.T @ y) for a in (x, z))
    return cells - alone[:, None] - alone[None, :]


def fit(rows: DataFrame, terms: int = TERMS, factors: int = FACTORS, steps: int = STEPS) -> Machine | None:
    """The machine for ``rows`` (doc_id, label, bins); None without rows."""
    best = choose_bins(rows, terms)
    best = sorted({*best, *pair_bins(rows)})
    held = _held(rows, best)
    if not held.num_rows:
        return None
    x, y = _matrix(held, len(best))
    prior = (y.sum() + 0.5) / (len(y) + 1)
    weights, vectors, bias = _learn(x, y, float(np.log(prior / (1 - prior))), factors, steps)
    return Machine({b: i for i, b in enumerate(best)}, weights, vectors, bias)


def _learn(x, y, bias, factors, steps):
    """Logistic loss, all rows at once, by Adam."""
    rng = np.random.default_rng(7)
    p = {"w": np.zeros(x.shape[1], np.float32), "v": rng.normal(0, 0.02, (x.shape[1], factors)).astype(np.float32), "b": np.float32(bias)}
    mean, square = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    decay = {"w": 1e-4, "v": 1e-3, "b": 0}
    for step in range(1, steps + 1):
        s = x @ p["v"]
        z = p["b"] + x @ p["w"] + 0.5 * ((s**2).sum(1) - x @ (p["v"] ** 2).sum(1))
        d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        grad = {"w": d @ x, "b": d.sum(), "v": x.T @ (d[:, None] * s) - (d @ x)[:, None] * p["v"]}
        for k in p:
            g = grad[k] + decay[k] * p[k]
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.999 * square[k] + 0.001 * g * g
            p[k] = p[k] - 0.05 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return p["w"], p["v"], float(p["b"])


def remainder(modulus: int):
    """crc32 of the doc_id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def fit_labels(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Machine | None:
    """The machine for the labelled rows of ``docs`` that are not held out, ``rows`` of them at most."""
    return fit(sample(docs, labels, rows))


def _scored(df: DataFrame, text: str, keep: str, machine: Machine | None, schema) -> DataFrame:
    """The column ``keep`` of each row, and the score of its column ``text``."""
    shared = df.sparkSession.sparkContext.broadcast(machine)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 4 << 20):
            model, texts = shared.value, batch.column(text).to_pylist()
            found = model.scores(texts) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(found, pa.float64())], [keep, "score"])

    return map_arrow(df, scores, schema)


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """(doc_id, score) for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _scored(rows, "text", "doc_id", machine, "doc_id long, score double")


def drop_toxic(docs: DataFrame, machine: Machine | None, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``least`` or more: judged where they are read, nothing is joined."""
    rows = docs.select(F.struct("*").alias("doc"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc", rows.schema["doc"].dataType), T.StructField("score", T.DoubleType())])
    kept = _scored(rows, "text", "doc", machine, schema).where(F.col("score") < least)
    return kept.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
