"""Coverage of a mark by a box."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.operators import coverage as C
from kinograph.operators.edges import PERSIST_COVER, with_gradients
from kinograph.plans.oracle import GR
from kinograph.sources.tables import frames

EDGE, LEAST_STD = 0.006, 0.01
#: The box and rings that the queries ask about.
START, RINGS = (3, 3, 2, 2), (1, 2, 3)


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pixel_signals(with_gradients(frames(spark, sf_dir)), EDGE)


def _boxes(spark: SparkSession) -> DataFrame:
    return spark.range(len(RINGS)).select(F.col("id").alias("box"), *[F.lit(v).cast("long").alias(n) for n, v in zip(("bx", "by", "bw", "bh"), START, strict=True)], (F.col("id") + RINGS[0]).alias("ring"))


def coverage_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged share of each ring and what it says."""
    out = C.measure(_signals(spark, sf_dir), _boxes(spark), LEAST_STD)
    return out.select("box", "ring", F.round("fraction", 6).alias("fraction"), "inconclusive", "ok")


def coverage_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far marklike bands go from each side, and the box that would cover them."""
    out = C.measure(_signals(spark, sf_dir), _boxes(spark), LEAST_STD)
    return out.select("box", *[f"reach_{s}" for s in C.SIDES], "sx", "sy", "sw", "sh", "saturated")


def coverage_grow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grown box of each ring, and its own verdict."""
    out = C.grow(_signals(spark, sf_dir), _boxes(spark), LEAST_STD)
    return out.select("box", "bx", "by", "bw", "bh", F.round("fraction", 6).alias("fraction"), "inconclusive", "ok")


def coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each gate mode does with the verdict of each ring."""
    out = C.measure(_signals(spark, sf_dir), _boxes(spark), LEAST_STD).select("box", "ok", "inconclusive")
    gates = spark.createDataFrame([("strict",), ("warn",), ("off",)], "gate string")
    under = F.when(F.col("inconclusive"), "coverage_inconclusive").otherwise("coverage_under")
    outcome = F.when((F.col("gate") == "off") | F.col("ok"), "ok").when(F.col("gate") == "strict", under).otherwise(F.concat(under, F.lit("_warned")))
    return out.crossJoin(F.broadcast(gates)).select("box", "gate", outcome.alias("outcome"), ((F.col("gate") != "strict") | F.col("ok")).alias("runs"))


QUERIES = {f.__name__: f for f in (coverage_ring, coverage_reach, coverage_grow, coverage_gate)}

_SIG = f"""{GR}, sig AS (SELECT y, x, (abs(avg(dx)) > {EDGE} OR abs(avg(dy)) > {EDGE})
    AND avg(CASE WHEN abs(dx) > {EDGE} OR abs(dy) > {EDGE} THEN 1 ELSE 0 END) >= {PERSIST_COVER} AS locked, stddev_pop(v) AS std FROM gr GROUP BY y, x),
  b0 AS (SELECT i AS box, {START[0]}::BIGINT AS bx, {START[1]}::BIGINT AS by, {START[2]}::BIGINT AS bw, {START[3]}::BIGINT AS bh, i + {RINGS[0]} AS ring FROM range({len(RINGS)}) r(i))"""


def _measured(k: int) -> str:
    """CTEs that measure the boxes b<k> as v<k>."""
    return f"""o{k} AS (SELECT b.*, sig.*, median(std) OVER (PARTITION BY box) AS m FROM sig JOIN b{k} b ON x BETWEEN bx - ring AND bx + bw - 1 + ring AND y BETWEEN by - ring AND by + bh - 1 + ring),
  f{k} AS (SELECT *, locked OR (m > {LEAST_STD} AND std < {C.COLLAPSED} * m) AS marklike, x BETWEEN bx AND bx + bw - 1 AS inx, y BETWEEN by AND by + bh - 1 AS iny FROM o{k}),
  g{k} AS (SELECT box, marklike, CASE WHEN iny AND x < bx THEN 'left' WHEN iny AND NOT inx THEN 'right' WHEN inx AND y < by THEN 'top' WHEN inx AND NOT iny THEN 'bottom' END AS side,
    CASE WHEN iny AND x < bx THEN bx - x WHEN iny AND NOT inx THEN x - bx - bw + 1 WHEN inx AND y < by THEN by - y WHEN inx AND NOT iny THEN y - by - bh + 1 END AS d FROM f{k} WHERE NOT (inx AND iny)),
  s{k} AS (SELECT box, avg(marklike::INT) AS fraction FROM g{k} GROUP BY box),
  h{k} AS (SELECT box, side, d FROM g{k} WHERE side IS NOT NULL GROUP BY ALL HAVING avg(marklike::INT) >= {C.DENSE}),
  r{k} AS (SELECT b.*, coalesce(fraction, 0) AS fraction, {', '.join(f"CASE WHEN fraction >= {C.FLOOR} THEN coalesce((SELECT max(d) FROM h{k} h WHERE h.box = b.box AND side = '{s}'), 0) ELSE 0 END AS reach_{s}" for s in C.SIDES)}
    FROM b{k} b LEFT JOIN s{k} s ON s.box = b.box),
  v{k} AS (SELECT *, fraction > {C.TOO_MUCH} AS inconclusive, fraction < {C.FLOOR} AS ok, greatest(reach_left, reach_right, reach_top, reach_bottom) >= ring AS saturated,
    greatest(bx - reach_left, 0) AS sx, greatest(by - reach_top, 0) AS sy, least(bx + bw + reach_right, 8) - greatest(bx - reach_left, 0) AS sw,
    least(by + bh + reach_bottom, 8) - greatest(by - reach_top, 0) AS sh FROM r{k})"""


def _grown(k: int) -> str:
    yes = f"NOT ok AND NOT inconclusive AND (sx, sy, sw, sh) <> (bx, by, bw, bh) AND sw * sh <= {C.GROWTH * START[2] * START[3]}"
    return f"b{k + 1} AS (SELECT box, " + ", ".join(f"CASE WHEN {yes} THEN {s} ELSE {b} END AS {b}" for b, s in (("bx", "sx"), ("by", "sy"), ("bw", "sw"), ("bh", "sh"))) + f", ring FROM v{k})"


_ONE = f"WITH {_SIG}, {_measured(0)}"
ORACLES = {
    "coverage_ring": f"{_ONE} SELECT box, ring, round(fraction, 6) AS fraction, inconclusive, ok FROM v0",
    "coverage_reach": f"{_ONE} SELECT box, reach_left, reach_right, reach_top, reach_bottom, sx, sy, sw, sh, saturated FROM v0",
    "coverage_grow": f"WITH {_SIG}, {', '.join([_measured(0)] + [f'{_grown(k)}, {_measured(k + 1)}' for k in range(C.ROUNDS - 1)])} SELECT box, bx, by, bw, bh, round(fraction, 6) AS fraction, inconclusive, ok FROM v{C.ROUNDS - 1}",
    "coverage_gate": f"""{_ONE} SELECT box, gate, CASE WHEN gate = 'off' OR ok THEN 'ok' ELSE CASE WHEN inconclusive THEN 'coverage_inconclusive' ELSE 'coverage_under' END
      || CASE WHEN gate = 'strict' THEN '' ELSE '_warned' END END AS outcome, gate <> 'strict' OR ok AS runs FROM v0, (VALUES ('strict'), ('warn'), ('off')) g(gate)""",
}

#: ``by`` is a keyword there.
ORACLES = {name: re.sub(r"\bby\b", '"by"', text) for name, text in ORACLES.items()}
