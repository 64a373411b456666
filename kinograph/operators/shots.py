"""Shots, segments with context, and as-of lookups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from kinograph.sources.scratch import written


#: Jumps of each length, from one to the last but one, that a round makes; positions of a stretch.
_FAN, STRETCH = 4, 1 << 16


def _chains(key: str, least: int, entered: bool):
    """Over the cuts of one stretch of a key: where the greedy choice from each cut ends inside it, or, if ``entered``, what it keeps from the entry on."""

    def chains(rows: pa.Table) -> pa.Table:
        at = np.unique(rows.column("at").to_numpy())
        after = np.searchsorted(at, at + least)
        if entered:
            i, kept = int(np.searchsorted(at, rows.column("entry")[0].as_py())), []
            while i < len(at):
                kept.append(at[i])
                i = after[i]
            return pa.table([pa.array([rows.column(key)[0].as_py()] * len(kept), pa.int64()), pa.array(kept, pa.int64())], [key, "at"])
        last = at.copy()
        for i in np.flatnonzero(after < len(at))[::-1]:
            last[i] = last[after[i]]
        return pa.table([pa.array([rows.column(key)[0].as_py()] * len(at), pa.int64()), pa.array(at), pa.array(last)], [key, "at", "last"])

    return chains


def thinned(cuts: DataFrame, key: str, at: str, least: int, stretch: int = STRETCH) -> DataFrame:
    """(key, at): 0 and the cuts that a greedy choice keeps: of those beyond the last kept one by ``least`` or more, the first.

    Each cut points to the first one ``least`` or more after it, and what 0 reaches is kept. Chains are shortened inside stretches of
    positions first, each in its own task; then pointers from stretch to stretch are jumped along, and a stretch that
    was entered gives what the choice keeps there. A key, however long, is many tasks.
    """
    nodes = cuts.where(F.col(at) > 0).select(key, F.col(at).cast("long").alias("at")).unionByName(cuts.select(key, F.lit(0).cast("long").alias("at")).distinct())
    nodes = nodes.withColumn("stretch", F.floor(F.col("at") / stretch))
    entries = nodes.where("at = 0").select(key, "stretch", F.col("at").alias("entry"))
    if not nodes.where("stretch > 0").isEmpty():
        ends = nodes.groupBy(key, "stretch").applyInArrow(_chains(key, least, False), f"{key} long, at long, last long")
        entries = _jumped(written(ends, "ends"), key, least).select(key, F.floor(F.col("at") / stretch).alias("stretch"), F.col("at").alias("entry"))
    return nodes.join(entries, [key, "stretch"]).groupBy(key, "stretch").applyInArrow(_chains(key, least, True), f"{key} long, at long")


def _jumped(ends: DataFrame, key: str, least: int) -> DataFrame:
    """(key, at) of the cuts at which the chain from 0 enters a stretch.

    A round knows of the first n entries, and of pointers over n; jumps of n, 2n and 3n find the first 4n. Pointers of
    cuts near the end fall off on the way, so that tables shrink, and rounds grow with the logarithm of the stretches.
    """
    # probes and cuts in one line, read backwards: the last cut seen is the first at or after a probe
    probes = ends.select(key, (F.col("last") + least).alias("pos")).distinct().withColumn("cut", F.lit(None).cast("long"))
    line = probes.unionByName(ends.select(key, F.col("at").alias("pos"), F.col("at").alias("cut")))
    back = Window.partitionBy(key).orderBy(F.desc("pos"), F.col("cut").isNull())
    met = line.withColumn("to", F.last("cut", ignorenulls=True).over(back)).where("cut IS NULL AND to IS NOT NULL").select(key, (F.col("pos") - least).alias("last"), "to")
    step = written(ends.join(met, [key, "last"]).select(key, "at", "to"), "pointers")
    kept = written(ends.where("at = 0").select(key, "at"), "entries")

    def after(reached: DataFrame, pointers: DataFrame) -> DataFrame:
        """Pointers of ``reached`` (key, at, to) made longer by ``pointers``."""
        return reached.join(pointers.select(key, F.col("at").alias("to"), F.col("to").alias("end")), [key, "to"]).select(key, "at", F.col("end").alias("to"))

    while not step.isEmpty():
        found, longer = kept, step
        for _ in range(_FAN - 1):
            found = found.unionByName(kept.join(longer, [key, "at"]).select(key, F.col("to").alias("at")))
            longer = after(longer, step)
        kept, step = written(found, "entries"), written(longer, "pointers")
    return kept


def segments(bounds: DataFrame, totals: DataFrame, key: str, least: int, segment: int, overlap: int) -> DataFrame:
    """(key, total, s, e, left, right): shots between ``bounds`` (key, at) and the end, cut into bodies of at most ``segment``, with context inside the shot.

    A last shot that is too short joins the one before it; ``totals`` has (key, total).
    """
    inside = bounds.join(totals, key).where((F.col("at") < F.col("total")) & ((F.col("at") == 0) | (F.col("total") - F.col("at") >= least)))
    shots = inside.select(key, "total", F.col("at").alias("a"), F.coalesce(F.lead("at").over(Window.partitionBy(key).orderBy("at")), "total").alias("b"))
    bodies = shots.withColumn("s", F.explode(F.sequence("a", F.col("b") - 1, F.lit(segment).cast("long"))))
    bodies = bodies.withColumn("e", F.least(F.col("s") + segment, F.col("b")))
    reach = F.lit(overlap).cast("long")
    return bodies.select(key, "total", "s", "e", F.least(reach, F.col("s") - F.col("a")).alias("left"), F.least(reach, F.col("b") - F.col("e")).alias("right"))


def islands(df: DataFrame, key: str, order: list[str], inside: Column) -> DataFrame:
    """Runs of rows that satisfy ``inside``: key, first and last position, length."""
    w = Window.partitionBy(key).orderBy(*order)
    numbered = df.select(key, *order, inside.alias("inside")).withColumn("i", F.row_number().over(w).cast("long") - 1)
    runs = numbered.where("inside").withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(key).orderBy("i")))
    return runs.groupBy(key, "run").agg(F.min("i").alias("first"), (F.max("i") + 1).alias("until"), F.count("*").alias("length")).drop("run")


class ShotStarts:
    """Of a clip's rows (key, is it a cut, is it black) in order: where shots begin, at cuts and where a black run of ``LEAST_BLACK`` frames ends, each once.

    It holds a place and the length of a run, whatever the clip's. A clip whose rows hold no frame is an error: nothing found and nothing looked at are not the same.
    """

    LEAST_BLACK = 2

    def __init__(self):
        self.key, self.at, self.black = None, 0, 0

    def eval(self, row: Row) -> Iterator[tuple]:
        key, cut, black = row[:3]
        self.key = key
        if cut is None and black is None:  # no frame
            return
        ended = not black and self.black >= self.LEAST_BLACK
        self.black = self.black + 1 if black else 0
        if cut or ended:
            yield key, self.at
        self.at += 1

    def terminate(self) -> Iterator[tuple]:
        if self.at == 0:
            raise ValueError(f"clip {self.key} has no frames")
        if self.black >= self.LEAST_BLACK:
            yield self.key, self.at


def shot_starts(marks: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, bound) of ``marks`` (key, order, cut, black), by a table function over each key's rows in order."""
    function = F.udtf(ShotStarts, returnType=f"{key} long, bound long")
    return function(marks.select(key, "cut", "black", *order).asTable().partitionBy(key).orderBy(*order))
