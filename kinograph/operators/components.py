"""Connected components of a graph by hooking and pointer jumping, each round on tables that outlive executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.sources.scratch import written


def roots(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of ``edges`` (a, b: long); the root is a component's smallest node. Rounds grow with the logarithm of the longest path."""
    edges = written(_ordered(edges), "edges")
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = jumped(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("next")))
        to = hooks.select(F.col("node").alias("k"), F.col("next").alias("r"))
        moved = edges.join(to, F.col("a") == F.col("k")).select(F.col("r").alias("a"), "b").join(to, F.col("b") == F.col("k")).select("a", F.col("r").alias("b"))
        edges = written(_ordered(moved), "edges")
        new = hooks.select("node", F.col("next").alias("root")).join(found.select("node"), "node", "left_anti")
        found = written(found.join(to, F.col("root") == F.col("k"), "left").select("node", F.coalesce("r", "root").alias("root")).unionByName(new), "roots")
    return found


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def jumped(pointers: DataFrame) -> DataFrame:
    """``pointers`` (node, next) with each pointer at the end of its chain; a node that points to itself ends one."""
    pointers = written(pointers, "pointers")
    while True:
        up = pointers.select(F.col("node").alias("k"), F.col("next").alias("n"))
        shorter = written(pointers.join(up, F.col("next") == F.col("k")).select("node", F.col("n").alias("next"), (F.col("n") != F.col("next")).alias("moved")), "pointers")
        pointers = shorter.drop("moved")
        if shorter.where("moved").isEmpty():
            return pointers
