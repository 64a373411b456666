"""Connected components by hooking and pointer jumping, on tables in the shared folder.

Each round hooks every node to its smallest neighbour, shortens the pointers by doubling until
they reach a root, and contracts the edges to their roots. Rounds and doublings grow with the
logarithm of the largest component. Every table is written and read back, so lost executors cost
one step, and every join reads two plain tables, so that Spark can split a key that many rows share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.llm.common import drop, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the component's smallest node.

    Loops, repeated edges and nulls do no harm: a loop adds nothing, an edge with a null end is no edge.
    """
    spark = edges.sparkSession
    edges = materialize(_ordered(edges, "a", "b"), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        hooked = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p"))
        parents = _compressed(materialize(hooked, "hooks"))
        to = parents.select(F.col("u").alias("k"), F.col("p").alias("q"))
        moved = edges.join(to, edges.a == to.k).select(F.col("q").alias("a"), "b")
        moved = moved.join(to, moved.b == to.k).select("a", F.col("q").alias("b"))
        contracted = materialize(_ordered(moved, "a", "b"), "edges")
        if labels is None:
            labels = parents.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            old = labels
            labels = materialize(old.join(to, old.root == to.k, "left").select("node", F.coalesce("q", "root").alias("root")), "labels")
        drop(spark, edges.scratch)
        edges = contracted
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def _ordered(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _compressed(parents: DataFrame) -> DataFrame:
    while True:
        up = parents.select(F.col("u").alias("k"), F.col("p").alias("q"))
        shorter = materialize(parents.join(up, parents.p == up.k).select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "hooks")
        drop(parents.sparkSession, parents.scratch)
        if shorter.where("moved").isEmpty():
            return shorter.drop("moved")
        parents = shorter.drop("moved")
        parents.scratch = shorter.scratch
