"""Connected regions of marked pixels, in frames of any size.

Pixels are labelled inside blocks, in parallel; labels that touch across the border of two blocks are joined
by hooking and pointer jumping. A task holds the marks of one block, never those of a frame, so that a region may run through any number of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.operators.components import roots
from kinograph.sources.scratch import written

#: Rows and columns of a block.
SIDE = 64
#: A pixel's code is y * _ROW + x.
_ROW = 1 << 20


def labelled(marks: np.ndarray) -> np.ndarray:
    """The number of the first pixel of the 8-connected region of each pixel; pixels that are not marked keep the size of the grid."""
    h, w = marks.shape
    none = h * w
    labels = np.where(marks, np.arange(none).reshape(h, w), none)
    while True:
        wide = np.pad(labels, 1, constant_values=none)
        near = np.minimum.reduce([wide[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)])
        new = np.where(marks, near, none)
        # a label that has found a smaller one takes all its pixels along
        to = np.append(np.arange(none), none)
        np.minimum.at(to, labels.ravel(), new.ravel())
        new = to[new]
        if (new == labels).all():
            return labels
        labels = new


def regions(marked: DataFrame, key: str, side: int = SIDE) -> DataFrame:
    """(key, y, x, region) of 8-connected regions of ``marked`` (key, y, x; y and x below 2^20); region is the smallest y * 2^20 + x in it."""

    def label(rows: pa.Table) -> pa.Table:
        y, x = rows.column("y").to_numpy(), rows.column("x").to_numpy()
        y0, x0 = y[0] // side * side, x[0] // side * side
        marks = np.zeros((side, side), bool)
        marks[y - y0, x - x0] = True
        first = labelled(marks)
        y, x = np.nonzero(marks)
        name = first[y, x]
        codes = (y0 + name // side) * _ROW + x0 + name % side
        return pa.table([pa.array(np.full(len(y), rows.column(key)[0].as_py())), pa.array(y + y0), pa.array(x + x0), pa.array(codes)], [key, "y", "x", "label"])

    blocks = marked.select(F.col(key).cast("long"), F.col("y").cast("long"), F.col("x").cast("long")).withColumns({"by": F.floor(F.col("y") / side), "bx": F.floor(F.col("x") / side)})
    own = written(blocks.groupBy(key, "by", "bx").applyInArrow(label, f"{key} long, y long, x long, label long"), "labels")
    low = lambda c: F.col(c) % side == 0
    high = lambda c: F.col(c) % side == side - 1
    rim = own.where(low("y") | high("y") | low("x") | high("x"))
    # of two pixels that touch, one looks for the other: to the right and to the next row
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])
    looks = rim.select(key, "y", "x", F.col("label").alias("from"), F.explode(steps).alias("s")).select(key, "from", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    met = looks.join(rim, [key, "y", "x"]).where(F.col("from") != F.col("label")).select(key, "from", "label").distinct()
    # labels get a number over all keys, in the order of key and label
    pairs = written(met, "touching")
    if pairs.isEmpty():
        return own.withColumnRenamed("label", "region")
    code = lambda c: F.struct(F.col(key), F.col(c))
    nodes = pairs.select(code("from").alias("n")).union(pairs.select(code("label").alias("n"))).distinct()
    numbered = written(nodes.select(F.col(f"n.{key}").alias("of"), F.col("n.from").alias("l")).repartitionByRange("of", "l").sortWithinPartitions("of", "l").withColumn("id", F.monotonically_increasing_id()), "nodes")
    left = numbered.select(F.col("of").alias(key), F.col("l").alias("from"), F.col("id").alias("a"))
    right = numbered.select(F.col("of").alias(key), F.col("l").alias("label"), F.col("id").alias("b"))
    found = roots(pairs.join(left, [key, "from"]).join(right, [key, "label"]).select("a", "b"))
    named = found.join(right.withColumnRenamed("b", "node"), "node").join(numbered.select(F.col("id").alias("root"), F.col("l").alias("region")), "root").select(key, "label", "region")
    return own.join(named, [key, "label"], "left").select(key, "y", "x", F.coalesce("region", "label").alias("region"))
