"""Does a box cover the whole mark? Signals on a ring around it, how far they reach, and a larger box."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.functions.frames import SIDE
from kinograph.operators.edges import PERSIST_COVER, locked_edges
from kinograph.sources.scratch import written

#: A collapsed deviation, the noise floor, too much to tell, a band's least density, rounds and growth.
COLLAPSED, FLOOR, TOO_MUCH, DENSE, ROUNDS, GROWTH = 0.45, 0.004, 0.40, 0.05, 4, 4
SIDES = ("left", "right", "top", "bottom")


def pixel_signals(graded: DataFrame, threshold: float) -> DataFrame:
    """(y, x, locked, std): per pixel, whether its edge is locked, and its deviation over time."""
    stats = locked_edges(graded, threshold)
    locked = ((F.col("edge_x") > threshold) | (F.col("edge_y") > threshold)) & (F.col("persistence") >= PERSIST_COVER)
    return stats.select("y", "x", locked.alias("locked"), "std")


def ring_pixels(signals: DataFrame, boxes: DataFrame, least_std: float) -> DataFrame:
    """Pixels of each box's surroundings with marklike, side and distance; ``boxes``: (box, bx, by, bw, bh, ring)."""
    c = F.col
    # a box and its ring are unfolded to pixels, so that boxes meet signals in an equi join
    rows = boxes.withColumn("y", F.explode(F.sequence(c("by") - c("ring"), c("by") + c("bh") - 1 + c("ring"))))
    covered = rows.withColumn("x", F.explode(F.sequence(c("bx") - c("ring"), c("bx") + c("bw") - 1 + c("ring"))))
    met = signals.join(covered, ["y", "x"])
    median = met.groupBy("box").agg(F.expr("percentile(std, 0.5)").alias("median_std"))
    met = met.join(median, "box")
    in_x, in_y = c("x").between(c("bx"), c("bx") + c("bw") - 1), c("y").between(c("by"), c("by") + c("bh") - 1)
    side = F.when(in_y & (c("x") < c("bx")), "left").when(in_y & ~in_x, "right").when(in_x & (c("y") < c("by")), "top").when(in_x & ~in_y, "bottom")
    far = F.when(c("side") == "left", c("bx") - c("x")).when(c("side") == "right", c("x") - c("bx") - c("bw") + 1).when(c("side") == "top", c("by") - c("y")).when(c("side") == "bottom", c("y") - c("by") - c("bh") + 1)
    collapsed = (c("median_std") > least_std) & (c("std") < COLLAPSED * c("median_std"))
    return met.withColumns({"marklike": c("locked") | collapsed, "inside": in_x & in_y, "side": side}).withColumn("d", far)


def measure(signals: DataFrame, boxes: DataFrame, least_std: float = 0.01) -> DataFrame:
    """Per box: the flagged share of its ring, whether that tells nothing, each side's reach, a larger box."""
    ring = ring_pixels(signals, boxes, least_std).where(~F.col("inside"))
    bands = ring.where("side IS NOT NULL").groupBy("box", "side", "d").agg(F.avg(F.col("marklike").cast("int")).alias("density")).where(F.col("density") >= DENSE)
    reach = bands.groupBy("box").agg(*[F.max(F.when(F.col("side") == s, F.col("d"))).alias(f"reach_{s}") for s in SIDES])
    share = ring.groupBy("box").agg(F.avg(F.col("marklike").cast("int")).alias("fraction"))
    out = boxes.join(share, "box", "left").join(reach, "box", "left")
    flagged = F.coalesce(F.col("fraction"), F.lit(0.0)) >= FLOOR
    r = {s: F.when(flagged, F.coalesce(f"reach_{s}", F.lit(0))).otherwise(0) for s in SIDES}
    out = out.select("box", "bx", "by", "bw", "bh", "ring", F.coalesce("fraction", F.lit(0.0)).alias("fraction"), (F.coalesce("fraction", F.lit(0.0)) > TOO_MUCH).alias("inconclusive"), *[r[s].cast("long").alias(f"reach_{s}") for s in SIDES])
    left, top = F.greatest(F.col("bx") - F.col("reach_left"), F.lit(0)), F.greatest(F.col("by") - F.col("reach_top"), F.lit(0))
    right = F.least(F.col("bx") + F.col("bw") + F.col("reach_right"), F.lit(SIDE))
    bottom = F.least(F.col("by") + F.col("bh") + F.col("reach_bottom"), F.lit(SIDE))
    saturated = F.greatest(*[F.col(f"reach_{s}") for s in SIDES]) >= F.col("ring")
    return out.select("*", left.alias("sx"), top.alias("sy"), (right - left).alias("sw"), (bottom - top).alias("sh"), saturated.alias("saturated"), (F.col("fraction") < FLOOR).alias("ok"))


def grow(signals: DataFrame, boxes: DataFrame, least_std: float = 0.01) -> DataFrame:
    """Boxes enlarged to what they miss, in at most four rounds; the verdict is of the box returned."""
    signals = written(signals, "signals")  # a row per pixel of the tile, read in every round
    first = boxes.select("box", (F.col("bw") * F.col("bh")).alias("first_area"))
    for step in range(ROUNDS):
        verdict = measure(signals, boxes, least_std)
        if step == ROUNDS - 1:
            return verdict
        known = verdict.join(first, "box")
        changed = F.struct("sx", "sy", "sw", "sh") != F.struct("bx", "by", "bw", "bh")
        accept = ~F.col("ok") & ~F.col("inconclusive") & changed & (F.col("sw") * F.col("sh") <= GROWTH * F.col("first_area"))
        boxes = written(known.select("box", *[F.when(accept, F.col(s)).otherwise(F.col(b)).alias(b) for b, s in (("bx", "sx"), ("by", "sy"), ("bw", "sw"), ("bh", "sh"))], "ring"), "boxes")
    return boxes
