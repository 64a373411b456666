"""Edges that stay in place: the mean of the signed gradient keeps them and cancels what moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinograph.functions.frames import gradient_x, gradient_y
from kinograph.sources.tables import pixels

#: The shares of frames in which an edge has to stand.
PERSIST_FIND = 0.60
PERSIST_COVER = 0.85


def with_gradients(frames: DataFrame) -> DataFrame:
    """Pixels of ``frames`` (clip, t, px) with v, dx and dy, made within each row."""
    px = F.col("px")
    return pixels(frames.withColumns({"dx": gradient_x(px), "dy": gradient_y(px)}).withColumnRenamed("px", "v"), "v", "dx", "dy")


def beyond(threshold: float):
    """Whether a frame has an edge at a pixel."""
    return (F.abs("dx") > threshold) | (F.abs("dy") > threshold)


def locked_edges(graded: DataFrame, threshold: float, *keys: str) -> DataFrame:
    """Per pixel: mean signed gradients, population deviation, mean and persistence; combined before the shuffle."""
    return graded.groupBy(*keys, "y", "x").agg(
        F.abs(F.avg("dx")).alias("edge_x"),
        F.abs(F.avg("dy")).alias("edge_y"),
        F.stddev_pop("v").alias("std"),
        F.avg("v").alias("mean"),
        F.avg(beyond(threshold).cast("int")).alias("persistence"),
        F.count("*").alias("n_frames"),
    )


def sweep(graded: DataFrame, thresholds: list[float], *keys: str, persist: float = PERSIST_FIND) -> DataFrame:
    """(keys, i, threshold, y, x) of the pixels that each threshold marks; one pass for all thresholds."""
    shares = [F.avg(beyond(t).cast("int")).alias(f"p{i}") for i, t in enumerate(thresholds)]
    stats = graded.groupBy(*keys, "y", "x").agg(F.abs(F.avg("dx")).alias("ex"), F.abs(F.avg("dy")).alias("ey"), *shares)
    each = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(t).alias("threshold"), F.col(f"p{i}").alias("share")) for i, t in enumerate(thresholds)])
    marked = stats.select(*keys, "y", "x", "ex", "ey", F.explode(each).alias("s")).select(*keys, "y", "x", "ex", "ey", "s.*")
    return marked.where(((F.col("ex") > F.col("threshold")) | (F.col("ey") > F.col("threshold"))) & (F.col("share") >= persist)).select(*keys, "i", "threshold", "y", "x")


def boxes(marked: DataFrame, *keys: str) -> DataFrame:
    """The bounding box of the marked pixels of each key."""
    return marked.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        (F.max("x") - F.min("x") + 1).alias("w"),
        (F.max("y") - F.min("y") + 1).alias("h"),
    )
