"""The tables as the engine sees them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinograph.functions.frames import SIDE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views for SQL."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, t, px): embeddings as 8 x 8 frames of doubles."""
    rows = table(spark, sf_dir, "embeddings")
    whole = (F.size("embedding") == SIDE * SIDE) & ~F.exists("embedding", lambda v: v.isNull())
    return rows.where(whole).select(F.col("label").cast("long").alias("clip"), F.col("vec_id").alias("t"), F.col("embedding").cast("array<double>").alias("px"))


def pixels(frames: DataFrame, *arrays: str) -> DataFrame:
    """One row per pixel: all other columns of ``frames``, y, x and a column for each array."""
    rest = [c for c in frames.columns if c not in arrays]
    zipped = frames.select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias("p", "v"))
    return zipped.select(*rest, (F.col("p").cast("long") - F.col("p") % SIDE).alias("y0"), (F.col("p") % SIDE).cast("long").alias("x"), "v.*").withColumn("y", (F.col("y0") / SIDE).cast("long")).drop("y0")
