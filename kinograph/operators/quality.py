"""Quality of processed frames against their originals, and outliers in series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: PSNR limits outside and inside a box, scale of the median deviation, outlier limit.
OUTSIDE_DB, INSIDE_DB, MAD_SCALE, OUTLIER = 38.0, 40.0, 1.4826, 6.0


def psnr(mse: Column, peak: float) -> Column:
    """Decibels; infinite where nothing differs or nothing was compared."""
    return F.when(F.coalesce(mse, F.lit(0.0)) <= 1e-9, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(peak * peak) / mse))


#: Ranks around the middle, as a share, within which the exact median is looked for, and the sketch's accuracy.
_AROUND, _ACCURACY = 0.001, 10_000


def medians(df: DataFrame, value, *keys: str) -> DataFrame:
    """(keys, median): the exact median of ``value`` in each key, the mean of the middle two where they are two.

    A sketch, combined before the shuffle, bounds the middle of each key. All below it are one count, and values between the bounds
    are counted, not gathered: a value that many rows share, at the middle or not, is one row of the running count that finds the rank. Nulls do not count.
    """
    rows = df.select(*keys, value.cast("double").alias("of_median")).where("of_median IS NOT NULL")
    sketch = F.percentile_approx("of_median", [0.5 - _AROUND, 0.5 + _AROUND], _ACCURACY)
    bounds = rows.groupBy(*keys).agg(sketch.alias("bounds"), F.count("*").alias("n"))
    both = rows.join(bounds, list(keys)) if keys else rows.crossJoin(F.broadcast(bounds))
    low, high = F.col("bounds")[0], F.col("bounds")[1]
    level = F.when(F.col("of_median") < low, F.lit(float("-inf"))).otherwise(F.col("of_median"))
    counted = both.where(F.col("of_median") <= high).groupBy(*keys, level.alias("level")).agg(F.count("*").alias("c"), F.any_value("n").alias("n"))
    upto = counted.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys).orderBy("level")))
    at = lambda rank: F.max(F.when((F.col("upto") - F.col("c") <= rank) & (rank < F.col("upto")), F.col("level")))
    middle = (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2
    return upto.groupBy(*keys).agg(middle.alias("median"))


def robust_z(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """``df`` with z: distance from the key's median in scaled median deviations; zero where those vanish.

    The two joins are with a row per key, which Spark broadcasts only where that is small. A row with a null key has no z.
    """
    met = lambda left, right: left.join(right, list(keys)) if keys else left.crossJoin(F.broadcast(right))
    off = met(df, medians(df, F.col(value), *keys).withColumnRenamed("median", "med"))
    off = met(off, medians(off, F.abs(F.col(value) - F.col("med")), *keys).withColumnRenamed("median", "mad"))
    return off.withColumn("z", F.when(F.col("mad") <= 1e-9, F.lit(0.0)).otherwise((F.col(value) - F.col("med")) / (MAD_SCALE * F.col("mad"))))


def with_previous(frames: DataFrame, *keys: str) -> DataFrame:
    """``frames`` with ``before``: the frame before it in its clip."""
    return frames.withColumn("before", F.lag("px").over(Window.partitionBy(*keys).orderBy("t")))


def mean_abs_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of one length."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v)
    return total / F.size(a)
