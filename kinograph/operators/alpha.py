"""A semi-transparent mark as a per-pixel alpha: fitted, bounded, refined and taken back out of numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The least part of the picture that must shine through, and the alpha from which none does.
LEAST_THROUGH, SOLID = 0.12, 0.88


#: Fixed value: the contrast, in levels, that ink and background need in each channel for a fit.
MIN_CONTRAST = 6.0


def unit(value: Column) -> Column:
    """``value`` within 0 to 1."""
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def variance_alpha(stds: list[Column], around: list[Column]) -> Column:
    """1 less the least share, over channels, of the background's deviation that a pixel keeps; 0 where the background has none."""
    kept = [F.coalesce(F.try_divide(s, b), F.lit(1.0)) for s, b in zip(stds, around, strict=True)]
    return unit(1 - (F.least(*kept) if len(kept) > 1 else kept[0]))


def matte_alpha(means: list[Column], around: list[Column], ink: float) -> Column:
    """Least squares over channels: how far means stand from the background towards the ink; 0 without contrast."""
    gaps = [F.lit(ink) - b for b in around]
    top = sum(((m - b) * g for m, b, g in zip(means, around, gaps, strict=True)), F.lit(0.0))
    bottom = sum((g * g for g in gaps), F.lit(0.0))
    return unit(F.when(bottom > MIN_CONTRAST**2 * len(gaps), top / bottom).otherwise(0.0))


def alpha_bound(leasts: list[Column], ink: float) -> Column:
    """The most alpha that the darkest moment of a pixel allows in any channel, ``SOLID`` at most."""
    return F.least(*[v / ink for v in leasts], F.lit(SOLID))


def recovered(value, alpha, ink: float):
    """The picture under an alpha of ``ink``, floored to whole levels within 0 to 255."""
    plain = (value - alpha * ink) / F.greatest(1 - alpha, F.lit(LEAST_THROUGH))
    return F.floor(F.least(F.greatest(plain, F.lit(0.0)), F.lit(255.0)))


def scaled_means(frames: DataFrame, scales: list[float], weights: tuple, ink: float) -> DataFrame:
    """(clip, s, p, gray): the mean gray, over the frames of a clip, of each pixel with its alpha scaled by each of ``scales`` and taken out.

    ``frames`` has clip, the channels' levels and a map's ``a`` and ``bound`` as arrays c0, c1, ... What is linear comes after this mean.
    The frames of a clip in a batch are summed as one array, so that a clip shuffles its pixels once a batch, whatever its length.
    """
    channels = [f"c{k}" for k in range(len(weights))]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clips = batch.column("clip").to_numpy()
            for clip in np.unique(clips).tolist():
                own = batch.filter(pa.array(clips == clip))
                levels = [own.column(c).flatten().to_numpy().reshape(own.num_rows, -1) for c in channels]
                a, bound = (own.column(c)[0].values.to_numpy() for c in ("a", "bound"))
                total = np.zeros((len(scales), levels[0].shape[1]))
                for i, s in enumerate(scales):
                    alpha = np.minimum(np.clip(a * s / 10, 0.0, 1 - LEAST_THROUGH), bound)
                    plain = [np.floor(np.clip((v - alpha * ink) / np.maximum(1 - alpha, LEAST_THROUGH), 0.0, 255.0)) for v in levels]
                    total[i] = sum(w * v for w, v in zip(weights, plain, strict=True)).sum(axis=0)
                n = total.size
                columns = [np.full(n, clip), np.repeat(scales, total.shape[1]), np.tile(np.arange(total.shape[1]), len(scales)), total.ravel(), np.full(n, own.num_rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64()), strict=True)], ["clip", "s", "p", "total", "n"])

    sums = frames.select("clip", *channels, "a", "bound").mapInArrow(summed, "clip long, s long, p int, total double, n long")
    return sums.groupBy("clip", "s", "p").agg((F.sum("total") / F.sum("n")).alias("gray"))
