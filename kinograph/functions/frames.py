"""Column functions over frames held as flat arrays, row by row: nothing here shuffles.

A frame is ``array<double>`` of ``h * w`` values; position p is pixel (p div w, p mod w).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE = 8


def positions(w: int = SIDE, h: int = SIDE) -> Column:
    return F.sequence(F.lit(0), F.lit(w * h - 1))


def gradient_x(px: Column, w: int = SIDE, h: int = SIDE) -> Column:
    """Central differences along a row, one-sided at its ends."""

    def at(p: Column) -> Column:
        low, high = F.when(p % w > 0, p - 1).otherwise(p), F.when(p % w < w - 1, p + 1).otherwise(p)
        return (px[high] - px[low]) / (high - low)

    return F.transform(positions(w, h), at)


def gradient_y(px: Column, w: int = SIDE, h: int = SIDE) -> Column:
    """Central differences down a column, one-sided at its ends."""

    def at(p: Column) -> Column:
        low, high = F.when(p >= w, p - w).otherwise(p), F.when(p < w * (h - 1), p + w).otherwise(p)
        return (px[high] - px[low]) / ((high - low) / w)

    return F.transform(positions(w, h), at)


def _mirror(i: Column, n: int) -> Column:
    """Reflection at the border without repeating it."""
    return F.when(i < 0, -i).when(i > n - 1, 2 * (n - 1) - i).otherwise(i)


def convolve(px: Column, kernel: list[list[float]], w: int = SIDE, h: int = SIDE) -> Column:
    """Weighted neighbourhood sums, with borders mirrored."""
    r = len(kernel) // 2

    def at(p: Column) -> Column:
        y, x = F.floor(p / w).cast("int"), p % w
        terms = [px[_mirror(y + dy - r, h) * w + _mirror(x + dx - r, w)] * F.lit(k) for dy, row in enumerate(kernel) for dx, k in enumerate(row) if k]
        out = terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    return F.transform(positions(w, h), at)


def neighbourhood(px: Column, pick, radius: int = 1, w: int = SIDE, h: int = SIDE) -> Column:
    """``pick`` (greatest or least) over each pixel's square neighbourhood inside the frame."""

    def at(p: Column) -> Column:
        y, x = F.floor(p / w).cast("int"), p % w
        near = []
        for dy in range(-radius, radius + 1):
            for dx in range(-radius, radius + 1):
                inside = (y + dy).between(0, h - 1) & (x + dx).between(0, w - 1)
                near.append(F.when(inside, px[F.when(inside, (y + dy) * w + x + dx).otherwise(p)]).otherwise(px[p]))
        return pick(*near)

    return F.transform(positions(w, h), at)


SOBEL_X = [[-1.0, 0.0, 1.0], [-2.0, 0.0, 2.0], [-1.0, 0.0, 1.0]]
SOBEL_Y = [[-1.0, -2.0, -1.0], [0.0, 0.0, 0.0], [1.0, 2.0, 1.0]]
#: The 3 x 3 binomial kernel.
BLUR = [[k / 16 for k in row] for row in ([1, 2, 1], [2, 4, 2], [1, 2, 1])]
