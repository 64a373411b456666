"""Boxes as columns: clamping, scaling, snapping, parsing, and text forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, y: Column, w: Column, h: Column, frame_w, frame_h) -> dict[str, Column]:
    """A box moved and cut into a frame, at least one pixel large."""
    cx = F.least(F.greatest(x, F.lit(0)), F.lit(frame_w) - 1)
    cy = F.least(F.greatest(y, F.lit(0)), F.lit(frame_h) - 1)
    return {"x": cx, "y": cy, "w": F.greatest(F.lit(1), F.least(w, F.lit(frame_w) - cx)), "h": F.greatest(F.lit(1), F.least(h, F.lit(frame_h) - cy))}


def snap(low: Column, high: Column, limit: int, step: int = 8) -> tuple[Column, Column]:
    """A span grown to multiples of ``step`` that stays within ``limit`` and still covers what it did."""
    a = low - F.pmod(low, F.lit(step))
    b = F.least(high + F.pmod(-high, F.lit(step)), F.lit(limit))
    return F.greatest(a, F.lit(0)), F.greatest(b, high)


def parse_box(text: Column) -> Column:
    """(x, y, w, h) from four whole numbers with commas or spaces; null if it is no box."""
    parts = F.transform(F.filter(F.split(text, r"[,\s]+"), lambda s: s != ""), lambda s: s.try_cast("long"))
    box = F.struct(*[F.try_element_at(parts, F.lit(i)).alias(n) for i, n in enumerate(("x", "y", "w", "h"), 1)])
    fine = (F.size(parts) == 4) & (parts[0] >= 0) & (parts[1] >= 0) & (parts[2] > 0) & (parts[3] > 0)
    return F.when(fine, box)


def human_bytes(n: Column) -> Column:
    """A size in the largest unit that it fills, with one decimal."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1024**k, F.concat(F.format_string("%.1f", n / 1024**k), F.lit(f" {unit}"))).otherwise(out)
    return out


def clock(seconds: Column) -> Column:
    """h:mm:ss."""
    return F.format_string("%d:%02d:%02d", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)
