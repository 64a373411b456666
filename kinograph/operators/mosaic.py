"""Frames of any size, held as square blocks, and stencils over them.

A block is a row (clip, t, by, bx, h, w, px): its place, in blocks, its own height and width (those at the frame's ends may be smaller) and
its pixels, row by row. ``stencil`` gives every block the pixels that its neighbours hold within ``reach`` of it, in one shuffle of
(1 + 2 * reach / side)^2 times the pixels, and then works on each block by itself: no task holds a whole frame, and
what is computed near a border is the same as if there were none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 32
_KEYS = ["clip", "t", "by", "bx"]
BLOCK = "clip long, t long, by long, bx long, h int, w int"


def cut(frames: DataFrame, height: int, width: int, side: int = SIDE) -> DataFrame:
    """Blocks of ``frames`` (clip, t, px), each of ``height`` rows of ``width`` pixels; frames of another size are left out."""
    places = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in range(0, height, side) for x in range(0, width, side)])
    rows = frames.where(F.size("px") == height * width).select("clip", "t", "px", F.explode(places).alias("at"))
    h, w = F.least(F.lit(side), height - F.col("at.y")), F.least(F.lit(side), width - F.col("at.x"))
    px = F.flatten(F.transform(F.sequence(F.lit(0), h - 1), lambda r: F.slice("px", (F.col("at.y") + r) * width + F.col("at.x") + 1, w)))
    return rows.select("clip", "t", (F.col("at.y") / side).cast("long").alias("by"), (F.col("at.x") / side).cast("long").alias("bx"), h.alias("h"), w.alias("w"), px.alias("px"))


def _pieces(reach: int, side: int):
    """What each block gives to itself and to the blocks within ``reach``, as the part of it that they need."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = -(-reach // side)
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                a = np.array(r["px"], np.float64).reshape(r["h"], r["w"])
                for dy in range(-rings, rings + 1):
                    for dx in range(-rings, rings + 1):
                        # rows and columns of this block within ``reach`` of the block at (by + dy, bx + dx)
                        y0, x0 = max(0, dy * side - reach), max(0, dx * side - reach)
                        y1, x1 = min(r["h"], dy * side + side + reach), min(r["w"], dx * side + side + reach)
                        if y0 < y1 and x0 < x1 and r["by"] + dy >= 0 and r["bx"] + dx >= 0:
                            out.append((r["clip"], r["t"], r["by"] + dy, r["bx"] + dx, y0 - dy * side, x0 - dx * side, y1 - y0, x1 - x0, a[y0:y1, x0:x1].ravel().tolist(), dy == 0 and dx == 0))
            types = [pa.int64()] * 4 + [pa.int32()] * 4 + [pa.list_(pa.float64()), pa.bool_()]
            names = [*_KEYS, "y", "x", "h", "w", "px", "own"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * 10, types, strict=True)], names)

    return pieces


def stencil(blocks: DataFrame, reach: int, work: Callable[..., dict], columns: dict[str, str], side: int = SIDE) -> DataFrame:
    """``blocks`` with what ``work(area)`` gives in place of ``px``: arrays of the area's size, of which each block keeps its own part.

    The area is the block and all pixels of its frame within ``reach``: where it ends before that, the frame ends. ``columns`` has the types
    of the results' values; ``reach`` is the sum of the radii that the work goes through.
    """
    gathered = blocks.mapInArrow(_pieces(reach, side), f"{BLOCK.replace('h int, w int', 'y int, x int, h int, w int')}, px array<double>, own boolean").groupBy(*_KEYS).agg(F.collect_list(F.struct("y", "x", "h", "w", "px", "own")).alias("parts"))
    kinds = {"double": pa.float64(), "boolean": pa.bool_()}

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                own = next((p for p in r["parts"] if p["own"]), None)
                if own is None:  # beyond the frame
                    continue
                top, left = min(p["y"] for p in r["parts"]), min(p["x"] for p in r["parts"])
                area = np.full((max(p["y"] + p["h"] for p in r["parts"]) - top, max(p["x"] + p["w"] for p in r["parts"]) - left), np.nan)
                for p in r["parts"]:
                    area[p["y"] - top : p["y"] - top + p["h"], p["x"] - left : p["x"] - left + p["w"]] = np.reshape(p["px"], (p["h"], p["w"]))
                found = work(area)
                mine = (slice(-top, own["h"] - top), slice(-left, own["w"] - left))
                out.append((*(r[k] for k in _KEYS), own["h"], own["w"], *(found[c][mine].ravel().tolist() for c in columns)))
            types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.list_(kinds[k]) for k in columns.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * len(types), types, strict=True)], [*_KEYS, "h", "w", *columns])

    return gathered.mapInArrow(done, f"{BLOCK}, " + ", ".join(f"{c} array<{k}>" for c, k in columns.items()))


def block_pixels(blocks: DataFrame, *arrays: str, side: int = SIDE) -> DataFrame:
    """One row per pixel of a frame: clip, t, y, x and a column for each array."""
    each = blocks.select("clip", "t", "by", "bx", "w", F.posexplode(F.arrays_zip(*arrays)).alias("p", "v"))
    return each.select("clip", "t", (F.col("by") * side + F.floor(F.col("p") / F.col("w"))).alias("y"), (F.col("bx") * side + F.col("p") % F.col("w")).alias("x"), "v.*")
