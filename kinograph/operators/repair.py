"""Repair of frames by a pluggable batch function.

A repairer takes an array of frames (n, h, w) and a mask (h, w) and gives frames of the same shape; pixels outside
the mask must come back as they were, which the callers see to. Only deterministic fillers come with it;
others are registered by name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Repairer = Callable[[np.ndarray, np.ndarray], np.ndarray]


def surroundings(frames: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mask filled with the mean of what is outside it."""
    out = frames.copy()
    out[:, mask] = frames[:, ~mask].mean(axis=1)[:, None] if (~mask).any() else 0.0
    return out


def steady(frames: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mask filled with one value for the whole block: the mean of what is outside it in all its frames."""
    out = frames.copy()
    out[:, mask] = frames[:, ~mask].mean() if (~mask).any() else 0.0
    return out


REPAIRERS: dict[str, Repairer] = {"surroundings": surroundings, "steady": steady}


def register(name: str, repairer: Repairer) -> None:
    """Make ``repairer`` known by ``name``."""
    REPAIRERS[name] = repairer


def repairer_of(name: str) -> Repairer:
    """The repairer of that name."""
    if name not in REPAIRERS:
        raise ValueError(f"unknown repairer {name!r}; there are {', '.join(sorted(REPAIRERS))}")
    return REPAIRERS[name]


def repair_blocks(frames: DataFrame, mask: np.ndarray, name: str, block: int, overlap: int) -> DataFrame:
    """``frames`` (clip, t, px) repaired in blocks of ``block`` frames of a clip, each seen with up to ``overlap`` frames before and after it.

    A repairer gets left context, body and right context as one array in order; only the body is kept. A
    group is one block with its context, so its size does not grow with a clip.
    """
    repairer, (h, w) = repairer_of(name), mask.shape
    placed = frames.select("clip", "t", "px", (F.row_number().over(Window.partitionBy("clip").orderBy("t")) - 1).alias("i"))
    own = F.floor(F.col("i") / block)
    first, last = F.greatest(F.floor((F.col("i") - overlap) / block), F.lit(0)), F.floor((F.col("i") + overlap) / block)
    # a frame goes to its own block and to those that it is context of
    copies = placed.withColumn("block", F.explode(F.sequence(first, last))).withColumn("body", F.col("block") == own)

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        px = np.array(rows.column("px").to_pylist(), np.float64).reshape(-1, h, w)
        done = np.where(mask, repairer(px, mask), px).reshape(len(px), -1)
        out = pa.table([rows.column("clip"), rows.column("t"), pa.array(list(done), pa.list_(pa.float64()))], ["clip", "t", "px"])
        return out.filter(rows.column("body"))

    return copies.groupBy("clip", "block").applyInArrow(run, "clip long, t long, px array<double>")


def repair(frames: DataFrame, mask: np.ndarray, repairer: Repairer = surroundings) -> DataFrame:
    """``frames`` (clip, t, px) with px repaired under ``mask``, a batch at a time."""
    h, w = mask.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                px = np.stack(batch["px"].to_numpy()).reshape(-1, h, w)
                done = np.where(mask, repairer(px, mask), px)
                yield batch.assign(px=list(done.reshape(len(px), -1)))

    return frames.select("clip", "t", "px").mapInPandas(run, "clip long, t long, px array<double>")
