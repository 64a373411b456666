"""Stateful operators: a job's state machine over a stream, and a patch cache over frames in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinograph.operators.folds import fold_sorted

#: The order of states, the event that leads to each, and the one that ends a job.
STEPS = ("signup", "view", "click", "purchase")
ENDS = "error"


def step(rank: int, event: str) -> int:
    """The next rank of a job: one further on the event that is due, 9 (failed) on an error, else as it was."""
    return rank if rank >= len(STEPS) or rank == 9 else 9 if event == ENDS and rank > 0 else rank + 1 if event == STEPS[rank] else rank


def job_states(events: DataFrame) -> DataFrame:
    """(user_id, rank, moves) after each batch, for users with events in it."""

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rank, moves = state.get if state.exists else (0, 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        for event in rows["event_type"]:
            new = step(rank, event)
            rank, moves = new, moves + int(new != rank)
        state.update((rank, moves))
        yield pd.DataFrame({"user_id": [key[0]], "rank": [rank], "moves": [moves]})

    keyed = events.select("user_id", "ts", "event_id", "event_type").groupBy("user_id")
    return keyed.applyInPandasWithState(advance, "user_id long, rank long, moves long", "rank long, moves long", "update", GroupStateTimeout.NoTimeout)


def patch_cache(frames: DataFrame, tolerance: float, hold: int) -> DataFrame:
    """(clip, t, hit, age): a frame reuses the last computed patch while that is young or the frame hardly differs from it.

    The comparison is with the frame of the last miss, so each depends on those before: a fold that holds one anchor.
    """

    def step(state, row):
        px = np.array(row["px"])
        anchor, age = state or (None, 0)
        hit = anchor is not None and bool(age < hold or np.abs(px - anchor).mean() <= tolerance)
        anchor, age = (anchor, age + 1) if hit else (px, 1)
        return (anchor, age), (hit, age)

    schema = "clip long, t long, px array<double>, hit boolean, age long"
    return fold_sorted(frames.select("clip", "t", "px"), ["clip"], ["t"], step, schema, ["hit", "age"]).drop("px")
