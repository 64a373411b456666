"""Stateful processors with lists, values and timers: blocks with context as frames come in, and jobs that fall silent."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that lists and timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
BLOCKS = "user_id long, s long, frames long, body long, body_value double"
SILENCES = "user_id long, kind string, at_ms long"


class ContextBlocks(StatefulProcessor):
    """Bodies of ``segment`` frames with ``overlap`` frames on either side, given out once their look-ahead is there.

    A list holds what may still be needed: the last ``overlap`` frames before the next body and all since. Frames of a key come in order from batch
    to batch; within one they are put in order. The last body is held until the frames after it come.
    """

    def __init__(self, segment: int, overlap: int):
        self.segment, self.overlap = segment, overlap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "value double")
        self.next = handle.getValueState("next", "body long, seen long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["ts", "event_id"])["value"].tolist()
        begin, seen = self.next.get() if self.next.exists() else (0, 0)
        held = [v for (v,) in self.held.get()] + [None if pd.isna(v) else float(v) for v in new]
        seen += len(new)
        out = []
        while seen >= begin + self.segment + self.overlap:
            left = min(begin, self.overlap)
            body = held[left : left + self.segment]
            out.append((key[0], begin, left + self.segment + self.overlap, self.segment, sum(v for v in body if v is not None)))
            begin += self.segment
            held = held[left + self.segment - min(begin, self.overlap) :]
        self.held.put([(v,) for v in held])
        self.next.update((begin, seen))
        yield pd.DataFrame(out, columns=["user_id", "s", "frames", "body", "body_value"])

    def close(self) -> None:
        pass


class Silences(StatefulProcessor):
    """What follows the last sign of a job: a heartbeat is due, it counts as interrupted, its state goes; each after its own time without one.

    Silence between two signs of one batch is told at once; after the last one, by timers in event time. A sign puts the timers off.
    """

    def __init__(self, after_ms: dict[str, int]):
        self.after = after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_ms long, told long")  # the last sign, and the time after it that timers have told of

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        times = sorted(int(t.value // 1_000_000) for part in rows for t in part["ts"])
        (last, told), out = (self.last.get() if self.last.exists() else (None, 0)), []
        for at in times:
            if last is not None:
                out += [(key[0], kind, last + due) for kind, due in self.after.items() if told < due < at - last]
            if last is None or at > last:
                last, told = at, 0
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for due in self.after.values():
            if due > told:
                self.handle.registerTimer(last + due)
        self.last.update((last, told))
        yield pd.DataFrame(out, columns=["user_id", "kind", "at_ms"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at, (last, _) = expiredTimerInfo.getExpiryTimeInMs(), self.last.get()
        kinds = [kind for kind, due in self.after.items() if last + due == at]
        if at == last + max(self.after.values()):
            self.last.clear()
        else:
            self.last.update((last, at - last))
        yield pd.DataFrame([(key[0], kind, at) for kind in kinds], columns=["user_id", "kind", "at_ms"])

    def close(self) -> None:
        pass


def _run(events: DataFrame, processor: StatefulProcessor, schema: str, time_mode: str) -> DataFrame:
    events.sparkSession.conf.set(*STORE)
    return events.groupBy("user_id").transformWithStateInPandas(processor, schema, "append", time_mode)


def context_blocks(events: DataFrame, segment: int, overlap: int) -> DataFrame:
    """``BLOCKS`` of each user's ``events`` (user_id, ts, event_id, value), a stream."""
    return _run(events.select("user_id", "ts", "event_id", "value"), ContextBlocks(segment, overlap), BLOCKS, "none")


def silences(events: DataFrame, after_ms: dict[str, int]) -> DataFrame:
    """``SILENCES`` of each user's ``events`` (user_id, ts), a stream with a watermark; kinds in the order of their times."""
    return _run(events.select("user_id", "ts"), Silences(after_ms), SILENCES, "EventTime")
