"""Delivery of messages by the tasks that hold them, with a bounded number of attempts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Attempts of a message, seconds before the second one (doubled from then on), and the answer that may change.
MAX_ATTEMPTS, FIRST_DELAY, TOO_MANY = 4, 1.0, 429


def final(status: int | None) -> bool:
    """Whether an answer settles a message: success, or a refusal that will not become true by repeating it."""
    return status is not None and (status < 300 or 400 <= status < 500 and status != TOO_MANY)


def deliver(messages: DataFrame, send: Callable[[int, str], int], attempts: int = MAX_ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(id, attempts, delivered) for each message (id, body); ``send`` gives a status or raises OSError.

    A task that is run again sends its messages again, with the same ids, by which a receiver can tell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, body in zip(batch.column("id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                status, delay = None, FIRST_DELAY
                for attempt in range(1, attempts + 1):
                    try:
                        status = send(name, body)
                    except OSError:
                        status = None
                    if final(status) or attempt == attempts:
                        break
                    wait(delay)
                    delay *= 2
                rows.append((name, attempt, status is not None and status < 300))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["id", "attempts", "delivered"])

    return messages.select("id", "body").mapInArrow(run, "id long, attempts long, delivered boolean")
