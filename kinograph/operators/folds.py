"""Folds over the rows of a key in order, where each row depends on those before it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], step: Callable, schema: str, add: list[str]) -> DataFrame:
    """``df`` with what ``step(state, row) -> (state, values)`` gives for each row, in order within its key.

    ``schema`` is that of all columns of ``df`` and then of ``add``, the names of the values. A key's first row has the state None.
    Rows stream through sorted partitions, a batch at a time: no key has to fit in memory, though one key is one task's work.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != last:
                    last, state = key, None
                state, values = step(state, row)
                out.append(values)
            columns = [pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], pa.null())] * len(add)
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *add])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
