"""Runs of sorted groups as large Arrow tables, for operators that work on many series at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new group begins; ``keys`` are integer columns without nulls."""
    if table.num_rows == 0:
        return np.zeros(0, np.int64)
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def map_sorted_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    work: Callable[[pa.Table, np.ndarray], pa.Table],
    schema: str,
    rows: int = 100_000,
) -> DataFrame:
    """Calls ``work(table, starts)`` on tables of whole groups of about ``rows`` rows.

    Rows are hash-partitioned by ``keys`` (integers) and sorted by keys and ``order``; a group that
    runs over the end of a batch is carried to the next, so a task holds ``rows`` rows or one group,
    whichever is more. Callers bound the size of a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count < rows:
                continue
            table = pa.Table.from_batches(held)
            starts = group_starts(table, keys)
            if len(starts) < 2:
                continue
            last = int(starts[-1])
            yield from work(table.slice(0, last).combine_chunks(), starts[:-1]).to_batches()
            rest = table.slice(last).combine_chunks()
            held, count = rest.to_batches(), rest.num_rows
        if count:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from work(table, group_starts(table, keys)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
