"""Sums of numeric arrays over a table: one partial sum for each partition, merged as a tree of tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Partial sums that one task, or at the end the driver, adds up; fewer if they would take more than HELD bytes.
FAN, HELD = 64, 128 << 20


def partitions(df: DataFrame) -> int:
    """Partitions of a table that is read and mapped, without a shuffle."""
    return df._jdf.rdd().getNumPartitions()


def _row(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])


def tree_sum(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], dtype: type = np.float64, parts: int | None = None, size: int = 0) -> np.ndarray | None:
    """The sum of `part(batch)` over all batches of `df`; None for a table without rows.

    `part` gives arrays of one length, of about `size` bytes if given, that does not depend on the rows. A partition holds
    one such array; arrays meet FAN at a time, so neither a task nor the driver ever gets more of them than that, however
    many partitions there are.
    """
    fan = max(2, min(FAN, HELD // max(1, size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                got = part(batch)
                total = got.astype(dtype) if total is None else total + got
        if total is not None:
            yield _row(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.column(0):
                got = np.frombuffer(row.as_buffer(), dtype)
                total = got if total is None else total + got
        if total is not None:
            yield _row(total)

    parts = partitions(df) if parts is None else parts
    sums = df.mapInArrow(run, "total binary")
    while parts > fan:
        parts = -(-parts // fan)
        sums = sums.repartition(parts).mapInArrow(add, "total binary")
    total = None
    for r in sums.collect():
        got = np.frombuffer(r.total, dtype)
        total = got if total is None else total + got
    return total
