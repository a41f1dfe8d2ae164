"""One small value from those of many tasks, merged in a tree of groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that one task of the tree takes.
FAN = 16


def of_task(data: bytes | None) -> Iterator[pa.RecordBatch]:
    """What a task hands to :func:`fold`, as rows of (part, data)."""
    if data is not None:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([data], pa.binary())], names=["part", "data"])


def fold(parts: DataFrame, merge: Callable[[list[bytes]], bytes], width: int) -> bytes | None:
    """One value from those of ``width`` tasks (part, data), merged in a tree; only the last, of a bounded size, reaches the driver."""

    def together(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "data": [merge(t.column("data").to_pylist())]})

    while True:
        width = -(-width // FAN)
        parts = parts.select((F.col("part") % width).alias("part"), "data").groupBy("part").applyInArrow(together, "part int, data binary")
        if width <= 1:
            row = parts.first()
            return bytes(row.data) if row else None


