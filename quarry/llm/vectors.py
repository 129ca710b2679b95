"""Sums of fixed-size vectors over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm.textscan import field

_PARTS = 16


def sum_vectors(df: DataFrame, per_task: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int,
                dtype=np.float64, parts: int = _PARTS) -> np.ndarray:
    """Sum of the vectors of ``size`` numbers that ``per_task`` makes of each
    task's batches.  ``parts`` slices of the vectors are added up by the
    executors; the driver gets one vector, whatever the number of tasks."""
    width = -(-size // parts)
    schema = T.StructType([field("part", T.IntegerType()), field("numbers", T.BinaryType())])

    def emit(rows: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(rows), pa.int32()), pa.array([v.tobytes() for v in rows.values()], pa.binary())],
            names=schema.names)

    def first(batches):
        v = np.asarray(per_task(batches), dtype=dtype)
        yield emit({i: v[i * width:(i + 1) * width] for i in range(parts)})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(raw, dtype=dtype)
        if sums:
            yield emit(sums)

    total = np.zeros(parts * width, dtype=dtype)
    made = df.mapInArrow(first, schema)
    # a single slice needs a single task, not one of many partitions by key
    dealt = made.repartition(parts, "part") if parts > 1 else made.repartition(1)
    for r in dealt.mapInArrow(add, schema).collect():
        v = np.frombuffer(r["numbers"], dtype=dtype)
        total[r["part"] * width:r["part"] * width + len(v)] += v
    return total[:size]
