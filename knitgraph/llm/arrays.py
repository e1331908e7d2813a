"""Sums of count arrays over all tasks of a job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_BLOCK = 1 << 13


def summed_counts(df: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], rows: int, width: int) -> np.ndarray:
    """The sum of `count(batches of a task)`, int64 of shape (rows, width), over all tasks.

    A task sends its array in blocks; each block is summed in one task and only the sums, whose size
    does not depend on the data, come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = count(batches)
        for at in range(0, width, _BLOCK):
            block = np.ascontiguousarray(counts[:, at : at + _BLOCK], dtype=np.int64)
            if block.any():
                yield pa.RecordBatch.from_pydict({"at": [at], "counts": [block.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column("at").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[at] = sums.get(at, 0) + np.frombuffer(counts, dtype=np.int64)
        for at, counts in sums.items():
            yield pa.RecordBatch.from_pydict({"at": [at], "counts": [counts.tobytes()]})

    schema = "at long, counts binary"
    blocks = -(-width // _BLOCK)
    total = np.zeros((rows, width), dtype=np.int64)
    for row in df.mapInArrow(run, schema).repartition(blocks, "at").mapInArrow(add, schema).toLocalIterator():
        part = np.frombuffer(row["counts"], dtype=np.int64).reshape(rows, -1)
        total[:, row["at"] : row["at"] + part.shape[1]] += part
    return total
