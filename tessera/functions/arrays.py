"""Vectors of Arrow batches as matrices, and sums of arrays over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.errors import ConstructionFailed, DimensionMismatch

#: Tasks that add up the sums of all others; their results are what the driver fetches.
FAN = 16
#: Bytes of a model (centroids, codebooks) that may be sent to every task.
MODEL_BYTES = 256 << 20


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    offsets = column.offsets.to_numpy()
    size = np.diff(offsets)
    if (size != size[0]).any():
        raise DimensionMismatch(int(size[0]), int(size[size != size[0]][0]))
    flat = column.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    return flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(n, -1)


def lists(x: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Rows of a matrix as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1] if x.size else 1, np.int32)[: len(x) + 1]), pa.array(x.ravel(), kind))


def model(x: np.ndarray) -> np.ndarray:
    """x, if it may be sent to every task."""
    if x.nbytes > MODEL_BYTES:
        raise ConstructionFailed(f"a model of {x.nbytes} bytes is too large to be sent to every task")
    return x


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``part`` over all batches of rows, arrays of doubles of ``size`` components.

    A task adds up its own batches; a few tasks add up the tasks' sums, so the
    driver gets ``FAN`` arrays however many tasks there are.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += part(batch)
        yield pa.record_batch({"total": pa.array([total.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column("total"):
                total += np.frombuffer(x.as_buffer())
        yield pa.record_batch({"total": pa.array([total.tobytes()], pa.binary())})

    partials = rows.mapInArrow(partial, "total binary")
    if rows.rdd.getNumPartitions() > FAN:
        partials = partials.repartition(FAN).mapInArrow(add, "total binary")
    return np.sum([np.frombuffer(r["total"]) for r in partials.collect()] or [np.zeros(size)], axis=0)
