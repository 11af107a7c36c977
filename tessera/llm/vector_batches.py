"""Vectors in Arrow batches as matrices, and sums of arrays over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that add up the sums of all others; their results are what the driver fetches.
FAN = 16


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is there and has finite components only, and at least one."""
    v = F.col(column)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), F.lit(False)))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & finite)


def dimension(vectors: DataFrame, column: str) -> int | None:
    """The length that most vectors have, the greater of equals; None if there are no vectors."""
    top = vectors.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return None if top is None else top["d"]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column, all of one length, as rows of doubles."""
    start = column.offsets[0].as_py() if len(column) else 0
    flat = column.values.slice(start, len(column) * dim)
    return flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)


def summed(vectors: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``part`` over all batches, arrays of doubles of ``size`` components.

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

    rows = vectors.mapInArrow(partial, "total binary").repartition(FAN).mapInArrow(add, "total binary").collect()
    return np.sum([np.frombuffer(r["total"]) for r in rows], axis=0)
