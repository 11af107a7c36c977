"""Distances of pairs of vectors in Arrow batches: what the SQL functions run."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import arrays

#: Pairs measured at once.
PAIRS = 4096


def measure(metric: str):
    """A function of two array columns."""
    from tessera.operators.search import each

    @F.arrow_udf(T.DoubleType())
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        out, known = np.zeros(len(a)), np.asarray(a.is_valid()) & np.asarray(b.is_valid())
        for i in range(0, len(a), PAIRS):
            here = np.flatnonzero(known[i : i + PAIRS])
            x, y = a.slice(i, PAIRS), b.slice(i, PAIRS)
            if len(here) < len(x):
                x, y = x.take(pa.array(here)), y.take(pa.array(here))
            if len(here):
                out[i + here] = each(metric, arrays.matrix(x), arrays.matrix(y))
        return pa.array(out, mask=~known)

    return distance
