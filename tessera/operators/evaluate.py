"""Recall, latency statistics and trade-off frontiers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arrays

# Upper bounds of the latency buckets in milliseconds; slower ones count in the last.
BUCKETS_MS = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: the mean share of each query's k true neighbours that were found."""
    want = truth.where(F.col("rank") <= k).select("query_id", "id")
    got = found.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("hit"))
    each = want.join(got, ["query_id", "id"], "left").groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("share"))
    return each.agg(F.avg("share").alias("recall"))


def bucket_of(value: Column, edges: tuple[float, ...] = BUCKETS_MS) -> Column:
    """The number of the bucket that holds a value, from 0; bounds are exclusive, the last bucket is open."""
    out = F.lit(len(edges) - 1)
    for i in range(len(edges) - 2, -1, -1):
        out = F.when(value < edges[i], i).otherwise(out)
    return out


def histogram(values: DataFrame, column: str, edges: tuple[float, ...] = BUCKETS_MS) -> DataFrame:
    """bucket, n for buckets that have values."""
    return values.where(F.col(column).isNotNull()).groupBy(bucket_of(F.col(column), edges).alias("bucket")).agg(F.count("*").alias("n"))


def histogram_percentile(counts: DataFrame, p: float, edges: tuple[float, ...] = BUCKETS_MS) -> DataFrame:
    """One row: the middle of the bucket that holds the nearest-rank percentile."""
    middle = F.element_at(F.array(*[F.lit((a + b) / 2) for a, b in zip([0.0, *edges[:-1]], edges, strict=True)]), F.col("bucket") + 1)
    running = counts.withColumn("upto", F.sum("n").over(Window.orderBy("bucket"))).withColumn("total", F.sum("n").over(Window.partitionBy()))  # a row per bucket
    return running.where(F.col("upto") >= F.ceil(F.col("total") * p)).orderBy("bucket").limit(1).select(middle.alias("value"))


#: Values that are put in order in one task; cuts of a pass over more.
SMALL, CUTS = 10_000, 63


def nearest_rank(values: DataFrame, column: str, p: float, n: int | None = None, small: int = SMALL) -> float | None:
    """The exact value of rank ceil(p n) among those that are not null.

    Each pass cuts the values between two bounds into about 64 equal shares and
    counts what lies below and at each cut; the rank is then a cut, or lies
    between two of them.  What is left is ordered when it is small, so no task
    ever holds all values.
    """
    x = F.col("x")
    rows = values.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    m = rows.count() if n is None else n
    if not m:
        return None
    rank = min(m, max(1, math.ceil(p * m)))
    while m > small:
        cuts = sorted(set(rows.select(F.percentile_approx("x", [i / (CUTS + 1) for i in range(1, CUTS + 1)], 1000)).first()[0]))
        counts = rows.agg(*[F.count_if(x < c) for c in cuts], *[F.count_if(x <= c) for c in cuts]).first()
        below, upto = counts[: len(cuts)], counts[len(cuts) :]
        for c, a, b in zip(cuts, below, upto, strict=True):
            if a < rank <= b:
                return c
        after = sum(b < rank for b in upto)  # cuts that lie below
        if after < len(cuts):
            rows, m = rows.where(x < cuts[after]), below[after]
        if after:
            rows, m, rank = rows.where(x > cuts[after - 1]), m - upto[after - 1], rank - upto[after - 1]
    return rows.orderBy("x").limit(rank).agg(F.max("x")).first()[0]


def summary(values: DataFrame, column: str, percentiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """One row: n, mean, population deviation, extremes and nearest-rank percentiles."""
    x = F.col(column)
    n = values.where(x.isNotNull()).count()
    ranked = [F.lit(nearest_rank(values, column, p, n)).cast("double").alias(f"p{round(100 * p)}") for p in percentiles]
    return values.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("stddev"), F.min(x).alias("min"), F.max(x).alias("max")).select("*", *ranked)


def _undominated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The frontier of a task's points, larger being better in both columns."""
    kept = None
    for batch in batches:
        both = batch if kept is None else pa.concat_batches([kept, batch])
        a, b = (both.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        order = np.lexsort((-b, -a))
        best = np.maximum.accumulate(b[order])
        new = np.ones(len(order), bool)
        new[1:] = b[order][1:] > best[:-1]
        kept = both.take(pa.array(order[new]))
    if kept is not None:
        yield kept


def pareto(points: DataFrame, a: str, b: str) -> DataFrame:
    """Points that no other beats in one of two measures without losing in the other, best ``a`` first.

    Tasks keep the frontiers of their own points, then a few tasks those of
    these; the last comparison sees what is left.
    """
    both = points.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    left = both.mapInArrow(_undominated, both.schema).repartition(arrays.FAN).mapInArrow(_undominated, both.schema)
    above = F.max(b).over(Window.orderBy(F.desc(a), F.desc(b)).rowsBetween(Window.unboundedPreceding, -1))
    kept = left.withColumn("__above", above).where(F.col("__above").isNull() | (F.col(b) > F.col("__above"))).select(a, b)
    return points.join(kept, [a, b], "left_semi").orderBy(F.desc(a), F.desc(b))
