"""Distances between array columns as Catalyst expressions.

Lower is closer for every metric.  All arithmetic is in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

COSINE, L2, INNER_PRODUCT, HAMMING = METRICS = ("cosine", "l2", "inner_product", "hamming")
#: Below this product of norms a cosine is undefined and the distance is 1.
TINY = 1e-10


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 - cosine; 1 where either vector is zero.  Norms may be given if known."""
    product = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(product < TINY, F.lit(1.0)).otherwise(F.lit(1.0) - dot(a, b) / product)


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -dot(a, b)


def hamming(a: Column, b: Column) -> Column:
    """Places in which two arrays differ."""
    return _sum(F.zip_with(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)))


def packed_hamming(a: Column, b: Column) -> Column:
    """Bits in which two arrays of packed words differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda total, x: total + x).cast("double")


def distance(metric: str, a: Column, b: Column) -> Column:
    """The distance of a metric; hamming compares the signs of components."""
    if metric == HAMMING:
        return hamming(signs(a), signs(b))
    return {COSINE: cosine, L2: squared_l2, INNER_PRODUCT: negative_inner_product}[metric](a, b)


def signs(v: Column) -> Column:
    """1 for components of at least 0, else 0."""
    return F.transform(v, lambda x: F.when(x >= 0, 1).otherwise(0))


def register(spark: SparkSession) -> None:
    """SQL functions cosine_distance, l2_distance, inner_product_distance and hamming_distance, of two arrays.

    They measure Arrow batches of pairs, to the last bit as expressions do.
    """
    from tessera.functions import measures

    for metric in METRICS:
        spark.udf.register(f"{metric}_distance", measures.measure(metric))
