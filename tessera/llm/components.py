"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.spark_util import checkpointed


def _settled(edges: DataFrame) -> bool:
    """Whether every node that points to another points to one that points nowhere."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("met")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("met")))).alias("e")).select("e.*")
    each = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("met").alias("met"))
    return each.where("out > 1 OR (out = 1 AND met = 1)").isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node with a link.

    Alternates the large-star and small-star steps until the graph is a set of
    stars: each node points its larger neighbours, then its smaller ones, to
    the smallest.  A step is a map-side combined minimum and a join that
    adaptive execution splits at frequent nodes; depth shrinks geometrically.
    Edges of each round are checkpointed, so a lost executor costs a reread.
    """
    edges = checkpointed(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while not _settled(edges):
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        edges = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v")
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = checkpointed(edges)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
