"""Vectors, their edges and metadata by id, in buckets on disk.

A node store is one Parquet table, a row per vector: id, embedding, the ids of
its neighbours and its metadata.  Rows are dealt into buckets by a hash of the
id and sorted within them, so a join on the id moves the other side only, and a
look-up of given ids reads their buckets only.
"""

from __future__ import annotations

import json
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import CorruptIndex
from tessera.plans.materialize import checkpoint_folder
from tessera.sources import store

#: Rows of a bucket, about.
BUCKET = 1_000_000


class NodeStore:
    """A stored table of nodes; ``create`` writes one, ``open`` finds it again."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, schema: str):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.table = f"nodes_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} ({schema}) USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {buckets} BUCKETS LOCATION '{folder}/table'")
        self._rows = spark.table(self.table)

    @classmethod
    def create(cls, corpus: DataFrame, edges: DataFrame | None = None, folder: str | None = None, buckets: int | None = None) -> NodeStore:
        """A store of corpus (id, embedding, metadata) and the edges (src, dst) of its rows; in the checkpoint folder if none is told."""
        spark = corpus.sparkSession
        folder = folder or f"{checkpoint_folder(spark)}/nodes-{uuid.uuid4().hex}"
        rows = corpus
        if edges is not None:
            near = edges.groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("neighbours"))  # at most ``degree`` each
            rows = corpus.join(near, "id", "left")
        if buckets is None:
            buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-corpus.count() // BUCKET))
        made = f"nodes_{uuid.uuid4().hex}"
        # dealt by the buckets' own hash first, so that a task writes one file
        rows.repartition(buckets, "id").write.format("parquet").bucketBy(buckets, "id").sortBy("id").option("path", f"{folder}/table").saveAsTable(made)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        spark.sql(f"DROP TABLE {made}")  # the files stay
        about = json.dumps({"buckets": buckets, "schema": schema})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{folder}/about")
        return cls(spark, folder, buckets, schema)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> NodeStore:
        if not store.exists(spark, f"{folder}/about"):
            raise CorruptIndex(f"no nodes at {folder}")
        about = json.loads(spark.read.text(f"{folder}/about").first()[0])
        return cls(spark, folder, about["buckets"], about["schema"])

    def rows(self) -> DataFrame:
        return self._rows

    def keep_in_memory(self) -> NodeStore:
        """From now on rows that were read stay in the executors' memory, and on their disks beyond it."""
        self._rows = self._rows.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def fetch(self, ids: list) -> DataFrame:
        """The rows of given ids; only their buckets are read."""
        return self._rows.where(F.col("id").isin(ids)) if ids else self._rows.limit(0)

    def joined(self, rows: DataFrame) -> DataFrame:
        """rows with an ``id``, and the node of that id; nodes stay where they are, rows are dealt like them."""
        return rows.join(self._rows.hint("merge"), "id")

    def drop(self, files: bool = False) -> None:
        self._rows.unpersist()
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        if files:
            store.delete(self.spark, self.folder)
