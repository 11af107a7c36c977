"""The index as one object: unbuilt, ready or read-only.

The states are classes, so a call that a state does not allow does not exist:
an unbuilt index can only be built or loaded, a read-only one not changed.
"""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import ConstructionFailed, IdAlreadyExists, IdNotFound, IndexEmpty, SearchFailed
from tessera.functions import distance as D
from tessera.functions.codecs import through_half
from tessera.operators import evaluate, graph, search
from tessera.operators.filters import EVERYTHING, Filter
from tessera.plans.materialize import materialized
from tessera.sources import store
from tessera.sources.nodes import NodeStore


#: Changes after which all rows are written as one table.
FOLD = 20


@dataclass(frozen=True)
class Configuration:
    """What an index is built with."""

    degree: int = 32
    metric: str = D.COSINE
    ef_search: int = 64
    rounds: int = 20
    half: bool = False
    binary: bool = False
    convergence: float = 0.001
    repair_interval: int = 100
    repair_depth: int = 2
    repair_rounds: int = 5
    graph: bool = False  # exact search needs none


@dataclass
class Metrics:
    """Counters and latencies of one index, off unless asked for."""

    inserts: int = 0
    searches: int = 0
    batch_searches: int = 0
    merges: int = 0
    latencies: list[tuple[str, float]] = field(default_factory=list)

    def timed(self, kind: str, start: float) -> None:
        self.latencies.append((kind, 1000 * (time.perf_counter() - start)))

    def snapshot(self, spark: SparkSession) -> DataFrame:
        """One row: counters, nearest-rank percentiles of searches and the time."""
        rows = spark.createDataFrame([(v,) for k, v in self.latencies if k == "search"], "ms double")
        out = evaluate.summary(rows, "ms", (0.5, 0.99)).select(F.col("p50").alias("p50_ms"), F.col("p99").alias("p99_ms"))
        counts = [F.lit(v).cast("bigint").alias(k) for k, v in (("insert_count", self.inserts), ("search_count", self.searches), ("batch_search_count", self.batch_searches), ("merge_count", self.merges))]
        return out.select(*counts, "p50_ms", "p99_ms", F.current_timestamp().alias("ts"))


class ReadOnlyIndex:
    """Searches over a corpus (id, embedding, metadata) and its tombstones."""

    def __init__(self, corpus: DataFrame, config: Configuration, deleted: DataFrame | None = None, edges: DataFrame | None = None, metrics: Metrics | None = None):
        self.corpus, self.config, self.deleted, self.edges, self.metrics = corpus, config, deleted, edges, metrics
        self.spark = corpus.sparkSession
        self._stored: tuple[tuple[int, int], NodeStore] | None = None

    def count(self) -> int:
        return search.live(self.corpus, self.deleted).count()

    def search(self, query: list[float], k: int, where: Filter = EVERYTHING, metric: str | None = None) -> DataFrame:
        """id, score, rank of one vector's nearest."""
        queries = self.spark.createDataFrame([(0, [float(x) for x in query])], "query_id bigint, embedding array<float>")
        out = self._search(queries, k, where, metric).drop("query_id")
        if self.metrics:
            self.metrics.searches += 1
            start = time.perf_counter()
            out = materialized(out)  # k rows; else only the making of the plan would be timed
            self.metrics.timed("search", start)
        return out

    def batch_search(self, queries: DataFrame, k: int, where: Filter = EVERYTHING, metric: str | None = None) -> DataFrame:
        if self.metrics:
            self.metrics.batch_searches += 1
        return self._search(queries, k, where, metric)

    def _metric(self, metric: str | None) -> str:
        metric = metric or self.config.metric
        if metric not in D.METRICS or (metric == D.HAMMING) != self.config.binary:
            raise SearchFailed(f"metric {metric!r} does not suit this index")
        return metric

    def _search(self, queries: DataFrame, k: int, where: Filter, metric: str | None) -> DataFrame:
        self._check(queries)
        return search.knn(queries, self.corpus, k, self._metric(metric), where, self.deleted)

    def graph_search(self, queries: DataFrame, k: int, where: Filter = EVERYTHING, metric: str | None = None) -> DataFrame:
        """Approximate search along the graph; deleted ids and rows that fail the filter are passed through, not found."""
        if self.edges is None:
            raise SearchFailed("the index has no graph")
        self._check(queries)
        keep = None if where.trivial else where.column
        return graph.walk(queries, self._nodes(), k, max(self.config.ef_search, k), self._metric(metric), graph.entry_point(self.edges, 1), keep=keep, deleted=self.deleted)

    def _nodes(self) -> NodeStore:
        """The node store of corpus and edges, written again only when these have changed."""
        made_of = (id(self.corpus), id(self.edges))
        if self._stored is None or self._stored[0] != made_of:
            if self._stored is not None:
                self._stored[1].drop(files=True)
            self._stored = (made_of, NodeStore.create(self.corpus, self.edges))
        return self._stored[1]

    def range_search(self, queries: DataFrame, max_distance: float, limit: int = 1000, where: Filter = EVERYTHING, metric: str | None = None) -> DataFrame:
        self._check(queries)
        return search.range_search(queries, self.corpus, max_distance, limit, self._metric(metric), where, self.deleted, kernel="arrow")

    def _check(self, rows: DataFrame) -> None:
        first = self.corpus.select(F.size("embedding")).first()
        if first is None:
            raise IndexEmpty("there are no vectors")
        search.check_dimension(rows, first[0])

    def save(self, root: str) -> int:
        tables = {"corpus": self.corpus}
        if self.deleted is not None:
            tables["deleted"] = self.deleted
        if self.edges is not None:
            tables["edges"] = self.edges
        return store.save(self.spark, root, tables, asdict(self.config))


class Index(ReadOnlyIndex):
    """An index that can be changed; each change gives the index its new tables.

    With a graph, the neighbourhood of inserted ids is repaired when
    ``repair_interval`` of them are waiting (0: only by ``repair``).
    """

    def __init__(self, corpus: DataFrame, config: Configuration, deleted: DataFrame | None = None, edges: DataFrame | None = None, metrics: Metrics | None = None):
        super().__init__(corpus, config, deleted, edges, metrics)
        self._changes = 0
        self._unrepaired: DataFrame | None = None

    def insert(self, rows: DataFrame) -> None:
        """Adds rows, all or none; stored and deleted ids cannot be used again before ``compact``."""
        self._check(rows)
        if not rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise IdAlreadyExists("an id occurs twice")
        if clash := rows.join(self.corpus, "id", "left_semi").select("id").head():
            raise IdAlreadyExists(f"{clash[0]!r} is stored")
        rows = materialized(_coded(rows, self.config))
        if self.edges is not None:
            self.edges = materialized(graph.insert_by_walk(self.edges, self.corpus, rows, self.config.degree, self.config.metric, nodes=self._nodes()))
        self._changed(self.corpus.unionByName(rows, allowMissingColumns=True))
        if self.metrics:
            self.metrics.inserts += rows.count()
        if self.edges is not None and self.config.repair_interval > 0:
            self._unrepaired = rows.select("id") if self._unrepaired is None else materialized(self._unrepaired.union(rows.select("id")))
            if self._unrepaired.count() >= self.config.repair_interval:
                self.repair(self._unrepaired)
                self._unrepaired = None

    def delete(self, ids: DataFrame) -> None:
        """Hides ids and drops their metadata; deleting twice changes nothing."""
        if missing := ids.select("id").join(self.corpus, "id", "left_anti").head():
            raise IdNotFound(f"{missing[0]!r} is not stored")
        new = ids.select("id")
        self.deleted = materialized((new if self.deleted is None else self.deleted.union(new)).distinct())
        plain = [c for c in self.corpus.columns if c not in ("id", "embedding")]
        if plain:
            hidden = materialized(new.distinct()).withColumn("__gone", F.lit(True))
            joined = self.corpus.join(hidden, "id", "left")
            self._changed(joined.select("id", "embedding", *[F.when(F.col("__gone").isNull(), F.col(c)).alias(c) for c in plain]))

    def undelete(self, ids: DataFrame) -> None:
        if self.deleted is not None:
            self.deleted = materialized(self.deleted.join(ids.select("id"), "id", "left_anti"))

    def set_metadata(self, values: DataFrame) -> None:
        """Upserts the columns of ``values`` (id and metadata); a null leaves what there is."""
        if missing := values.select("id").join(self.corpus, "id", "left_anti").head():
            raise IdNotFound(f"{missing[0]!r} is not stored")
        if not values.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise IdAlreadyExists("an id occurs twice in the values")
        new = [c for c in values.columns if c != "id"]
        values = materialized(values)
        joined = self.corpus.join(values.select("id", *[F.col(c).alias(f"__{c}") for c in new]), "id", "left")
        merged = [F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in self.corpus.columns else F.col(f"__{c}").alias(c) for c in new]
        self._changed(joined.select(*[c for c in self.corpus.columns if c not in new], *merged))

    def _changed(self, corpus: DataFrame) -> None:
        """The corpus with a change laid over it: only the rows of the change were written.

        Every ``FOLD`` changes all is written as one table, so that what a
        search reads stays a few tables.
        """
        self._changes += 1
        self.corpus = corpus if self._changes % FOLD else materialized(corpus)

    def repair(self, recent: DataFrame) -> int:
        if self.edges is None:
            return 0
        self.edges, changed = graph.repair(self.edges, self.corpus, recent, self.config.degree, self.config.metric, self.config.repair_depth, self.config.repair_rounds)
        return changed

    def compact(self) -> None:
        """Removes deleted rows for good."""
        if self.deleted is None:
            return
        if self.edges is not None:
            self.corpus, self.edges = graph.compact(self.edges, self.corpus, self.deleted, self.config.degree, self.config.metric)
        else:
            rows = materialized(search.live(self.corpus, self.deleted))
            if rows.isEmpty():
                raise ConstructionFailed("all vectors are deleted")
            self.corpus = rows
        self.deleted = None


def _coded(rows: DataFrame, config: Configuration) -> DataFrame:
    if config.binary:
        return rows.withColumn("embedding", F.transform("embedding", lambda x: F.when(x >= 0, 1.0).otherwise(-1.0).cast("float")))
    return rows.withColumn("embedding", through_half("embedding")) if config.half else rows


class UnbuiltIndex:
    """The start: build or load."""

    def __init__(self, spark: SparkSession, config: Configuration = Configuration()):
        self.spark, self.config = spark, config

    def build(self, corpus: DataFrame, metrics: bool = False) -> Index:
        first = corpus.select(F.size("embedding")).first()
        if first is None:
            raise IndexEmpty("there are no vectors")
        search.check_dimension(corpus, first[0])
        if not corpus.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise IdAlreadyExists("an id occurs twice")
        if self.config.binary != (self.config.metric == D.HAMMING):
            raise ConstructionFailed("binary vectors and the hamming metric need each other")
        rows = _coded(corpus, self.config)
        edges = None
        if self.config.graph:
            rough = graph.nn_descent(rows.select("id", "embedding"), self.config.degree, self.config.metric, self.config.rounds, self.config.convergence)
            edges = materialized(graph.prune(rough, rows, self.config.metric))
        return Index(rows, self.config, edges=edges, metrics=Metrics() if metrics else None)

    def _load(self, root: str, kind):
        tables, config = store.load(self.spark, root)
        return kind(tables["corpus"], replace(self.config, **config), tables.get("deleted"), tables.get("edges"))

    def load(self, root: str) -> Index:
        return self._load(root, Index)

    def open(self, root: str) -> ReadOnlyIndex:
        """For reading: tables stay on disk and are scanned as needed."""
        return self._load(root, ReadOnlyIndex)
