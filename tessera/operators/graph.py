"""Neighbour graphs: construction, pruning, search and upkeep.

A graph is a table (src, dst, dist), at most ``degree`` edges per source, of a
corpus (id, embedding).  Loops over rounds run on the driver; each round is a
few joins on node ids, checkpointed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ConstructionFailed
from tessera.functions import arrays
from tessera.functions import distance as D
from tessera.operators import search, shard_graphs
from tessera.plans.materialize import materialized
from tessera.sources.nodes import NodeStore


#: Rows that are ordered by hash in one group.
RING = 4096


def top_degree(edges: DataFrame, degree: int, by: str = "src") -> DataFrame:
    """The nearest edges of each source, ties by target."""
    order = Window.partitionBy(by).orderBy("dist", "dst")
    return edges.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= degree).drop("__r")


def with_slots(edges: DataFrame) -> DataFrame:
    """Edges numbered by distance within their source, from 0."""
    return edges.withColumn("slot", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst")) - 1)


def exact_graph(corpus: DataFrame, degree: int, metric: str = D.COSINE) -> DataFrame:
    """Each vector's nearest others, by a join of blocks of the corpus with each other."""
    queries = corpus.select(F.col("id").alias("query_id"), "embedding")
    near = search.knn_join(queries, corpus, degree, metric, exclude_self=True)
    return near.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.col("score").alias("dist"))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")


def _measured(candidates: DataFrame, corpus: DataFrame, metric: str) -> DataFrame:
    """Distances of candidate edges (src, dst)."""
    a = corpus.select(F.col("id").alias("src"), F.col("embedding").alias("__a"))
    b = corpus.select(F.col("id").alias("dst"), F.col("embedding").alias("__b"))
    return search.measured(candidates.join(a, "src").join(b, "dst").select("src", "dst", "__a", "__b"), metric, "__a", "__b", "dist")


def _random_graph(corpus: DataFrame, degree: int, metric: str, seed: int) -> DataFrame:
    """Edges between neighbours of several hashed orders: every node gets at least ``degree`` distinct ones."""
    rings = []
    buckets = max(1, -(-corpus.count() // RING))
    for r in range(max(2, math.ceil(degree / 4))):
        bucket = F.pmod(F.xxhash64("id", F.lit(seed + 7919 * r)), F.lit(buckets))
        order = Window.partitionBy(bucket).orderBy(F.xxhash64("id", F.lit(seed + r)), "id")
        around = F.array(*[step("id", k).over(order) for k in (1, 2) for step in (F.lead, F.lag)])
        rings.append(corpus.select(F.col("id").alias("src"), around.alias("n")).select("src", F.explode("n").alias("dst")))
    edges = rings[0]
    for ring in rings[1:]:
        edges = edges.union(ring)
    return _measured(edges.where("dst IS NOT NULL AND src <> dst").distinct(), corpus, metric)


def nn_descent(corpus: DataFrame, degree: int = 16, metric: str = D.COSINE, rounds: int = 20, convergence: float = 0.001, seed: int = 42, start: DataFrame | None = None) -> DataFrame:
    """Approximate neighbour graph: neighbours of neighbours, round by round.

    A round brings the vectors around each node together, those its edges lead
    to and those that point to it (at most ``2 * degree``), measures them with
    each other there, and sends on only the edges that are nearer than what
    their source has.  It ends when fewer than ``convergence`` of the edges
    change.
    """
    n = corpus.count()
    if not 0 < degree < n:
        raise ConstructionFailed(f"degree {degree} does not suit {n} vectors")
    graph = top_degree(start if start is not None else _random_graph(corpus, degree, metric, seed), degree)
    graph = materialized(graph.select("src", "dst", "dist", F.lit(True).alias("fresh")))
    for _ in range(rounds):
        back = top_degree(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist", "fresh"), degree)
        around = graph.unionByName(back).groupBy("src", "dst").agg(F.max("fresh").alias("fresh"))
        far = graph.groupBy(F.col("src").alias("id")).agg(F.when(F.count("*") >= degree, F.max("dist")).otherwise(F.lit(float("inf"))).alias("far"))
        vectors = corpus.select("id", "embedding").join(far, "id", "left").withColumn("far", F.coalesce("far", F.lit(float("inf"))))
        members = around.select(F.col("src").alias("via"), F.col("dst").alias("id"), "fresh").join(vectors, "id")
        met = members.groupBy("via").agg(F.collect_list(F.struct("id", "fresh", "far", "embedding")).alias("m")).where(F.size("m") > 1).select("m")
        new = met.mapInArrow(_meeting(metric), T.StructType([T.StructField(c, graph.schema[c].dataType) for c in ("src", "dst", "dist")]))
        both = graph.select("src", "dst", "dist", F.lit(False).alias("fresh")).unionByName(new.withColumn("fresh", F.lit(True)))
        graph = materialized(top_degree(both.groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh")), degree))
        if graph.where("fresh").count() < convergence * degree * n:
            break
    return graph.drop("fresh")


def _meeting(metric: str):
    """Edges between the members (id, fresh, far, embedding) of each row that are nearer than what their source has; one of the two is fresh."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                column = part.column("m")
                first = column.offsets.to_numpy().astype(np.int64)
                inner = column.values.slice(first[0], first[-1] - first[0])
                first = first - first[0]
                fresh, far, x = (inner.field("fresh").to_numpy(zero_copy_only=False), inner.field("far").to_numpy(), arrays.matrix(inner.field("embedding")))
                length, pairs, out = search.norms(x), [], []
                for low, high in zip(first[:-1], first[1:], strict=True):  # products tell which pairs may be near enough
                    own, n = np.arange(high - low), high - low
                    rows, norm = x[low:high], length[low:high]
                    d, error = search.Asked(metric, own, rows, False).about(0, n, own, rows, norm)
                    reach = np.maximum(far[low:high, None], far[None, low:high]) + 2 * error[:, None]
                    i, j = np.nonzero(np.triu((fresh[low:high, None] | fresh[None, low:high]) & ~(d > reach), 1))
                    pairs.append((i + low, j + low))
                a, b = (np.concatenate(side) for side in zip(*pairs, strict=True))
                for i in range(0, len(a), 8192):
                    u, v = a[i : i + 8192], b[i : i + 8192]
                    d = search.each(metric, x[u], x[v], length[u], length[v])
                    for s, t in ((u, v), (v, u)):
                        near = d <= far[s]
                        out.append((s[near], t[near], d[near]))
                if out:
                    src, dst, dist = (np.concatenate(c) for c in zip(*out, strict=True))
                    ids = inner.field("id")
                    yield pa.record_batch([ids.take(pa.array(src)), ids.take(pa.array(dst)), pa.array(dist)], names=["src", "dst", "dist"])

    return meet


def entry_point(edges: DataFrame, degree: int) -> DataFrame:
    """The node whose edges are shortest on average over ``degree`` slots."""
    return edges.groupBy("src").agg((F.sum("dist") / degree).alias("mean_dist")).orderBy("mean_dist", "src").limit(1)


def prune(edges: DataFrame, corpus: DataFrame, metric: str = D.COSINE) -> DataFrame:
    """Drops an edge if an edge kept before it leads closer to its target than the source is.

    The rule is greedy in order of distance, within one source.  A source's
    edges, ``degree`` at most, become one row of arrays by a map-side combined
    collection; a task then applies the rule to whole batches of sources at
    once, slot after slot.
    """
    full = edges.join(corpus.select(F.col("id").alias("dst"), F.col("embedding").alias("__v")), "dst")
    rows = full.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dist", "dst", "__v"))).alias("e"))
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                column = part.column("e")
                first = column.offsets.to_numpy().astype(np.int64)
                inner = column.values.slice(first[0], first[-1] - first[0])
                first = first - first[0]
                dist, x = inner.field("dist").to_numpy(), arrays.matrix(inner.field("__v"))
                kept = _greedy(dist, x, first, metric)
                source = np.searchsorted(first, kept, side="right") - 1
                yield pa.record_batch([part.column("src").take(pa.array(source)), inner.field("dst").take(pa.array(kept)), pa.array(dist[kept])], names=["src", "dst", "dist"])

    return rows.mapInArrow(keep, f"src {kinds['src']}, dst {kinds['dst']}, dist double")


def _greedy(dist: np.ndarray, x: np.ndarray, first: np.ndarray, metric: str) -> np.ndarray:
    """Edges that stay, of sources whose edges stand from ``first`` on in order of distance."""
    size = np.diff(first)
    width = int(size.max(initial=0))
    if not width:
        return np.zeros(0, np.int64)
    at = np.minimum(first[:-1, None] + np.arange(width), len(dist) - 1)
    there = np.arange(width) < size[:, None]
    kept = np.zeros(at.shape, bool)
    for slot in range(width):
        nearer = np.zeros(len(at), bool)
        if slot:
            between = shard_graphs.distances(metric, x[at[:, slot]], x[at[:, :slot]])
            nearer = ((between < dist[at[:, slot]][:, None]) & kept[:, :slot]).any(axis=1)
        kept[:, slot] = there[:, slot] & ~nearer
    return at[kept]


def beam_search(queries: DataFrame, edges: DataFrame, corpus: DataFrame, k: int, ef: int = 64, metric: str = D.COSINE, entry: DataFrame | None = None, width: int = 32, allowed: DataFrame | None = None) -> DataFrame:
    """Best-first walk of all queries at once, over a node store made for it.

    entry: (src) for all queries, or (query_id, src).  allowed: ids that may be
    found; the others are walked through.
    """
    rows = corpus.select("id", "embedding")
    if allowed is not None:
        rows = rows.join(allowed.select("id", F.lit(True).alias("ok")), "id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    starts = entry_point(edges, 1) if entry is None else entry
    nodes = NodeStore.create(rows, edges)
    try:
        return walk(queries, nodes, k, ef, metric, starts, width, F.col("ok") if allowed is not None else None)
    finally:
        nodes.drop(files=True)


def walk(queries: DataFrame, nodes: NodeStore, k: int, ef: int = 64, metric: str = D.COSINE, entry: DataFrame | None = None, width: int = 32, keep: Column | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Best-first walk of all queries at once along the edges of a node store.

    Each query keeps its ``ef`` best nodes, with their neighbours; a round
    expands the ``width`` best not yet expanded.  It ends when no query has one
    left, as then none among its best can lead to a closer node it has not seen;
    every node is expanded once by a query at most, so it ends.  A round joins
    the nodes found with the store, which stays in its buckets: what moves are
    the candidates, and back to their query.  Nodes that fail ``keep`` or are
    deleted are walked through, and every query keeps its ``ef`` best of either
    kind.
    """
    ef = max(ef, k)
    q = queries.select("query_id", F.col("embedding").alias("__q"))
    q = F.broadcast(q) if q.limit(search.QUERY_BLOCK + 1).count() <= search.QUERY_BLOCK else q
    ok = F.lit(True) if keep is None else keep

    def score(candidates: DataFrame) -> DataFrame:
        found = nodes.joined(candidates).withColumn("ok", ok)
        if deleted is not None:
            gone = deleted.select("id", F.lit(True).alias("__gone")).distinct()
            found = found.join(gone, "id", "left").withColumn("ok", F.col("ok") & F.col("__gone").isNull())
        told = search.measured(found.join(q, "query_id").select("query_id", "id", "ok", "neighbours", "__q", "embedding"), metric, "__q", "embedding", "score")
        return told.select("query_id", "id", "score", "ok", F.lit(False).alias("done"), "neighbours")

    starts = nodes.rows().select(F.col("id").alias("src")).orderBy("id").limit(1) if entry is None else entry
    if "query_id" in starts.columns:
        first = starts.select("query_id", F.col("src").alias("id")).distinct()
    else:
        first = queries.select("query_id").crossJoin(F.broadcast(starts.select(F.col("src").alias("id")).limit(ef)))  # a beam holds no more
    kept = Window.partitionBy("query_id", "ok").orderBy("score", "id")
    turn = Window.partitionBy("query_id").orderBy("done", "score", "id")

    def opened(grown: DataFrame) -> DataFrame:
        """The best of both kinds, and which of them are expanded next."""
        best = grown.withColumn("__r", F.row_number().over(kept)).where(F.col("__r") <= ef).drop("__r")
        return materialized(best.withColumn("open", (F.row_number().over(turn) <= width) & ~F.col("done")))

    pool = opened(score(first))
    while not (open_ := pool.where("open")).isEmpty():
        near = open_.select("query_id", F.explode("neighbours").alias("id")).distinct().join(pool.select("query_id", "id"), ["query_id", "id"], "left_anti")
        closed = pool.withColumn("done", F.col("done") | F.col("open")).drop("open")
        pool = opened(closed.unionByName(score(near)))
    return search.best(pool.where("ok").select("query_id", "id", "score"), k)


def levels(corpus: DataFrame, max_layers: int = 6, seed: int = 42) -> DataFrame:
    """id, level: geometric by a hash of the id, each level half as many as the one below."""
    uniform = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + 1) / float(1 << 52)
    return corpus.select("id", F.least(F.lit(max_layers), F.floor(-F.log2(uniform)).cast("int")).alias("level"))


def skip_layers(corpus: DataFrame, edges: DataFrame, m: int = 8, max_layers: int = 6, metric: str = D.COSINE, seed: int = 42, pool: int | None = None) -> DataFrame:
    """(layer, src, dst, dist): near others of each node among those of its layer or higher, m at most.

    A layer's candidates come from the layer below (the graph, below the first):
    neighbours and their neighbours that reach the layer, and a few that follow
    in a hashed order so that every layer hangs together.  A node has at most
    ``pool`` candidates, so a layer's work follows its number of nodes.
    """
    pool = pool or 8 * m
    node_levels = materialized(levels(corpus, max_layers, seed))
    top = node_levels.agg(F.max("level")).first()[0] or 0
    below = edges.select("src", "dst")
    out = None
    for layer in range(1, top + 1):
        members = node_levels.where(F.col("level") >= layer).select("id")
        part = materialized(corpus.select("id", "embedding").join(members, "id", "left_semi"))
        n = part.count()
        if n < 2:
            break
        inside = lambda pairs, c: pairs.join(members.withColumnRenamed("id", c), c, "left_semi")
        one = inside(below, "src").select("src", F.col("dst").alias("via"))
        both = one.select("src", F.col("via").alias("dst"), F.lit(1).alias("hop")).unionByName(one.join(below.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst", F.lit(2).alias("hop")))
        near = inside(both, "dst").where("src <> dst").groupBy("src", "dst").agg(F.min("hop").alias("hop"))
        nearest = Window.partitionBy("src").orderBy("hop", F.xxhash64("src", "dst"))
        walked = near.withColumn("__r", F.row_number().over(nearest)).where(F.col("__r") <= pool).select("src", "dst")
        bucket = F.pmod(F.xxhash64("id", F.lit(seed + layer)), F.lit(max(1, -(-n // RING))))
        ring = Window.partitionBy(bucket).orderBy(F.xxhash64("id", F.lit(seed - layer)), "id")
        beside = part.select(F.col("id").alias("src"), F.array(F.lead("id", 1).over(ring), F.lag("id", 1).over(ring)).alias("n"))
        after = beside.select("src", F.explode("n").alias("dst")).where("dst IS NOT NULL")
        found = _measured(walked.unionByName(after).distinct(), part, metric)
        layered = materialized(top_degree(found, m).select(F.lit(layer).alias("layer"), "src", "dst", "dist"))
        below = layered.select("src", "dst").unionByName(layered.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        out = layered if out is None else out.unionByName(layered)
    if out is None:
        return corpus.limit(0).select(F.lit(1).alias("layer"), F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist"))
    return out


def layered_search(queries: DataFrame, edges: DataFrame, layers: DataFrame, corpus: DataFrame, k: int, ef: int = 64, metric: str = D.COSINE, hops: int = 128) -> DataFrame:
    """Greedy descent through the skip layers, then a beam search from where it ends."""
    q = queries.select("query_id", F.col("embedding").alias("__q"))
    v = corpus.select("id", F.col("embedding").alias("__v"))
    score = lambda pairs: pairs.join(q, "query_id").join(v, "id").select("query_id", "id", D.distance(metric, F.col("__q"), F.col("__v")).alias("score"))
    tops = [r[0] for r in layers.select("layer").distinct().orderBy(F.desc("layer")).collect()]
    if not tops:
        return beam_search(queries, edges, corpus, k, ef, metric)
    first = layers.where(F.col("layer") == tops[0]).select("src").orderBy("src").limit(1)
    now = materialized(score(q.select("query_id").crossJoin(F.broadcast(first.select(F.col("src").alias("id"))))))
    for layer in tops:
        steps = layers.where(F.col("layer") == layer).select(F.col("src").alias("id"), "dst")
        for _ in range(hops):
            near = now.join(steps, "id").select("query_id", F.col("dst").alias("id"))
            best = score(near.distinct()).unionByName(now).groupBy("query_id").agg(F.min(F.struct("score", "id")).alias("b")).select("query_id", "b.id", "b.score")
            best = materialized(best)
            moved = not best.join(now, ["query_id", "id"], "left_anti").isEmpty()
            now = best
            if not moved:
                break
    return beam_search(queries, edges, corpus, k, ef, metric, entry=now.select("query_id", F.col("id").alias("src")))


def neighbourhood(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """id, hop: nodes within so many edges of the starts, with the least number of edges."""
    reached = materialized(starts.select("id", F.lit(0).alias("hop")).distinct())
    frontier = reached
    for hop in range(1, depth + 1):
        step = frontier.select(F.col("id").alias("src")).join(edges, "src").select(F.col("dst").alias("id")).distinct()
        frontier = materialized(step.join(reached, "id", "left_anti").withColumn("hop", F.lit(hop)))
        reached = reached.unionByName(frontier)
        if frontier.isEmpty():
            break
    return reached


def diversity(edges: DataFrame) -> DataFrame:
    """One row: the mean over nodes of the distance of the farthest neighbour."""
    return edges.groupBy("src").agg(F.max("dist").alias("far")).agg(F.avg("far").alias("diversity"))


def insert(edges: DataFrame, corpus: DataFrame, new: DataFrame, degree: int, metric: str = D.COSINE) -> DataFrame:
    """The graph with a batch of new vectors: their nearest as edges, and back where nearer than what was there."""
    everything = corpus.select("id", "embedding").unionByName(new.select("id", "embedding"))
    near = search.knn(new.select(F.col("id").alias("query_id"), "embedding"), everything, degree, metric, exclude_self=True)
    forward = near.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.col("score").alias("dist"))
    return top_degree(edges.unionByName(forward).unionByName(reverse(forward)).dropDuplicates(["src", "dst"]), degree)


#: Nodes that the walk of an insertion keeps, at least.
WALKED = 96
#: New neighbours of one old node that are linked with each other, each with so many that follow it.
FOLLOWING = 4


def insert_by_walk(edges: DataFrame, corpus: DataFrame, new: DataFrame, degree: int, metric: str = D.COSINE, ef: int | None = None, nodes: NodeStore | None = None) -> DataFrame:
    """The graph with a batch of new vectors, each found its place by a walk of the graph.

    A new vector's edges go to the nearest that its walk with ``ef`` nodes
    (``WALKED``, or four times the degree) meets, so what it costs does not follow the size of the
    graph.  New vectors that share an old neighbour stand in line there by
    distance, and each looks at a few that follow, and then at those two steps
    away.  Back edges take the place of
    a node's farthest where they are nearer; a new node to which no edge leads
    takes the place of the farthest edge of its nearest old node, so all can be
    reached.
    """
    rows = new.select("id", "embedding")
    queries = rows.withColumnRenamed("id", "query_id")
    ef = ef or max(WALKED, 4 * degree)
    if nodes is None:
        found = beam_search(queries, edges, corpus, ef, ef, metric)
    else:
        found = walk(queries, nodes, ef, ef, metric, entry_point(edges, 1))
    found = materialized(found.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.col("score").alias("dist"), "rank"))
    line = Window.partitionBy("dst").orderBy("dist", "src")
    beside = found.where(F.col("rank") <= FOLLOWING).select("src", F.array(*[F.lead("src", i).over(line) for i in range(1, FOLLOWING + 1)]).alias("n"))
    beside = beside.select("src", F.explode("n").alias("other")).where("other IS NOT NULL AND src <> other").select("src", F.col("other").alias("dst")).distinct()
    fresh = _measured(beside, rows, metric)
    fresh = fresh.unionByName(reverse(fresh))
    forward = materialized(top_degree(found.select("src", "dst", "dist").unionByName(fresh).dropDuplicates(["src", "dst"]), degree))
    # then the new ones around the neighbours of each, two steps away
    ids = rows.select("id")
    near = materialized(forward.unionByName(edges.join(forward.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst", "dist")))
    near = materialized(top_degree(near.unionByName(reverse(near)).dropDuplicates(["src", "dst"]), 2 * degree)).select("src", "dst")
    one = near.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").withColumnRenamed("dst", "via")
    ends = near.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").withColumnRenamed("src", "via")
    two = one.join(ends, "via").select("src", "dst").where("src <> dst").distinct().join(forward.select("src", "dst"), ["src", "dst"], "left_anti")
    forward = materialized(top_degree(forward.unionByName(_measured(two, rows, metric)), degree))
    linked = materialized(top_degree(edges.select("src", "dst", "dist").unionByName(forward).unionByName(reverse(forward)).dropDuplicates(["src", "dst"]), degree))
    lost = rows.select(F.col("id").alias("dst")).join(linked.select("dst").distinct(), "dst", "left_anti")
    # each lost node at the nearest old node of its walk; a node that gets several gives up as many edges
    host = found.groupBy("src").agg(F.min_by(F.struct("dst", "dist"), F.col("rank")).alias("h")).select(F.col("src").alias("dst"), F.col("h.dst").alias("src"), F.col("h.dist").alias("dist"))
    forced = materialized(host.join(lost, "dst").select("src", "dst", "dist"))
    if forced.isEmpty():
        return linked
    taken = forced.groupBy("src").agg(F.count("*").alias("n"))
    near = Window.partitionBy("src").orderBy("dist", "dst")
    ranked = linked.withColumn("__r", F.row_number().over(near)).join(taken, "src", "left")
    return ranked.where(F.col("__r") <= F.greatest(F.lit(degree) - F.coalesce("n", F.lit(0)), F.lit(1))).select("src", "dst", "dist").unionByName(forced)


def repair(edges: DataFrame, corpus: DataFrame, recent: DataFrame, degree: int, metric: str = D.COSINE, depth: int = 2, rounds: int = 5, tolerance: float = 0.02) -> tuple[DataFrame, int]:
    """Improves the graph around recent ids; returns it and the number of new edges.

    Their neighbourhood is refined by NN-descent, and a walk that starts at each
    of them, along edges in both directions, finds what lies outside of it.  If
    the mean distance of the farthest neighbours falls by more than the
    tolerance, the old graph is returned.
    """
    part = neighbourhood(edges, recent, depth).select("id")
    inner = corpus.join(part, "id", "left_semi")
    n = inner.count()
    if n < 3:
        return edges, 0
    local = edges.join(part.select(F.col("id").alias("src")), "src", "left_semi").join(part.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "dist")
    if local.isEmpty():
        return edges, 0
    better = nn_descent(inner, min(degree, n - 1), metric, rounds, start=local)
    queries = corpus.join(recent.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("query_id"), "embedding")
    around = edges.select("src", "dst", "dist").unionByName(better)
    around = materialized(top_degree(around.unionByName(reverse(around)).dropDuplicates(["src", "dst"]), 2 * degree))
    walked = beam_search(queries, around, corpus, degree + 1, max(WALKED, 4 * degree), metric, queries.select("query_id", F.col("query_id").alias("src")))
    walked = walked.where("query_id <> id").select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.col("score").alias("dist"))
    better = better.unionByName(walked).unionByName(reverse(walked))
    merged = materialized(top_degree(edges.select("src", "dst", "dist").unionByName(better).dropDuplicates(["src", "dst"]), degree))
    changed = merged.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").count()
    before, after = diversity(edges).first()[0] or 0.0, diversity(merged).first()[0] or 0.0
    return (edges if before > 0 and after < before * (1 - tolerance) else merged), changed


def compact(edges: DataFrame, corpus: DataFrame, deleted: DataFrame, degree: int, metric: str = D.COSINE) -> tuple[DataFrame, DataFrame]:
    """Corpus and graph without deleted ids: nodes that lose edges are linked anew."""
    rows = materialized(search.live(corpus, deleted))
    n = rows.count()
    if n < 2:
        raise ConstructionFailed("fewer than two vectors are left")
    gone = deleted.select("id")
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    short = edges.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src").distinct()
    lost = rows.join(short.select(F.col("src").alias("id")), "id", "left_semi")
    near = search.knn(lost.select(F.col("id").alias("query_id"), "embedding"), rows, min(degree, n - 1), metric, exclude_self=True)
    new = near.select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.col("score").alias("dist"))
    return rows, materialized(top_degree(kept.select("src", "dst", "dist").unionByName(new).dropDuplicates(["src", "dst"]), min(degree, n - 1)))
