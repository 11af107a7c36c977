"""Clusters, product quantization, graphs and evaluation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import ConstructionFailed, CorruptIndex, IdAlreadyExists, IndexEmpty
from tessera.functions import arrays
from tessera.functions import distance as D
from tessera.operators import cluster, evaluate, graph, quantize, search, shard_graphs
from tessera.sources import vectors
from tessera.sources.nodes import NodeStore


def _clusters(spark, n, dim, k, noise=0.02, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.uniform(-1, 1, (k, dim))
    return vectors.from_rows(spark, [(centers[i % k] + rng.uniform(-noise, noise, dim)).tolist() for i in range(n)], list(range(n)))


def _queries(corpus, n):
    return corpus.where(F.col("id") < n).withColumnRenamed("id", "query_id")


def _recall(found, truth, k):
    return evaluate.recall(found, truth, k).first()[0]


def test_shards(spark):
    corpus = _clusters(spark, 200, 16, 4)
    index = cluster.ShardedIndex.build(corpus, 4, 10, D.L2)
    sizes = {r.cluster: r.n for r in index.sizes().collect()}
    assert sum(sizes.values()) == 200 and all(n >= 2 for n in sizes.values())
    queries = _queries(corpus, 20)
    truth = search.knn(queries, corpus, 10, D.L2)
    few, all_ = _recall(index.search(queries, 10, 1), truth, 10), _recall(index.batch_search(queries, 10, 4), truth, 10)
    assert few >= 0.7 and all_ == 1.0
    with pytest.raises(ConstructionFailed):
        cluster.kmeans(corpus, 201)
    with pytest.raises(ConstructionFailed):
        cluster.ShardedIndex.build(corpus.limit(0))


def test_saved_models(spark, tmp_path):
    corpus = _clusters(spark, 300, 16, 8)
    queries = _queries(corpus, 5)
    shards = cluster.ShardedIndex.build(corpus, 4, 3, D.L2)
    coded = quantize.IvfPq.train(corpus, 4, 4, 3, codes=32).add(corpus)
    shards.save(str(tmp_path / "shards"))
    coded.save(str(tmp_path / "coded"))
    rows = lambda found: sorted((r.query_id, r["rank"], r.id) for r in found.collect())
    assert rows(cluster.ShardedIndex.load(spark, str(tmp_path / "shards")).search(queries, 5, 2)) == rows(shards.search(queries, 5, 2))
    again = quantize.IvfPq.load(spark, str(tmp_path / "coded"))
    assert rows(again.search(queries, 5, 2)) == rows(coded.search(queries, 5, 2))
    assert sum(r.n for r in again.cell_sizes().collect()) == 300 and again.cell_distances(queries).count() == 20


def test_empty_cluster_keeps_its_centroid(spark):
    corpus = vectors.from_rows(spark, [[0.0], [0.0], [1.0]], [0, 1, 2])
    after = {r.cluster: r.centroid for r in cluster.lloyd(corpus, cluster.first_rows(corpus, 3), 1).collect()}
    assert after == {0: [0.0], 1: [0.0], 2: [1.0]}


def test_product_quantization(spark):
    corpus = _clusters(spark, 600, 32, 40, 0.004)
    index = quantize.IvfPq.train(corpus, 4, 4, 5, codes=64).add(corpus)
    assert index.count() == 600 and index.code_bytes() == 2400
    queries = _queries(corpus, 15)
    truth = search.knn(queries, corpus, 10, D.L2)
    recalls = [_recall(index.search(queries, 40, p).withColumn("rank", F.lit(1)), truth, 10) for p in (1, 4)]
    assert recalls[0] <= recalls[1] and recalls[1] > 0.8
    book = index.codebook.table(spark)
    coded = quantize.encode(corpus, quantize.train_codebook(corpus, 4, 64))
    assert coded.columns == ["id", "codes"] and book.count() == 4 * 64
    again = quantize.train_codebook(corpus, 4, 64)
    back = quantize.reconstruct(quantize.encode(corpus, again), again.table(spark)).select("id", F.col("embedding").alias("back")).join(corpus, "id")
    error = back.select(F.avg(D.squared_l2(F.col("embedding"), F.col("back")) / D.dot(F.col("embedding"), F.col("embedding")))).first()[0]
    assert error < 0.02
    with pytest.raises(IdAlreadyExists):
        index.add(corpus.limit(1))
    with pytest.raises(ConstructionFailed):
        quantize.train_codebook(corpus, 5)
    with pytest.raises(ConstructionFailed):
        quantize.train_codebook(corpus.limit(10), 4)
    with pytest.raises(IndexEmpty):
        quantize.train_codebook(corpus.limit(0))
    assert quantize.IvfPq(index.cells, index.codebook).search(queries, 5).count() == 0


def test_candidates_are_ranked_exactly(spark):
    corpus = vectors.from_rows(spark, np.random.default_rng(4).uniform(-1, 1, (400, 16)).tolist(), list(range(400)))
    queries = corpus.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    index = quantize.IvfPq.train(corpus, 4, 4, 3, codes=64).add(corpus)
    found = quantize.reranked(index.search(queries, 100, 4), queries, corpus, 10)
    assert found.count() == 80 and _recall(found, search.knn(queries, corpus, 10, D.L2), 10) >= 0.9


def test_graph(spark):
    corpus = vectors.from_rows(spark, np.random.default_rng(1).uniform(-1, 1, (150, 8)).tolist(), list(range(150)))
    exact = graph.exact_graph(corpus, 8).cache()
    assert exact.count() == 1200 and exact.where("src = dst").count() == 0
    approx = graph.nn_descent(corpus, 8, rounds=8)
    found = graph.with_slots(approx).selectExpr("src AS query_id", "dst AS id", "slot + 1 AS rank")
    truth = graph.with_slots(exact).selectExpr("src AS query_id", "dst AS id", "slot + 1 AS rank")
    assert _recall(found, truth, 8) > 0.85
    pruned = graph.prune(exact, corpus)
    assert 150 <= pruned.count() < 1200 and pruned.join(exact, ["src", "dst"], "left_anti").count() == 0
    both = graph.top_degree(exact.unionByName(graph.reverse(exact)).dropDuplicates(["src", "dst"]), 24)
    queries = _queries(corpus, 10)
    near = search.knn(queries, corpus, 10)
    assert _recall(graph.beam_search(queries, both, corpus, 10, 64), near, 10) > 0.9
    layers = graph.skip_layers(corpus, both, 8, 3)
    assert _recall(graph.layered_search(queries, both, layers, corpus, 10, 64), near, 10) > 0.9
    with pytest.raises(ConstructionFailed):
        graph.nn_descent(corpus, 150)


def test_seeds_take_as_many_passes_for_any_k(spark, monkeypatch):
    corpus = _clusters(spark, 600, 8, 30, 0.3, seed=3).cache()
    jobs = {}
    for k in (4, 40):
        spark.sparkContext.setJobGroup(f"seeds-{k}", "")
        seeds = cluster.parallel_seeds(corpus, k)
        jobs[k] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"seeds-{k}"))
        assert seeds.shape == (k, 8)
    assert abs(jobs[4] - jobs[40]) <= 2
    error = lambda centroids: cluster.assign(corpus, centroids).agg(F.sum("distance")).first()[0]
    for k in (8, 16):
        one_by_one = cluster.lloyd(corpus, cluster.plus_plus(corpus, k), 5)
        assert error(cluster.kmeans(corpus, k, 5)) <= 1.05 * error(one_by_one)
    same = vectors.from_rows(spark, [[1.0, 2.0]] * 6, list(range(6)))
    assert cluster.kmeans(same, 3).count() == 3


def test_means_of_both_ways_agree(spark):
    corpus = _clusters(spark, 200, 5, 6, 0.4, seed=4)
    seeds = cluster.parallel_seeds(corpus, 6)
    table = cluster.centroid_table(spark, seeds)
    fast = cluster._rounds(corpus, seeds, 3, D.L2)
    slow = {r.cluster: r.centroid for r in cluster.lloyd(corpus, table, 3).collect()}
    assert np.allclose(fast, [slow[i] for i in range(6)])


def test_models_too_large_to_send():
    with pytest.raises(ConstructionFailed):
        arrays.model(np.broadcast_to(np.float64(0), (1 << 20, 64)))


@pytest.mark.parametrize("metric", D.METRICS)
def test_join_of_blocks(spark, metric):
    rng = np.random.default_rng(9)
    rows = rng.integers(-2, 3, (130, 4)).astype(float).tolist()  # many ties
    corpus = vectors.from_rows(spark, rows, [f"k{i:03d}" for i in range(130)])
    queries = corpus.withColumnRenamed("id", "query_id")
    plain = search.knn(queries, corpus, 7, metric, exclude_self=True, kernel="expr")
    key = lambda found: sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in found.collect())
    want = key(plain)
    assert key(search.knn_join(queries, corpus, 7, metric, exclude_self=True, cell=20)) == want
    plan = search.knn_join(queries, corpus, 7, metric)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Cartesian" not in plan
    assert search.knn_join(queries, corpus.limit(0), 7, metric).count() == 0 and search.knn_join(queries, corpus, 0, metric).count() == 0


def test_copies_in_cells_and_shards(spark):
    corpus = vectors.from_rows(spark, np.random.default_rng(5).standard_normal((400, 16)).tolist(), list(range(400)))
    queries = corpus.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    truth = search.knn(queries, corpus, 10, D.L2).cache()
    one, three = (quantize.IvfPq.train(corpus, 8, 32, 5, codes=64, copies=c).add(corpus) for c in (1, 3))
    assert three.count() == 400 and three.coded.count() == 1200 and three.code_bytes() == 9600
    few, many = (_recall(quantize.reranked(i.search(queries, 50, 8), queries, corpus, 10), truth, 10) for i in (one, three))
    assert many >= 0.9 and many >= few
    assert three.search(queries, 50, 8).groupBy("query_id", "id").count().where("count > 1").isEmpty()
    more = vectors.from_rows(spark, np.random.default_rng(6).standard_normal((5, 16)).tolist(), list(range(400, 405)))
    assert three.add(more).count() == 405
    index = cluster.ShardedIndex.build(corpus, 8, 5, D.L2, copies=2, degree=12)
    assert index.corpus.count() == 800 and _recall(index.search(queries, 10, 4), truth, 10) >= 0.9
    assert _recall(index.batch_search(queries, 10, 4), truth, 10) >= 0.95


def test_graphs_of_parts(spark, monkeypatch, tmp_path):
    """Shards dealt into parts, NN-descent instead of exact links, stored; walks read a share of the vectors."""
    monkeypatch.setattr(shard_graphs, "PART", 300)
    rng = np.random.default_rng(8)
    corpus = vectors.from_rows(spark, (rng.standard_normal((900, 2)) @ rng.standard_normal((2, 12)) + 0.05 * rng.standard_normal((900, 12))).tolist(), list(range(900)))
    queries = corpus.where("id % 30 = 0").withColumnRenamed("id", "query_id")
    index = cluster.ShardedIndex.build(corpus, 2, 5, D.L2, degree=12)
    assert index.graphs.count() >= 4
    index.save(str(tmp_path / "shards"))
    again = cluster.ShardedIndex.load(spark, str(tmp_path / "shards"))
    assert _recall(again.search(queries, 10, 2), search.knn(queries, corpus, 10, D.L2), 10) >= 0.9
    x = np.array([r.embedding for r in corpus.orderBy("id").collect()])
    monkeypatch.setattr(shard_graphs, "EXACT", 10)
    near = shard_graphs.descend(x, 12, D.L2)
    true = shard_graphs._nearest(D.L2, x, 12)
    assert np.mean([len(set(a) & set(b)) / 12 for a, b in zip(near, true, strict=True)]) >= 0.9
    best, far, computed = shard_graphs.walk(x, shard_graphs.both_ways(near, 12), x[:40], 10, 48, D.L2)
    exact = np.argsort(search.scores(D.L2, x[:40], x), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(best, exact, strict=True)]) >= 0.9 and computed < 40 * 900 / 2


def test_node_store(spark, tmp_path):
    corpus = vectors.from_rows(spark, np.random.default_rng(12).uniform(-1, 1, (400, 4)).tolist(), list(range(400))).withColumn("tag", F.concat(F.lit("t"), F.col("id") % 5))
    edges = graph.exact_graph(corpus, 8, D.L2)
    edges = edges.unionByName(graph.reverse(edges)).dropDuplicates(["src", "dst"])
    nodes = NodeStore.create(corpus, edges, str(tmp_path / "nodes"), buckets=6)
    again = NodeStore.open(spark, str(tmp_path / "nodes"))
    assert again.rows().count() == 400 and again.rows().columns == ["id", "embedding", "tag", "neighbours"]
    tasks = lambda df: df._jdf.queryExecution().toRdd().getNumPartitions()
    assert sorted(r.id for r in again.fetch([3, 77]).collect()) == [3, 77] and tasks(again.fetch([3])) < 6 and again.fetch([]).count() == 0
    frontier = spark.createDataFrame([(1, 5), (2, 5), (1, 999)], "query_id long, id long")
    joined = again.joined(frontier)
    assert sorted((r.query_id, r.id, len(r.neighbours)) for r in joined.collect()) == [(q, 5, edges.where("src = 5").count()) for q in (1, 2)]
    plan = again.joined(frontier)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "hashpartitioning(id" in plan  # the frontier moves, nodes do not
    queries = corpus.where("id % 40 = 0").withColumnRenamed("id", "query_id")
    found = graph.walk(queries, again, 5, 32, D.L2, keep=F.col("tag") == "t1", deleted=corpus.where("id % 2 = 0").select("id"))
    assert found.count() == 50 and found.where("id % 5 <> 1 OR id % 2 = 0").isEmpty()
    again.keep_in_memory()
    assert again.fetch([3]).count() == 1 and again.fetch([3]).count() == 1
    nodes.drop()
    again.drop(files=True)
    with pytest.raises(CorruptIndex):
        NodeStore.open(spark, str(tmp_path / "nodes"))


def test_layers_cost_in_proportion(spark, monkeypatch):
    """Distances computed for the skip layers follow the number of nodes, not its square."""
    count = {}
    measured = graph._measured

    def counted(pairs, corpus, metric):
        count["n"] += pairs.count()
        return measured(pairs, corpus, metric)

    monkeypatch.setattr(graph, "_measured", counted)
    for n in (150, 600):
        corpus = vectors.from_rows(spark, np.random.default_rng(n).standard_normal((n, 6)).tolist(), list(range(n)))
        edges = graph.exact_graph(corpus, 8).cache()
        count["n"] = 0
        layers = graph.skip_layers(corpus, edges, 4, 3, pool=16)
        count[n] = count["n"]
        assert layers.groupBy("layer", "src").count().where("count > 4").isEmpty() and layers.where("src = dst").isEmpty()
    assert count[600] < 6 * count[150] and count[600] <= 18 * 600


def test_insertion_costs_the_same_in_larger_graphs(spark, monkeypatch):
    seen = {}
    joined = NodeStore.joined

    def counted(self, rows):
        seen["n"] += rows.count()
        return joined(self, rows)

    monkeypatch.setattr(NodeStore, "joined", counted)
    monkeypatch.setattr(graph, "WALKED", 24)
    for n in (300, 1200):
        x = np.random.default_rng(1).uniform(-1, 1, (n + 10, 3))
        corpus = vectors.from_rows(spark, x.tolist(), list(range(n + 10)))
        old, new = corpus.where(F.col("id") < n), corpus.where(F.col("id") >= n)
        edges = graph.exact_graph(old, 6, D.L2)
        edges = graph.top_degree(edges.unionByName(graph.reverse(edges)).dropDuplicates(["src", "dst"]), 10).cache()
        seen["n"] = 0
        grown = graph.insert_by_walk(edges, old, new, 10, D.L2).cache()
        seen[n] = seen["n"]
        assert grown.where(F.col("dst") >= n).select("dst").distinct().count() == 10
        assert grown.groupBy("src").count().where("count > 10").isEmpty()
    assert seen[1200] < 3 * seen[300]  # a few hops more, not four times as many vectors


def test_lost_nodes_are_attached(spark):
    """A new vector far from all is nobody's neighbour, and still reached."""
    corpus = vectors.from_rows(spark, np.random.default_rng(2).uniform(-1, 1, (60, 4)).tolist(), list(range(60)))
    far = vectors.from_rows(spark, [[50.0] * 4, [-60.0] * 4, [51.0] * 4], [100, 101, 102])
    grown = graph.insert_by_walk(graph.exact_graph(corpus, 4, D.L2), corpus, far, 4, D.L2)
    assert {r.dst for r in grown.where("dst >= 100").collect()} == {100, 101, 102}


def test_graph_upkeep(spark):
    corpus = vectors.from_rows(spark, np.random.default_rng(2).uniform(-1, 1, (90, 8)).tolist(), list(range(90)))
    old, new = corpus.where("id < 80"), corpus.where("id >= 80")
    grown = graph.insert(graph.exact_graph(old, 6), old, new, 6).cache()
    assert grown.where("src >= 80").select("src").distinct().count() == 10 and grown.where("dst >= 80").count() > 0
    assert grown.groupBy("src").count().where("count > 6").isEmpty()
    repaired, changed = graph.repair(grown, corpus, new.select("id"), 6)
    assert changed >= 0 and repaired.groupBy("src").count().where("count > 6").isEmpty()
    rows, edges = graph.compact(grown, corpus, corpus.where("id < 40").select("id"), 6)
    assert rows.count() == 50 and edges.where("src < 40 OR dst < 40").isEmpty() and edges.select("src").distinct().count() == 50
    with pytest.raises(ConstructionFailed):
        graph.compact(grown, corpus, corpus.select("id"), 6)


def test_evaluation(spark):
    values = spark.createDataFrame([(float(x),) for x in range(1, 101)], "ms double")
    row = evaluate.summary(values, "ms").first()
    assert (row.n, row.p50, row.p95, row.p99, row.min, row.max) == (100, 50.0, 95.0, 99.0, 1.0, 100.0) and row.stddev == pytest.approx(np.std(range(1, 101)))
    counts = evaluate.histogram(values, "ms")
    assert sum(r.n for r in counts.collect()) == 100 and evaluate.histogram_percentile(counts, 0.5).first()[0] == 75.0
    for kind in ([1.0], [5.0] * 50 + [1.0, 9.0], list(np.random.default_rng(1).integers(0, 9, 700).astype(float)), list(np.random.default_rng(2).standard_normal(900))):
        frame = spark.createDataFrame([(float(x),) for x in kind] + [(None,)], "ms double").repartition(4)
        for p in (0.001, 0.5, 0.99, 1.0):
            assert evaluate.nearest_rank(frame, "ms", p, small=5) == sorted(kind)[max(1, int(np.ceil(p * len(kind)))) - 1]
    assert evaluate.nearest_rank(values.limit(0), "ms", 0.5) is None and evaluate.summary(values.limit(0), "ms").first().p50 is None
    points = spark.createDataFrame([(0.9, 10.0), (0.9, 5.0), (0.8, 20.0), (0.7, 15.0), (0.8, 20.0)], "recall double, qps double")
    assert [tuple(r) for r in evaluate.pareto(points, "recall", "qps").collect()] == [(0.9, 10.0), (0.8, 20.0), (0.8, 20.0)]
    many = np.random.default_rng(3).integers(0, 40, (800, 2)).tolist()
    want = sorted((p for p in many if not any(o[0] >= p[0] and o[1] >= p[1] and o != p for o in many)), reverse=True)
    assert [list(r) for r in evaluate.pareto(spark.createDataFrame(many, "a int, b int").repartition(7), "a", "b").collect()] == want


def test_edges_that_meet_are_sent_once_nearer(spark):
    """What a node's neighbours send: the nearer pairs only, measured as expressions do; the graph of rounds of this is near the exact one."""
    corpus = vectors.wave(spark, 40, 8)
    rows = {r.id: r.embedding for r in corpus.collect()}
    member = lambda i, fresh, far: (i, fresh, far, rows[i])
    met = spark.createDataFrame([([member(1, True, 1e9), member(2, False, 1e9), member(3, False, 1e9)],), ([member(4, True, -1.0), member(5, True, 1e9)],)], "m array<struct<id:long,fresh:boolean,far:double,embedding:array<float>>>")
    sent = sorted(map(tuple, met.mapInArrow(graph._meeting(D.L2), "src long, dst long, dist double").collect()))
    assert [(s, d) for s, d, _ in sent] == [(1, 2), (1, 3), (2, 1), (3, 1), (5, 4)]
    true = {(r.src, r.dst): r.dist for r in graph._measured(spark.createDataFrame([(s, d) for s, d, _ in sent], "src long, dst long"), corpus, D.L2).collect()}
    assert {(s, d): x for s, d, x in sent} == true
