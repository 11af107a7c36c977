"""Distances, filters, codecs and exact searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import DimensionMismatch, SearchFailed
from tessera.functions import codecs, tables
from tessera.functions import distance as D
from tessera.operators import search
from tessera.operators.filters import EVERYTHING, Field, all_of, any_of
from tessera.sources import vectors


def _numpy(metric, a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    if metric == D.L2:
        return ((a - b) ** 2).sum()
    if metric == D.INNER_PRODUCT:
        return -(a @ b)
    if metric == D.HAMMING:
        return float(((a >= 0) != (b >= 0)).sum())
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return 1.0 if n < 1e-10 else 1 - a @ b / n


@pytest.mark.parametrize("metric", D.METRICS)
@pytest.mark.parametrize("dim", [1, 8, 130])
def test_distances(spark, metric, dim):
    rng = np.random.default_rng(dim)
    rows = [(i, rng.standard_normal(dim).astype(np.float32).tolist(), rng.standard_normal(dim).astype(np.float32).tolist()) for i in range(6)]
    rows += [(6, [0.0] * dim, rows[0][2]), (7, rows[0][1], rows[0][1])]
    D.register(spark)
    frame = spark.createDataFrame(rows, "id long, a array<float>, b array<float>")
    got = frame.select("id", D.distance(metric, F.col("a"), F.col("b")).alias("d"), F.expr(f"{metric}_distance(cast(a AS array<double>), cast(b AS array<double>))").alias("s")).collect()
    for r in got:
        assert r.d == pytest.approx(_numpy(metric, rows[r.id][1], rows[r.id][2]), abs=1e-6) and r.s == pytest.approx(r.d, abs=1e-9)


def test_hamming_example(spark):
    bits = lambda s: [1.0 if c == "1" else -1.0 for c in s]
    row = spark.createDataFrame([(bits("10101100"), bits("00111001"))], "a array<double>, b array<double>")
    assert row.select(D.packed_hamming(codecs.pack_signs(F.col("a")), codecs.pack_signs(F.col("b")))).first()[0] == 4.0


def test_codecs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.uniform(-1, 1, 70).astype(np.float32).tolist()) for i in range(20)]
    frame = spark.createDataFrame(rows, "id long, v array<float>")
    got = frame.select("id", codecs.unpack_signs(codecs.pack_signs(F.col("v")), 70).alias("bits"), codecs.decode_half(codecs.encode_half("v")).alias("half"), codecs.through_half("v").alias("through")).collect()
    for r in got:
        v = np.array(rows[r.id][1])
        assert r.bits == (v >= 0).astype(int).tolist() and np.abs(np.array(r.half) - v).max() < 0.001 and r.half == r.through


def test_filters_are_two_valued(spark):
    rows = spark.createDataFrame([(1, "A", 1.0, 9_000_000_000_000_000_000), (2, "B", None, 9_000_000_000_000_000_001), (3, None, 5.0, None)], "id long, category string, score float, ts long")
    ids = lambda f: {r.id for r in rows.where(f.column).collect()}
    category, score, ts = Field("category"), Field("score", "float"), Field("ts", "int")
    assert ids(category == "A") == {1} and ids(~(category == "A")) == {2, 3} and ids(category != "B") == {1, 3}
    assert ids(score > 2) == {3} and ids(score < 2) == {1} and ids(~(score > 2)) == {1, 2}
    assert ids(ts > 9_000_000_000_000_000_000) == {2} and ids(ts < 9_000_000_000_000_000_001) == {1}
    assert ids(category.one_of({"A", "B"})) == {1, 2} and ids(category.one_of(set())) == set()
    assert ids((category == "A") | (score > 2)) == {1, 3} and ids((category == "A") & (score < 2)) == {1}
    assert ids(all_of()) == {1, 2, 3} and ids(any_of()) == set() and ids(any_of(EVERYTHING, category == "A")) == {1, 2, 3}
    assert ids(all_of(EVERYTHING, category == "B")) == {2}


@pytest.mark.parametrize("metric", D.METRICS)
def test_knn_kernels_agree_with_numpy(spark, metric, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    corpus = vectors.wave(spark, 100, 16).repartition(4)
    data = {r.id: r.embedding for r in corpus.collect()}
    queries = corpus.where("id < 7").withColumnRenamed("id", "query_id")
    expected = {}
    for q in range(7):
        near = sorted((round(_numpy(metric, data[q], v), 6), i) for i, v in data.items() if i != q)[:5]
        expected[q] = [s for s, _ in near]
    for kernel in ("arrow", "expr"):
        rows = search.knn(queries, corpus, 5, metric, exclude_self=True, kernel=kernel).collect()
        assert len(rows) == 35
        for q in range(7):
            mine = sorted((r.rank, r.score) for r in rows if r.query_id == q)
            assert [r for r, _ in mine] == [1, 2, 3, 4, 5] and [s for _, s in mine] == pytest.approx(expected[q], abs=1e-5)


def test_ties_deletes_and_limits(spark):
    corpus = vectors.from_rows(spark, [[1.0, 0.0]] * 6 + [[0.0, 1.0]], list(range(7)))
    query = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, embedding array<float>")
    got = search.knn(query, corpus, 3, deleted=corpus.where("id = 1").select("id"))
    assert [(r.id, r.rank) for r in got.orderBy("rank").collect()] == [(0, 1), (2, 2), (3, 3)]
    assert search.knn(query, corpus, 0).count() == 0 and search.knn(query.limit(0), corpus, 3).count() == 0
    assert search.knn(query, corpus, 50).count() == 7
    assert [r.id for r in search.nearest([1.0, 0.0], corpus, 2).collect()] == [0, 1]
    assert search.range_search(query, corpus, 0.0).count() == 6 and search.range_search(query, corpus, 0.0, limit=2).count() == 2
    assert search.range_search(query, corpus, -1.0).count() == 0
    with pytest.raises(SearchFailed):
        search.knn(query, corpus, 3, "manhattan")
    with pytest.raises(DimensionMismatch):
        search.check_dimension(corpus, 3)


def test_post_filter_may_find_fewer(spark):
    corpus = vectors.wave(spark, 200, 8).withColumn("rare", F.when(F.col("id") % 50 == 0, "yes"))
    query = corpus.where("id = 3").select(F.col("id").alias("query_id"), "embedding")
    rare = Field("rare") == "yes"
    assert search.knn(query, corpus, 4, where=rare).count() == 4
    assert search.knn(query, corpus, 4, where=rare, mode="post").count() <= 4


@pytest.mark.parametrize("metric", D.METRICS)
def test_range_search_sends_queries_in_blocks(spark, metric, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 5)
    corpus = vectors.wave(spark, 1000, 8).repartition(4)
    data = {r.id: r.embedding for r in corpus.collect()}
    queries = corpus.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    limit = {D.COSINE: 0.1005, D.L2: 2.003, D.INNER_PRODUCT: -5.003, D.HAMMING: 1.5}[metric]
    found = search.range_search(queries, corpus, limit, 2000, metric, exclude_self=True)
    assert found._jdf.queryExecution().toString().count("BroadcastExchange") >= 4  # 20 queries, none of the blocks has all
    expected = {(q, i) for q in range(0, 1000, 50) for i, v in data.items() if i != q and _numpy(metric, data[q], v) <= limit}
    assert expected and {(r.query_id, r.id) for r in found.collect()} == expected


@pytest.mark.parametrize("metric", D.METRICS)
def test_table_function(spark, metric):
    """Candidates in several batches; ties by id, k beyond what there is."""
    rng = np.random.default_rng(3)
    rows = [(q, [float(x) for x in rng.integers(-1, 2, 3)], i, [float(x) for x in rng.integers(-1, 2, 3)]) for q in range(3) for i in range(40 - q)]
    spark.createDataFrame(rows, "query_id long, query array<float>, id long, embedding array<float>").createOrReplaceTempView("candidates")
    tables.register(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for k in (5, 100, 0):
            got = spark.sql(f"SELECT * FROM knn(TABLE(candidates) PARTITION BY (query_id), {k}, '{metric}')").collect()
            want = []
            for q in range(3):
                near = sorted((_numpy(metric, a, b), i) for w, a, i, b in rows if w == q)[:k]
                want += [(q, i, pytest.approx(s, abs=1e-6), r + 1) for r, (s, i) in enumerate(near)]
            if metric in (D.COSINE,):  # equal cosines may differ in the last bit
                assert sorted((r.query_id, round(r.score, 6), r["rank"]) for r in got) == sorted((w[0], round(w[2].expected, 6) + 0.0, w[3]) for w in want)
            else:
                assert [tuple(r) for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))] == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("metric", D.METRICS)
def test_blocks_measure_as_expressions_do(spark, metric):
    """Equal vectors, near equal ones, zeros and large numbers: the rows and the last bits of the plain plan."""
    rng = np.random.default_rng(5)
    some = rng.standard_normal((40, 24))
    rows = np.concatenate([some, some, some * (1 + 1e-15), np.zeros((3, 24)), 1e8 * some[:5], 1e8 * some[:5]])[rng.permutation(133)]
    corpus = vectors.from_rows(spark, rows.tolist(), list(range(len(rows)))).repartition(3)
    queries = corpus.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    scored = search.pairs(queries, corpus, metric, True)
    plain = sorted(map(tuple, search.best(scored, 7).collect()))
    for kernel in ("arrow", "expr"):
        assert sorted(map(tuple, search.knn(queries, corpus, 7, metric, exclude_self=True, kernel=kernel).collect())) == plain
    assert sorted(map(tuple, search.knn_join(queries, corpus, 7, metric, exclude_self=True, cell=50).collect())) == plain
    for bound in (plain[3][2], plain[30][2], 0.5):
        for limit in (5, 70, 100):
            within = sorted(map(tuple, search.best(scored.where(F.col("score") <= bound), limit).collect()))
            assert sorted(map(tuple, search.range_search(queries, corpus, bound, limit, metric, exclude_self=True, kernel="arrow").collect())) == (within if bound >= 0 or metric == D.INNER_PRODUCT else [])


def test_no_search_joins_all_pairs(spark):
    """Plans hold no pair of a query and a row but those found."""
    corpus = vectors.wave(spark, 60, 8)
    queries = corpus.where("id < 5").withColumnRenamed("id", "query_id")
    for frame in (search.range_search(queries, corpus, 0.5, kernel="arrow"), search.range_search(queries, corpus, 0.5, 5, kernel="arrow"), search.knn(queries, corpus, 3, kernel="expr")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_all_distances_in_blocks(spark, monkeypatch):
    """Every pair, as expressions measure it, also by SQL functions with nulls; no pair is shuffled or measured by an expression."""
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(6)
    corpus = vectors.from_rows(spark, [*rng.standard_normal((50, 9)).tolist(), [0.0] * 9], list(range(51)))
    queries = corpus.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    pairs = queries.withColumnRenamed("embedding", "q").crossJoin(corpus)
    plain = sorted(map(tuple, pairs.select("query_id", "id", *[F.round(D.distance(m, F.col("q"), F.col("embedding")), 6) for m in D.METRICS]).collect()))
    found = search.all_distances(queries, corpus, D.METRICS, 6)
    assert sorted(map(tuple, found.collect())) == plain
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "zip_with" not in plan
    assert search.rounded(np.array([0.5, -0.5, 1.25, -1.35]), 0).tolist() == [1.0, -1.0, 1.0, -1.0]
    D.register(spark)
    called = pairs.select("query_id", "id", *[F.expr(f"round({m}_distance(q, embedding), 6)") for m in D.METRICS])
    assert sorted(map(tuple, called.collect())) == plain and "zip_with" not in called._jdf.queryExecution().executedPlan().toString()
    gone = spark.createDataFrame([([1.0, 2.0], [1.0, 3.0]), (None, [1.0, 2.0]), ([1.0, 2.0], None)], "a array<double>, b array<double>")
    assert [r[0] for r in gone.select(F.expr("l2_distance(a, b)")).collect()] == [1.0, None, None]


def test_table_function_gets_few_candidates(spark, tmp_path):
    from tessera import queries

    vectors.wave(spark, 1000, 8).select(F.col("id").alias("vec_id"), "embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.knn_table_function(spark, str(tmp_path))
    assert found.count() == 200 and "NestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
