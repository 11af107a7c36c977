"""The index facade, storage, streams and benchmark files."""

import time

import pytest
from pyspark.sql import functions as F

from tessera.errors import ConstructionFailed, CorruptIndex, DimensionMismatch, IdAlreadyExists, IdNotFound, IndexEmpty, SearchFailed
from tessera.functions import distance as D
from tessera.operators import search
from tessera.operators.filters import Field
from tessera.plans.index import Configuration, Index, Metrics, ReadOnlyIndex, UnbuiltIndex
from tessera.sources import benchmark_files, store, vectors
from tessera.streaming.index import StreamingIndex, event_windows


def _ids(found):
    return [r.id for r in found.orderBy("rank").collect()]


def test_lifecycle(spark, tmp_path):
    corpus = vectors.wave(spark, 100, 16)
    data = {r.id: r.embedding for r in corpus.collect()}
    index = UnbuiltIndex(spark, Configuration(degree=8)).build(corpus, metrics=True)
    assert _ids(index.search(data[5], 1)) == [5]
    index.insert(vectors.wave(spark, 20, 16, offset=500).withColumn("id", F.col("id") + 100))
    assert index.count() == 120
    with pytest.raises(IdAlreadyExists):
        index.insert(corpus.limit(1))
    with pytest.raises(DimensionMismatch):
        index.insert(vectors.wave(spark, 1, 8, offset=9).withColumn("id", F.lit(999)))
    index.set_metadata(spark.createDataFrame([(1, "A", 5), (2, "B", None)], "id long, category string, score long"))
    index.set_metadata(spark.createDataFrame([(2, 7)], "id long, score long"))
    assert {r.id: (r.category, r.score) for r in index.corpus.where("id < 4 AND id > 0").collect()} == {1: ("A", 5), 2: ("B", 7), 3: (None, None)}
    assert _ids(index.search(data[5], 5, Field("category") == "B")) == [2]
    gone = spark.createDataFrame([(5,), (2,)], "id long")
    index.delete(gone)
    index.delete(gone)
    assert 5 not in _ids(index.search(data[5], 3)) and index.count() == 118
    with pytest.raises(IdNotFound):
        index.delete(spark.createDataFrame([(12345,)], "id long"))
    with pytest.raises(IdAlreadyExists):
        index.insert(corpus.where("id = 5"))
    before = _ids(index.search(data[7], 10))
    index.save(str(tmp_path / "index"))
    for state in (UnbuiltIndex(spark).open(str(tmp_path / "index")), UnbuiltIndex(spark).load(str(tmp_path / "index"))):
        assert _ids(state.search(data[7], 10)) == before and state.config.degree == 8 and state.count() == 118
    assert not hasattr(ReadOnlyIndex, "insert") and not hasattr(UnbuiltIndex, "search") and issubclass(Index, ReadOnlyIndex)
    index.undelete(spark.createDataFrame([(5,)], "id long"))
    assert 5 in _ids(index.search(data[5], 3))
    index.compact()
    assert index.count() == 119 and index.deleted is None
    index.insert(corpus.where("id = 2"))
    assert index.count() == 120
    row = index.metrics.snapshot(spark).first()
    assert row.insert_count == 21 and row.search_count >= 4 and row.p50_ms > 0
    with pytest.raises(SearchFailed):
        index.search(data[5], 3, metric="hamming")


def test_graph_and_binary(spark):
    corpus = vectors.wave(spark, 80, 16)
    index = UnbuiltIndex(spark, Configuration(degree=12, graph=True, rounds=4)).build(corpus)
    queries = corpus.where("id < 5").withColumnRenamed("id", "query_id")
    assert index.graph_search(queries, 3).count() == 15
    index.insert(vectors.wave(spark, 5, 16, offset=900).withColumn("id", F.col("id") + 80))
    assert index.repair(spark.createDataFrame([(80,)], "id long")) >= 0
    index.delete(spark.createDataFrame([(0,)], "id long"))
    assert 0 not in {r.id for r in index.graph_search(queries, 5).collect()}
    index.compact()
    assert index.count() == 84
    binary = UnbuiltIndex(spark, Configuration(metric=D.HAMMING, binary=True)).build(corpus)
    plain = search.knn(queries, corpus, 5, D.HAMMING)
    assert {tuple(r) for r in binary.batch_search(queries, 5).collect()} == {tuple(r) for r in plain.collect()}
    half = UnbuiltIndex(spark, Configuration(half=True)).build(corpus)
    assert half.range_search(queries, 0.001).where("query_id = id").count() == 5
    for bad in (Configuration(binary=True), Configuration(metric=D.HAMMING)):
        with pytest.raises(ConstructionFailed):
            UnbuiltIndex(spark, bad).build(corpus)
    with pytest.raises(IndexEmpty):
        UnbuiltIndex(spark).build(corpus.limit(0))
    with pytest.raises(IdAlreadyExists):
        UnbuiltIndex(spark).build(corpus.union(corpus))


def test_store(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(CorruptIndex):
        store.load(spark, root)
    for n in (3, 4, 5, 6):
        store.save(spark, root, {"t": spark.range(n)}, {"n": n})
    tables, config = store.load(spark, root)
    assert tables["t"].count() == 6 and config == {"n": 6} and store.versions(spark, root) == [3, 4]
    store.delete(spark, f"{root}/v4/t")
    with pytest.raises(CorruptIndex):
        store.load(spark, root)


def test_stream(spark, tmp_path):
    corpus = vectors.wave(spark, 100, 8)
    source = str(tmp_path / "source")
    corpus.repartition(5).write.parquet(source)
    index = StreamingIndex(spark, str(tmp_path / "index"), D.L2, delta_capacity=48)  # three files of 19 to 21 rows, and no merge by the last three rows
    with pytest.raises(IndexEmpty):
        index.stored()
    stream = spark.readStream.schema(corpus.schema).option("maxFilesPerTrigger", 1).parquet(source)
    index.start(stream, str(tmp_path / "checkpoint")).awaitTermination()
    assert index.count() == 100 and index.merges >= 1
    queries = corpus.where("id < 10").withColumnRenamed("id", "query_id")
    want = {(r.query_id, r.id, round(r.score, 6)) for r in search.knn(queries, corpus, 5, D.L2).collect()}
    assert {(r.query_id, r.id, round(r.score, 6)) for r in index.search(queries, 5).collect()} == want
    index.delete(spark.createDataFrame([(3,)], "id long"))
    with pytest.raises(IdNotFound):
        index.delete(spark.createDataFrame([(3,)], "id long"))
    with pytest.raises(IdAlreadyExists):
        index.insert(corpus.where("id = 3"))
    with pytest.raises(IdAlreadyExists):
        index.insert(corpus.where("id = 4"))
    index.insert(vectors.wave(spark, 3, 8, offset=700).withColumn("id", F.col("id") + 100))
    assert index.flush() and not index.flush() and index.count() == 102
    assert index.range_search(queries, 0.0).where("query_id = 3").count() == 0
    index.save(str(tmp_path / "copy"))
    copy = StreamingIndex(spark, str(tmp_path / "copy"), D.L2)
    assert copy.count() == 102 and {r.id for r in copy.active().select("id").collect()} == {r.id for r in index.active().select("id").collect()}
    with pytest.raises(IdAlreadyExists):
        copy.insert(corpus.where("id = 3"))  # deleted before it was saved
    with pytest.raises(IndexEmpty):
        StreamingIndex(spark, str(tmp_path / "nothing"), D.L2).save(str(tmp_path / "copy2"))
    again = StreamingIndex(spark, str(tmp_path / "index"), D.L2)
    assert again.count() == 102 and {r.id for r in again.search(queries, 1).where("query_id <> 3").collect()} == set(range(10)) - {3}


def test_stream_restarts_keep_all(spark, tmp_path):
    rows = lambda *ids: vectors.wave(spark, 60, 8).where(F.col("id").isin(list(ids)))
    source, root = str(tmp_path / "source"), str(tmp_path / "index")
    index = StreamingIndex(spark, root, D.L2)

    def feed(*ids, checkpoint="checkpoint"):
        rows(*ids).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows(1).schema).parquet(source)
        index.start(stream.where(F.col("id").isin(list(ids))), str(tmp_path / checkpoint)).awaitTermination()

    held = lambda: sorted(r.id for r in StreamingIndex(spark, root, D.L2).active().collect())
    index.insert(rows(1, 2))
    feed(10, 11)
    index.insert(rows(3))
    feed(20, 21)
    assert held() == [1, 2, 3, 10, 11, 20, 21]
    assert index.merge() and held() == [1, 2, 3, 10, 11, 20, 21]
    feed(30)
    index.insert(rows(4))
    feed(40, checkpoint="another")  # a second stream
    assert held() == [1, 2, 3, 4, 10, 11, 20, 21, 30, 40] and index.merge()
    stream = next(iter(index._pointer()["upto"]))
    index._insert(rows(50), f"{stream}-0")  # a merged batch that is run again
    assert held() == [1, 2, 3, 4, 10, 11, 20, 21, 30, 40]


def test_stream_metadata_and_few_survivors(spark, tmp_path):
    corpus = vectors.wave(spark, 20, 8)
    index = StreamingIndex(spark, str(tmp_path / "index"), D.L2, delta_capacity=8, background=True, metrics=Metrics())
    for part in range(4):
        index.insert(corpus.where(F.col("id") % 4 == part))
    index.set_metadata(spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id long, kind string, n long"))
    index.set_metadata(spark.createDataFrame([(2, 7)], "id long, n long"))
    with pytest.raises(IdNotFound):
        index.set_metadata(spark.createDataFrame([(99, 7)], "id long, n long"))
    with pytest.raises(IdAlreadyExists):
        index.set_metadata(spark.createDataFrame([(2, 7), (2, 8)], "id long, n long"))
    index.flush()
    values = {r.id: (r.kind, r.n) for r in index.active().where("kind IS NOT NULL").collect()}
    assert values == {1: ("a", 5), 2: ("b", 7)} and index.count() == 20 and index.merges >= 1
    queries = corpus.where("id < 3").withColumnRenamed("id", "query_id")
    assert {r.id for r in index.search(queries, 3, Field("kind") == "b").collect()} == {2}
    assert index.metrics.inserts == 20 and index.metrics.merges == index.merges and index.metrics.batch_searches == 1
    few = StreamingIndex(spark, str(tmp_path / "few"), D.L2)
    few.insert(corpus.where("id < 3"))
    few.delete(corpus.where("id < 2").select("id"))
    assert not few.merge() and few.count() == 1 and few.merges == 0
    few.delete(corpus.where("id = 2").select("id"))
    assert not few.merge() and few.count() == 0 and few.merges == 0 and few._open_deltas() == []
    few.insert(corpus.where("id > 15"))
    assert few.merge() and few.count() == 4


def test_blocks_of_queries(spark, monkeypatch):
    corpus = vectors.wave(spark, 90, 8)
    queries = corpus.withColumnRenamed("id", "query_id")
    rows = lambda: sorted(map(tuple, search.knn(queries, corpus, 4, D.L2).collect()))
    whole = rows()
    monkeypatch.setattr(search, "QUERY_BLOCK", 20)
    assert rows() == whole


def test_graph_search_with_filter_and_repair(spark):
    corpus = vectors.wave(spark, 80, 16).withColumn("kind", F.col("id") % 3)
    index = UnbuiltIndex(spark, Configuration(degree=12, graph=True, rounds=4, repair_interval=4)).build(corpus)
    index.insert(vectors.wave(spark, 5, 16, offset=900).withColumn("id", F.col("id") + 80).withColumn("kind", F.lit(0).cast("long")))
    assert index._unrepaired is None  # five waited, four are enough
    index.delete(spark.createDataFrame([(3,)], "id long"))
    queries = corpus.where("id < 5").withColumnRenamed("id", "query_id").drop("kind")
    found = index.graph_search(queries, 3, Field("kind", "int") == 0).collect()
    assert len(found) == 15 and all(r.id % 3 == 0 or r.id >= 80 for r in found) and 3 not in {r.id for r in found}
    with pytest.raises(IdAlreadyExists):
        index.set_metadata(spark.createDataFrame([(2, 7), (2, 8)], "id long, kind long"))


def test_event_windows_on_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    source = str(tmp_path / "events")
    events.repartition(2).write.parquet(source)
    stream = event_windows(spark.readStream.schema(events.schema).parquet(source), "1 hour")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()


def test_benchmark_file_and_reports(spark, tmp_path):
    train = vectors.from_rows(spark, [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0.9, 0.1, 0, 0]], [0, 1, 2])
    test = vectors.from_rows(spark, [[1.0, 0, 0, 0], [0, 1.0, 0, 0]], [0, 1]).withColumnRenamed("id", "query_id")
    truth = search.knn(test, train, 3)
    path = str(tmp_path / "data.bin")
    benchmark_files.write_benchmark(path, train, test, truth, "cosine")
    back = benchmark_files.read_benchmark(spark, path)
    assert back["metric"] == "cosine" and [r.id for r in back["truth"].orderBy("query_id", "rank").collect()] == [0, 2, 1, 1, 2, 0]
    assert back["train"].orderBy("id").collect() == train.orderBy("id").collect()
    (tmp_path / "bad.bin").write_bytes(b"nothing")
    with pytest.raises(CorruptIndex):
        benchmark_files.read_benchmark(spark, str(tmp_path / "bad.bin"))
    row = {"label": "a", "recall_at_1": 1.0, "recall_at_10": 1.0, "recall_at_100": 1.0, "qps": 10.0, "build_time_ms": 1.0, "p50_ms": 1.0, "p95_ms": 2.0, "p99_ms": 3.0}
    for kind in ("csv", "json"):
        vectors.write_report(spark.createDataFrame([row]), str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1 and "recall_at_10" in vectors.report_table([row])


def test_merge_while_levels_are_read(spark, tmp_path, monkeypatch):
    corpus = vectors.wave(spark, 10, 8)
    index = StreamingIndex(spark, str(tmp_path / "index"), D.L2)
    index.insert(corpus.where("id < 5"))
    index.insert(corpus.where("id >= 5"))
    index.set_metadata(spark.createDataFrame([(3, "a")], "id long, kind string"))
    read, merges = index.base, []

    def base():
        rows = read()
        if not merges:
            merges.append(True)
            assert index.merge()
        return rows

    monkeypatch.setattr(index, "base", base)
    assert sorted((r.id, r.kind) for r in index.active().collect()) == [(i, "a" if i == 3 else None) for i in range(10)]


def _stop_after(query, done):
    """Batches go on without new rows, as timers may run out."""
    until = time.monotonic() + 120
    while not (reached := done()) and query.isActive and time.monotonic() < until:
        time.sleep(0.2)
    query.stop()
    assert query.exception() is None and reached, [p.json for p in query.recentProgress]


def test_rows_wait_in_the_state(spark, tmp_path):
    corpus = vectors.wave(spark, 60, 8).withColumn("n", F.when(F.col("id") % 2 == 0, F.col("id")))
    source, root, checkpoint = str(tmp_path / "source"), str(tmp_path / "index"), str(tmp_path / "checkpoint")
    index = StreamingIndex(spark, root, D.L2)
    index.insert(corpus.where("id < 5"))
    index.delete(corpus.where("id = 2").select("id"))

    def feed(rows, **options):
        rows.coalesce(1).write.mode("append").parquet(source)
        options = {"hold": 1000, "wait": 3600.0, "buckets": 4} | options
        n, query = rows.count(), index.start_held(spark.readStream.schema(corpus.schema).parquet(source), checkpoint, **options)
        _stop_after(query, lambda: sum(p.numInputRows for p in query.recentProgress) >= n)

    held = lambda: sorted(r.id for r in StreamingIndex(spark, root, D.L2).active().collect())
    rows = lambda low, high: corpus.where((F.col("id") >= low) & (F.col("id") < high))
    feed(rows(0, 12))  # ids 0 to 4 are known, 2 was deleted
    assert index.pending().count() == 7 and held() == [0, 1, 3, 4, *range(5, 12)]
    assert sorted(r.id for r in index.refused().collect()) == [0, 1, 2, 3, 4]
    assert {(r.id, r.n) for r in index.pending().collect()} == {(i, i if i % 2 == 0 else None) for i in range(5, 12)}
    with pytest.raises(ConstructionFailed):
        index.insert(rows(50, 51))
    feed(rows(10, 14).unionByName(rows(13, 14)))  # started again: 10 and 11 wait, 13 comes twice
    assert index.pending().count() == 9 and held() == [0, 1, 3, 4, *range(5, 14)]
    assert sorted(r.id for r in index.refused().collect()) == [0, 1, 2, 3, 4, 10, 11, 13]
    queries = rows(0, 60).withColumnRenamed("id", "query_id").select("query_id", "embedding")
    want = {tuple(r) for r in search.knn(queries, corpus.where("id < 14 AND id <> 2").select("id", "embedding"), 3, D.L2).select("query_id", "id").collect()}
    assert {tuple(r) for r in index.search(queries, 3).select("query_id", "id").collect()} == want
    # what is told of rows that wait, or deleted among them, holds when they come
    index.set_metadata(spark.createDataFrame([(4, "d"), (12, "x")], "id long, kind string"))
    index.delete(corpus.where("id = 13").select("id"))
    feed(rows(14, 40), hold=8)  # two rows of a bucket are enough
    assert index.pending().count() <= 4 and held() == [0, 1, 3, 4, *range(5, 13), *range(14, 40)]
    assert index.merge() and held() == [0, 1, 3, 4, *range(5, 13), *range(14, 40)]
    feed(rows(30, 44), hold=1)  # a bucket goes on when a row comes to it
    assert index.pending().count() <= 3
    with pytest.raises(ConstructionFailed):
        index.start_held(spark.readStream.schema(corpus.schema).parquet(source), checkpoint, hold=0)
    assert index.merge() and held() == [0, 1, 3, 4, *range(5, 13), *range(14, 44)]
    assert {r.id: r.kind for r in index.active().where("kind IS NOT NULL").collect()} == {4: "d", 12: "x"}
    feed(rows(44, 46).unionByName(rows(13, 14)))
    index.release()
    assert index._holding() is None and held() == [0, 1, 3, 4, *range(5, 13), *range(14, 46)]
    with pytest.raises(ConstructionFailed):
        feed(rows(46, 47))
    index.insert(rows(50, 52))
    assert index.merge() and held() == [0, 1, 3, 4, *range(5, 13), *range(14, 46), 50, 51]


def test_rows_wait_no_longer_than_asked(spark, tmp_path):
    corpus, source = vectors.wave(spark, 6, 8), str(tmp_path / "source")
    index = StreamingIndex(spark, str(tmp_path / "index"), D.L2)
    corpus.coalesce(1).write.parquet(source)
    query = index.start_held(spark.readStream.schema(corpus.schema).parquet(source), str(tmp_path / "checkpoint"), wait=1.0, buckets=2)
    _stop_after(query, lambda: index.delta() is not None and index.delta().count() == 6)
    assert index.delta().count() == 6 and index.pending().count() == 0 and index.refused() is None
