"""The benchmark runner."""

from tessera.plans import benchmark
from tessera.plans.materialize import materialized
from tessera.sources import vectors


def test_rows(spark):
    corpus = materialized(vectors.wave(spark, 120, 16))
    queries = materialized(vectors.wave(spark, 5, 16, offset=1000).withColumnRenamed("id", "query_id"))
    rows = benchmark.sweep(corpus, queries, [16], 8, repeats=1, warmup=0) + benchmark.ivfpq(corpus, queries, [4], 4, 4, codes=32, repeats=1, warmup=0)
    assert [r["label"] for r in rows] == ["exact", "graph ef=16", "ivfpq nprobe=4"]
    assert rows[0]["recall_at_10"] == 1.0 and all(set(vectors.REPORT_COLUMNS) == set(r) for r in rows)
    assert benchmark.frontier(spark, rows).count() >= 1
