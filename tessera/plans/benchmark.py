"""Runs searches over a data set and reports recall and speed.

    python -m tessera.plans.benchmark --vectors 1000 --dim 128 --k 10 --sweep 16,32,64 --out report --format csv
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import distance as D
from tessera.operators import evaluate, graph, quantize, search
from tessera.plans.materialize import materialized
from tessera.sources import benchmark_files, vectors


def timed(queries: DataFrame, run, repeats: int = 3, warmup: int = 1) -> dict[str, float]:
    """Milliseconds of whole batches: nearest-rank percentiles; queries a second."""
    spark, n = queries.sparkSession, queries.count()
    times = []
    for i in range(warmup + repeats):
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        if i >= warmup:
            times.append(1000 * (time.perf_counter() - start))
    row = evaluate.summary(spark.createDataFrame([(t,) for t in times], "ms double"), "ms").first()
    return {"qps": 1000 * n / row["mean"], "p50_ms": row["p50"], "p95_ms": row["p95"], "p99_ms": row["p99"]}


def measure(label: str, queries: DataFrame, truth: DataFrame, run, build_ms: float = 0.0, **options) -> dict:
    """A row of the report."""
    found = materialized(run())
    at = {f"recall_at_{n}": float(evaluate.recall(found, truth, n).first()[0] or 0.0) for n in (1, 10, 100)}
    return {"label": label, **at, "build_time_ms": build_ms, **timed(queries, run, **options)}


def _built(make):
    start = time.perf_counter()
    made = make()
    return made, 1000 * (time.perf_counter() - start)


def sweep(corpus: DataFrame, queries: DataFrame, efs: list[int], degree: int = 16, k: int = 10, metric: str = D.COSINE, **options) -> list[dict]:
    """Exact search, then the graph at each ef."""
    truth = materialized(search.knn(queries, corpus, k, metric))
    rows = [measure("exact", queries, truth, lambda: search.knn(queries, corpus, k, metric), **options)]
    edges, ms = _built(lambda: materialized(graph.top_degree((e := graph.exact_graph(corpus, degree, metric)).unionByName(graph.reverse(e)).dropDuplicates(["src", "dst"]), 2 * degree)))
    return rows + [measure(f"graph ef={ef}", queries, truth, lambda ef=ef: graph.beam_search(queries, edges, corpus, k, ef, metric), ms, **options) for ef in efs]


def ivfpq(corpus: DataFrame, queries: DataFrame, probes: list[int], subspaces: int = 8, cells: int = 32, k: int = 10, codes: int = quantize.CODES, **options) -> list[dict]:
    """The quantized index at each number of probes."""
    truth = materialized(search.knn(queries, corpus, k, D.L2))
    index, ms = _built(lambda: quantize.IvfPq.train(corpus, subspaces, cells, 8, codes=codes).add(corpus))
    return [measure(f"ivfpq nprobe={p}", queries, truth, lambda p=p: index.search(queries, k, p), ms, **options) for p in probes]


def frontier(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows that no other beats in recall and speed."""
    return evaluate.pareto(spark.createDataFrame(rows), "recall_at_10", "qps")


def main(args: list[str] | None = None) -> list[dict]:
    from tessera.session import local_session

    numbers = lambda s: [int(x) for x in s.split(",")]
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--vectors", type=int, default=1000)
    p.add_argument("--dim", type=int, default=128)
    p.add_argument("--queries", type=int, default=200)
    p.add_argument("--k", type=int, default=10)
    p.add_argument("--metric", default=D.COSINE, choices=D.METRICS)
    p.add_argument("--degree", type=int, default=32)
    p.add_argument("--sweep", type=numbers, default=[16, 32, 64, 128, 256])
    p.add_argument("--ivfpq", action="store_true")
    p.add_argument("--probes", type=numbers, default=[1, 4, 8, 16])
    p.add_argument("--data", help="a benchmark file instead of generated vectors")
    p.add_argument("--repeats", type=int, default=3)
    p.add_argument("--warmup", type=int, default=1)
    p.add_argument("--out")
    p.add_argument("--format", default="csv", choices=("csv", "json"))
    a = p.parse_args(args)
    spark = local_session()
    if a.data:
        data = benchmark_files.read_benchmark(spark, a.data)
        corpus, queries = data["train"], data["test"].limit(a.queries)
    else:
        corpus = vectors.wave(spark, a.vectors, a.dim)
        queries = vectors.wave(spark, a.queries, a.dim, offset=a.vectors).withColumnRenamed("id", "query_id")
    corpus, queries = materialized(corpus), materialized(queries)
    options = {"repeats": a.repeats, "warmup": a.warmup}
    rows = ivfpq(corpus, queries, a.probes, k=a.k, **options) if a.ivfpq else sweep(corpus, queries, a.sweep, a.degree, a.k, a.metric, **options)
    print(vectors.report_table(rows))
    if a.out:
        vectors.write_report(spark.createDataFrame(rows).select(*[F.col(c) for c in vectors.REPORT_COLUMNS]), a.out, a.format)
    return rows


if __name__ == "__main__":
    main()
