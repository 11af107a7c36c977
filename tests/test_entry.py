"""Every core query gives the rows of its SQL."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from tessera import queries as core
from tessera.functions import distance as D

SF = "/root/testdata/sf0.001"
#: Queries whose rows SQL cannot give; tests below hold them against brute force.
APPROXIMATE = {"shard_graph_search", "graph_insert_walk", "ivfpq_trained", "nn_descent", "beam_search", "hnsw_search", "index_graph", "graph_repair", "kmeans_seeded"}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in "customer documents embeddings events labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v


def test_queries(spark, tables):
    known, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(core.oracle_sql()) == set(core.queries()) - APPROXIMATE and set(core.queries()) <= set(known)
    wrong = []
    for name in core.oracle_sql():
        frame = known[name](spark, SF)
        columns = sorted(frame.columns)
        ours = sorted((tuple(_plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
        result = tables.execute(sql[name])
        order = [[d[0] for d in result.description].index(c) for c in columns]
        if ours != sorted((tuple(_plain(r[i]) for i in order) for r in result.fetchall()), key=repr):
            wrong.append(name)
    assert not wrong


def _recall(tables, rows, truth, width=10):
    """The share of the true (query, neighbour) pairs that were found."""
    want = {(q, i) for q, i, r in tables.execute(f"SELECT query_id, id, rank FROM ({truth})").fetchall() if r <= width}
    return len(want & set(rows)) / len(want)


def test_approximate_searches(spark, tables):
    known = __spark_entry__.queries()
    pairs = lambda name: [(r[0], r[1]) for r in known[name](spark, SF).select("query_id", "id").collect()]
    for name, metric, where in (("ivfpq_trained", D.L2, "true"), ("shard_graph_search", D.L2, "true"), ("beam_search", D.COSINE, "true"), ("hnsw_search", D.COSINE, "true")):
        rows = pairs(name)
        assert len(rows) == 100 and _recall(tables, rows, core._knn_sql(metric, where=where)) >= 0.9, name
    rows = pairs("index_graph")
    assert _recall(tables, rows, core._knn_sql(D.L2, corpus=core._META, where="id % 4 <> 0 AND coalesce(lang = 'en', false)")) >= 0.9
    edges = known["nn_descent"](spark, SF).select("src", "dst").collect()
    everyone = "(SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings)"
    assert len(edges) == 5000 and _recall(tables, map(tuple, edges), core._knn_sql(D.COSINE, queries=everyone)) >= 0.9


def test_insertion_by_walks(spark, tables):
    edges = [tuple(r) for r in __spark_entry__.queries()["graph_insert_walk"](spark, SF).select("src", "dst").collect()]
    new = {i for (i,) in tables.execute("SELECT vec_id FROM embeddings WHERE vec_id % 5 = 0").fetchall()}
    near = core._knn_sql(D.COSINE, queries="(SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 5 = 0)")
    assert _recall(tables, [e for e in edges if e[0] in new], near) >= 0.9
    assert new <= {d for _, d in edges} and len(edges) == len(set(edges))
    assert max(Counter(s for s, _ in edges).values()) <= 24


def test_repair_and_seeds(spark, tables):
    known = __spark_entry__.queries()
    edges = [tuple(r) for r in known["graph_repair"](spark, SF).select("src", "dst").collect() if r.src % core.EVERY == 0]
    near = core._knn_sql(D.COSINE, k=8)
    assert _recall(tables, edges, near, 8) >= 0.9  # half before
    rows = known["kmeans_seeded"](spark, SF).collect()
    assert sum(r.n for r in rows) == 500 and len(rows) == 8
    spread = tables.execute("SELECT sum(list_dot_product(e, e)) FROM (SELECT embedding::DOUBLE[] AS e FROM embeddings)").fetchone()[0]
    assert sum(r.error for r in rows) < spread and max(r.drift for r in rows) < 0.01  # near a fixed point


def test_names_need_no_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__spark_entry__.__file__).parent, check=True)


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["query_id", "id", "score", "rank"] and rows.count() == 100
