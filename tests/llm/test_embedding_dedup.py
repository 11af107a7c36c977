"""Near-duplicate vectors against all pairs."""

import numpy as np
import pytest

from tessera.llm import embedding_dedup
from tessera.llm.embedding_dedup import near_duplicates, table_shape
from tessera.llm.queries import op1_embedding_dedup


def _brute(ids, vectors, threshold=0.95):
    unit = np.zeros((len(ids), max((len(v) for v in vectors if v), default=1)))
    usable = np.zeros(len(ids), bool)
    for i, v in enumerate(vectors):
        if v and None not in v and np.isfinite(v).all() and np.any(v):
            unit[i, : len(v)] = np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))
            usable[i] = True
    linked = (unit @ unit.T >= threshold) & usable[:, None] & usable[None, :]
    np.fill_diagonal(linked, False)
    component = np.arange(len(ids))
    while True:
        new = np.array([min([component[i], *component[np.flatnonzero(linked[i])]]) for i in range(len(ids))])
        if (new == component).all():
            return sorted((ids[i], int(linked[i].sum()), ids[component[i]], ids[i] == ids[component[i]]) for i in range(len(ids)))
        component = new


@pytest.mark.parametrize("small", [32, 3])
def test_against_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(embedding_dedup, "SMALL", small)
    rng = np.random.default_rng(small)
    rows = []
    for size in (1, 1, 1, 2, 5, 40):
        base = rng.standard_normal(24)
        rows += [(base + rng.standard_normal(24) * rng.uniform(0, 0.33)).astype(np.float32).tolist() for _ in range(size)]
    rows += [rows[0], rows[0], [-x for x in rows[0]], None, [], [0.0] * 24, [float("nan")] * 24, [1.0, None], [float("inf")] + [0.0] * 23, [2 * x for x in rows[-1]]]
    rows += rng.standard_normal((60, 24)).astype(np.float32).tolist()
    ids = rng.permutation(len(rows)).tolist()
    order = np.argsort(ids)
    ids, rows = [ids[i] for i in order], [rows[i] for i in order]
    for kind in ("float", "double"):
        vectors = spark.createDataFrame(list(zip(ids, rows, strict=True)), f"vec_id long, embedding array<{kind}>").repartition(4)
        for block in (1024, 4):
            assert sorted(map(tuple, near_duplicates(vectors, block=block).collect())) == _brute(ids, rows)


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    assert sorted(map(tuple, op1_embedding_dedup(spark, sf).collect())) == _brute([r.vec_id for r in rows], [list(r.embedding) for r in rows])


def test_edges(spark):
    vectors = spark.createDataFrame([(None, [1.0, 2.0], "x"), (4, [1.0, 2.0], "y"), (4, [1.0, 2.0], None), (5, [1.0, 2.0, 0.0], "z")], "vec_id long, embedding array<double>, n_links string")
    assert sorted(map(tuple, near_duplicates(vectors).collect()), key=str) == sorted([(None, 2, 4, True), (4, 2, 4, True), (4, 2, 4, True), (5, 0, 5, True)], key=str)
    assert near_duplicates(vectors.where("false")).count() == 0
    assert [table_shape(n)[0] for n in (1, 500, 50_000, 5_000_000)] == [8, 11, 18, 25]
