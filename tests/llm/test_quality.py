"""Ordinal quality: held-out accuracy, and the defined edge cases."""

import numpy as np

from tessera.llm import quality
from tessera.llm.queries import op4_quality

SF = "/root/testdata/sf0.1"


def test_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held_out = "pmod(xxhash64(doc_id), 5) = 0"
    model = quality.train(docs, labels.where(f"NOT ({held_out})"))
    assert model.thresholds[0] < model.thresholds[1]
    rows = quality.judge(docs.join(quality.graded(labels.where(held_out)), "doc_id"), model).select("grade", "kept", "expected_grade").collect()
    kept = {g: [r.kept for r in rows if r.grade == g] for g in range(3)}
    assert np.mean(kept[0]) < 0.1 and np.mean(kept[1]) < 0.2 and np.mean(kept[2]) > 0.97
    mean = [np.mean([r.expected_grade for r in rows if r.grade == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "words " * 3000, "z"), (2, "", "y")], "doc_id long, text string, p_good string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in quality.graded(labels).collect()] == [(1, 1)]
    for model in (quality.train(docs, labels), quality.train(docs, labels.where("false"))):
        rows = quality.judge(docs, model).collect()
        assert len(rows) == 4 and all(0 <= r.expected_grade <= 2 and isinstance(r.p_good, float) for r in rows)
    assert all(r.kept for r in rows)
    assert quality.judge(docs.where("false"), model).count() == 0


def test_query_keeps_rows_of_the_table(spark):
    out = op4_quality(spark, "/root/testdata/sf0.01")
    assert out.columns == ["doc_id", "expected_grade", "p_good", "kept"] and 700 < out.count() < 1000
