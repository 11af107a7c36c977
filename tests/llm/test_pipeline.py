"""The pipeline's stages take effect, and equal brute force where that is defined."""

import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.decontaminate import contaminated

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    results = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == COLUMNS
        results.append({r.doc_id: r for r in docs.collect()})
    judged, single, cut, clean = results
    assert 0 < len(clean) <= len(cut) == len(single) < len(judged) < 1000
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert len(toxic & set(judged)) <= 0.1 * len(toxic)
    # near copies, by brute force on what was judged good
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, r in judged.items() for w in [_words((r.text or "").lower())]}
    ids = sorted(sets)
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 0.8 * max(len(a), len(b)) <= min(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    assert set(single) == {d for d in ids if root(d) == d}
    # repeated passages, by brute force on what was single
    seen = Counter(tuple(w[i : i + 35]) for r in single.values() for w in [_words(r.text)] for i in range(len(w) - 34))
    for d, r in single.items():
        w = _words(r.text)
        gone = {i + k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(35)}
        assert _words(cut[d].text) == [x for i, x in enumerate(w) if i not in gone]
        assert cut[d].n_chars == (len(cut[d].text) if gone else r.n_chars)
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert contaminated(docs, benchmark).count() == 0
    packed = corpus_pipeline.pack(spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(clean) and sum(r.length for r in packed) > 4096


def test_run(spark):
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and {"sequence_id", "offset", "doc_id"} <= set(rows.columns)


def test_rows_and_names_survive(spark):
    """Repeated ids with other texts, and columns named like results of the operators."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 400").limit(40)
    docs = docs.withColumn("doc_id", (F.col("doc_id") % 3).cast("long")).withColumn("kept", F.lit("mine")).withColumn("n_removed", F.lit("k")).withColumn("kept_text", F.lit("t")).withColumn("__chunk", F.lit("c")).withColumn("node", F.lit("n"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == [*COLUMNS, "kept", "n_removed", "kept_text", "__chunk", "node"]
        assert {(r.kept, r.n_removed, r.kept_text, r["__chunk"], r.node) for r in docs.collect()} <= {("mine", "k", "t", "c", "n")}
        assert 10 < docs.count() <= before
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
