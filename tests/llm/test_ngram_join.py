"""Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from tessera.llm import ngram_join
from tessera.llm.ngram_join import Similarity, forest, jaccard_components, one_of_each, shingle_sets, signatures


def _sets(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def _brute(ids, texts, how):
    sets, parent = _sets(texts, how.words), list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j] and how.whole * len(sets[i] & sets[j]) >= how.part * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, d in enumerate(ids))


def _corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "one", "One two", "one two", "one two three", "ONE  two\tthree"]
    for n in (9, 10, 11, 12, 20, 21, 30, 60, 61, 100, 200, 400):
        base = rng.choices(words, k=n)
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                at = rng.randrange(len(copy))
                if rng.random() < 0.5:
                    copy[at] = rng.choice(words)
                else:
                    del copy[at]
            texts.append(" ".join(copy))
    return list(range(len(texts))), texts


@pytest.mark.parametrize(("seed", "how"), [(1, Similarity()), (2, Similarity(5, 80, 100)), (3, Similarity(1, 70, 100))])
def test_against_all_pairs(spark, seed, how):
    ids, texts = _corpus(seed)
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    expected = _brute(ids, texts, how)
    assert sorted(map(tuple, jaccard_components(docs, how).collect())) == expected


def test_large_groups_and_cells(spark, monkeypatch):
    for name, value in (("SMALL", 1), ("BLOCK", 200)):
        monkeypatch.setattr(ngram_join, name, value)
    ids, texts = _corpus(4)
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(docs).collect())) == _brute(ids, texts, Similarity())


@pytest.mark.parametrize("two", [False, True])
def test_forest_joins_what_links(two):
    rng = np.random.default_rng(7)
    base = np.unique(rng.integers(0, 1 << 40, 120).astype(np.uint64))
    sets = [np.unique(np.append(rng.permutation(base)[: len(base) - rng.integers(0, 14)], rng.integers(0, 300, rng.integers(1, 9)).astype(np.uint64))) for _ in range(150)]
    block = np.arange(150) % 2 if two else np.zeros(150, int)
    how = Similarity()
    near = lambda i, j: how.whole * len(np.intersect1d(sets[i], sets[j])) >= how.part * len(np.union1d(sets[i], sets[j]))

    def classes(links):
        label = list(range(150))
        for i, j in links:
            label = [label[i] if x == label[j] else x for x in label]
        return label

    all_links = [(i, j) for i in range(150) for j in range(i) if (not two or block[i] != block[j]) and near(i, j)]
    found = forest(sets, block, how)
    assert len(found) < 150 and all(near(i, j) for i, j in found)
    group = lambda label: {tuple(i for i in range(150) if label[i] == x) for x in label}
    assert group(classes(found)) == group(classes(all_links)) and len(group(classes(found))) > 3


@pytest.mark.parametrize("how", [Similarity(), Similarity(5, 80, 100)])
def test_linked_sets_share_a_signature(how):
    import pyarrow as pa

    from tessera.llm.kernels import text_buffer

    _, texts = _corpus(5)
    signature, doc = signatures(shingle_sets(*text_buffer(pa.array(texts)), how.words), how)
    own = [set(signature[doc == i].tolist()) for i in range(len(texts))]
    sets = _sets(texts, how.words)
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] != sets[j] and how.whole * len(sets[i] & sets[j]) >= how.part * len(sets[i] | sets[j])]
    assert len(linked) > 20 and all(own[i] & own[j] for i, j in linked)
    assert np.mean([len(x) for x in own]) < 400


def test_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d", "x"), (5, "a b c d", "y"), (5, "a b c d", "y"), (7, "", None), (None, None, "z")], "doc_id long, text string, component_id string")
    rows = sorted(map(tuple, jaccard_components(docs).collect()), key=str)
    assert rows == sorted([(None, 2, 5), (5, 2, 5), (5, 2, 5), (7, 0, 7), (None, 0, None)], key=str)
    assert jaccard_components(docs.where("false")).count() == 0
    kept = one_of_each(docs, Similarity(5, 80, 100))
    # of the three rows that link one stays; rows without a set stay
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["5", "7", "None"]


def test_one_of_each_tells_rows_apart_by_text(spark):
    a, b, c = ("apple pie with cream and sugar", "quite another text of seven words here", "third text that has no namesake at all")
    rows = [(5, a, "w"), (5, b, "x"), (1, c, "y"), (2, c, "y"), (2, a, "z"), (None, b, "n"), (None, "only text of a row without id", "n"), (None, "only text of a row without id", "n"), (9, "", "e"), (9, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = one_of_each(docs, Similarity(5, 80, 100))
    assert kept.columns == docs.columns
    expected = [(1, c), (2, a), (5, b), (9, ""), (9, None), (None, "only text of a row without id")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(expected, key=str)
    ints = docs.withColumn("doc_id", docs.doc_id.cast("int"))
    assert one_of_each(ints, Similarity(5, 80, 100)).count() == 6 and one_of_each(docs.where("false"), Similarity()).count() == 0


def test_long_text(spark):
    rng = random.Random(3)
    long = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(long[5:])), (3, " ".join(reversed(long)))], "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(docs).collect())) == [(1, 149_998, 1), (2, 149_993, 1), (3, 149_998, 3)]


def test_sizes_in_steps_lose_no_pair():
    size = np.append(np.arange(1, 3000), [10**5, 10**6, 10**7])
    step = ngram_join.size_steps(size).astype(int)
    largest = np.append(ngram_join.STEPS[1:] - 1, 1 << 40)
    assert (ngram_join.STEPS[step] <= size).all() and (size <= largest[step]).all()


def test_texts_and_few_rows_move(spark):
    import pyarrow as pa

    from tessera.llm.kernels import text_buffer
    from tessera.llm.spark_util import sieved

    _, texts = _corpus(6)
    how = Similarity(5, 80, 100)
    sets = shingle_sets(*text_buffer(pa.array(texts)), how.words)
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    rows = pa.Table.from_batches(list(ngram_join._rebuild(how)(iter([batch]))))
    own = dict(zip(sets.hashes.view(np.int64).tolist(), (sets.elements[a:b].tolist() for a, b in zip(sets.bounds[:-1], sets.bounds[1:], strict=True)), strict=True))
    assert {n: x.tolist() for n, x in zip(rows["node"].to_pylist(), ngram_join._unpacked(rows["packed"], how), strict=True)} == {n: x for n, x in own.items() if n}
    # what is stored and moved is less than half of the sets
    assert sum(len(x) for x in rows["packed"].to_pylist()) < 0.5 * 8 * sum(len(own[n]) for n in rows["node"].to_pylist())
    # a join with given keys moves the rows that have them, and hardly any others
    docs, keys = spark.range(20_000).withColumnRenamed("id", "doc_id"), spark.range(100, 200).withColumnRenamed("id", "doc_id")
    inside = [r.doc_id for r in sieved(docs, "doc_id", keys).collect()]
    outside = [r.doc_id for r in sieved(docs, "doc_id", keys, inside=False).collect()]
    assert set(range(100, 200)) <= set(inside) and len(inside) < 130 and sorted(inside + outside) == list(range(20_000))
    assert sieved(docs, "doc_id", keys.where("false")).count() == 0
    assert sorted(r.doc_id for r in ngram_join._without(docs, "doc_id", keys).collect()) == [*range(100), *range(200, 20_000)]
