"""Byte and word deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.substring_dedup import held_windows, parse, remove_repeated_passages
from tessera.llm.suffix_dedup import remove_repeated_bytes


def _corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    passage = lambda n: " ".join(rng.choices(words, k=n))
    shared = [passage(n) for n in (34, 35, 36, 60, 120)]
    docs = []
    for i in range(120):
        parts = [passage(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            s = rng.choice(shared).split(" ")
            a = rng.randint(0, len(s) // 2)
            parts += [" ".join(s[a : a + rng.randint(10, 120)]), passage(rng.randint(0, 30))]
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(parts)))
    docs += [(200 + i, docs[i][1]) for i in range(5)] + [(300, None), (301, ""), (302, " \n "), (303, "x" * 5000), (304, "ab " * 400), (305, docs[0][1] + " tail")]
    return docs


def _brute_words(docs, w=35):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    seen = Counter(tuple(x[i : i + w]) for x in words.values() for i in range(len(x) - w + 1))
    out = {}
    for d, x in words.items():
        gone = {i + k for i in range(len(x) - w + 1) if seen[tuple(x[i : i + w])] > 1 for k in range(w)}
        out[d] = (len(x), len(gone), " ".join(y for i, y in enumerate(x) if i not in gone))
    return out


def _brute_bytes(docs, w=50):
    first, out = {}, {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = {i + k for i in range(len(b) - w + 1) if first.get(b[i : i + w], d) < d for k in range(w)}
        for i in range(len(b) - w + 1):
            first.setdefault(b[i : i + w], d)
        spans = sum(1 for i in gone if i - 1 not in gone)
        out[d] = (len(b), len(gone), spans, bytes(y for i, y in enumerate(b) if i not in gone))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    docs = _corpus(seed)
    got = remove_repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == _brute_words(docs)


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed):
    docs = _corpus(seed)
    got = remove_repeated_bytes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got} == _brute_bytes(docs)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, kept string")
    assert remove_repeated_bytes(empty).count() == 0 and remove_repeated_passages(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text, "a"), (1, text, "b"), (1, text, "c"), (2, "short", None)], "doc_id int, text string, n_words string").withColumn("__chunk", F.lit("mine"))
    assert {r["__chunk"] for r in remove_repeated_bytes(docs).collect()} == {"mine"}
    rows = remove_repeated_bytes(docs).collect()
    assert sorted((r.doc_id or 0, r.n_removed > 0) for r in rows) == [(0, True), (1, False), (1, False), (2, False)]
    rows = remove_repeated_passages(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in rows) == [(0, 40, 40), (1, 40, 40), (1, 40, 40), (2, 1, 0)]
    assert hashlib.sha256(b"").hexdigest() in {hashlib.sha256(r.kept_text.encode()).hexdigest() for r in rows}


def test_factors_are_maximal_and_hold_what_repeats():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 40, 300).astype(np.uint64)
    pieces = [np.concatenate([rng.choice(pool, rng.integers(3, 9)), pool[a : a + rng.integers(4, 40)], rng.choice(pool, 3)]) for a in rng.integers(0, 250, 60)]
    symbols, lengths = np.concatenate(pieces), np.array([len(x) for x in pieces])
    starts, window = np.cumsum(lengths) - lengths, 7
    order = rng.permutation(len(starts))  # blocks come in any order
    starts, lengths = starts[order], lengths[order]
    keys = [tuple(symbols[s + i : s + i + window].tolist()) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True) for i in range(n - window + 1)]
    seen = Counter(keys)
    assert held_windows(symbols, starts, lengths, window).tolist() == [seen[k] > 1 for k in keys]
    found, ends = parse(symbols, starts, lengths, window), {int(s): int(s + n) for s, n in zip(starts, lengths, strict=True)}
    assert len(found.start) and (found.length > window).any()
    for start, length, source in zip(*map(np.ndarray.tolist, found), strict=True):
        assert start != source and (symbols[start : start + length] == symbols[source : source + length]).all()
        stop = {e for s, e in ends.items() if s <= start < e} | {e for s, e in ends.items() if s <= source < e}
        assert start + length in stop or source + length in stop or symbols[start + length] != symbols[source + length]


def test_long_text(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[50_000:60_000])), (3, "x " + " ".join(words[:35]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in remove_repeated_passages(docs).collect()}
    assert got == {1: (120_000, 10_035), 2: (10_000, 10_000), 3: (36, 35)}
    spans = {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in remove_repeated_bytes(docs).collect()}
    assert len(spans[2]) == 1 and spans[1] == [] and len(spans[3]) == 1


def test_rows_that_move_are_small(spark):
    from tessera.llm import windows

    for ids in ([7], [-5, -5, 0, 3], [0, 255, 256], [1, 70_000], [-(1 << 62), 4, windows.NO_ID]):
        assert windows._risen(windows._rising(np.array(ids, np.int64))).tolist() == ids
    assert len(windows._rising(np.arange(1000))) < 1100
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "of", "the"], k=400)), f"s{i % 3}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __chunk string").repartition(2)
    packed, own, _ = windows.dealt(docs)
    chunks = packed.groupBy(own).applyInArrow(lambda t: windows._chunk(t, own)[1], docs.schema)
    assert sorted(map(tuple, chunks.collect())) == rows
    assert sum(len(r.packed) for r in packed.collect()) < 0.6 * sum(len(t) for _, t, _ in rows)
    # and a row is asked for with 12 bytes or so, not 20
    asked = packed.groupBy(own).applyInArrow(lambda t: windows._ask(t, windows.Scheme("bytes", 50, 20), 2, own), windows.ASKED).collect()
    assert sum(len(x) for r in asked for x in (r.key, r["high"], r.low, r.doc)) < 13 * sum(len(r.key) // 4 for r in asked)
