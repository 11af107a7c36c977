"""Vector codes and whitening against plain numpy on one machine."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import vector_codes, whitening
from tessera.llm.queries import op11_vector_codes, op13_whitening

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, label int"


def _kept(rows, dim):
    return [r for r in rows if r[1] is not None and len(r[1]) == dim and all(x is not None and math.isfinite(x) for x in r[1])]


def _brute_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    """Rows (id, label, code, error, label error) and the codebooks, value by value."""
    size = -(-len(rows[0][1]) // parts)
    x = {}
    for k, (_, v, _) in enumerate(rows):
        whole = [math.floor(scale * float(np.float64(c))) for c in v] + [0] * (parts * size - len(v))
        x[k] = [whole[p * size : p * size + size] for p in range(parts)]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, [float(c) for c in rows[k][1]]))[:entries]
    books = [[list(x[k][p]) for k in order] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    pick = lambda p, a: min((far(a, b), k) for k, b in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            members = [[] for _ in books[p]]
            for k in x:
                members[pick(p, x[k][p])[1]].append(x[k][p])
            books[p] = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else b for m, b in zip(members, books[p], strict=True)]
    out = []
    for k, (i, _, label) in enumerate(rows):
        found = [pick(p, x[k][p]) for p in range(parts)]
        out.append((i, label, "".join(f"{c:02x}" for _, c in found), sum(d for d, _ in found)))
    total = {}
    for _, label, _, error in out:
        total[label] = total.get(label, 0) + error
    return sorted(((*r, total[r[1]]) for r in out), key=str), books


def _same_codes(df, rows, **options):
    got, books = vector_codes.compress(df, **options)
    want, want_books = _brute_codes(rows, **options)
    assert books.tolist() == want_books
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls, wrong lengths, copies, shared parts, repeated rows and ids."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(20) * 0.3).astype(np.float32).tolist(), int(i % 3)) for i in range(90)]
    rows += [(100 + i, rows[0][1], None) for i in range(40)]  # copies
    rows += [(200 + i, rows[1][1][:10] + rows[2][1][10:], 7) for i in range(5)]
    rows += [rows[3], rows[3], (None, rows[4][1], None), (3, rows[5][1], 1)]
    rows += [(300, None, 1), (301, [], 1), (302, [1.0, None] + [0.0] * 18, 1), (303, [float("nan")] * 20, 1), (304, [float("inf")] + [0.0] * 19, 1), (305, [1.0] * 19, 1), (306, [-0.0] * 20, 2)]
    return rows


@pytest.mark.parametrize("chunk", [16_384, 7])
def test_codes_of_odd_rows(spark, odd_rows, monkeypatch, chunk):
    monkeypatch.setattr(vector_codes, "CHUNK", chunk)
    df = spark.createDataFrame(odd_rows, KIND).repartition(3)
    _same_codes(df, _kept(odd_rows, 20), parts=4, entries=8, rounds=2)
    _same_codes(df, _kept(odd_rows, 20), parts=16, entries=64, rounds=2)  # 20 is no multiple of 16


def test_codes_of_rare_labels(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(vector_codes, "FREQUENT", 4)
    _same_codes(spark.createDataFrame(odd_rows, KIND), _kept(odd_rows, 20), parts=4, entries=8)


def test_codes_of_large_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(8) * 10.0 ** (i % 5)).astype(np.float32).tolist(), 0) for i in range(60)]
    _same_codes(spark.createDataFrame(rows, KIND), rows, parts=2, entries=5)
    rows = [(i, (rng.standard_normal(8) * 10.0 ** (i % 9)).astype(np.float32).tolist(), 0) for i in range(60)]
    got, books = vector_codes.compress(spark.createDataFrame(rows, KIND), parts=2, entries=5)
    want, want_books = _brute_codes(rows, parts=2, entries=5)  # distances beyond 64 bits
    assert books.tolist() == want_books
    assert sorted((r["id"], r.code) for r in got.collect()) == sorted((w[0], w[2]) for w in want)


def test_few_vectors_and_none(spark):
    rows = [(2, [0.5] * 16, None), (1, [0.25] * 16, None)]
    _same_codes(spark.createDataFrame(rows, KIND), rows)
    got, books = vector_codes.compress(spark.createDataFrame([(1, None, 1)], KIND))
    assert got.count() == 0 and got.columns == ["id", "label", "code", "error", "label_error"] and vector_codes.codebooks_sha256(books)


def test_codes_of_the_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, books = _brute_codes(rows[:0] + rows)
    got = op11_vector_codes(spark, SF).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == sorted((i, c, e, t) for i, _, c, e, t in want)
    assert {r.codebooks_sha256 for r in got} == {vector_codes.codebooks_sha256(np.array(books))}


def test_clashing_columns(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, KIND)
    more = df.select("*", *[F.lit("x").alias(c) for c in ("id", "code", "error", "v", "component", "n", "chunk", "bucket")])
    plain, clash = (vector_codes.compress(d, parts=4, entries=8)[0].collect() for d in (df, more))
    assert sorted(map(str, plain)) == sorted(map(str, clash))
    assert whitening.whiten(df).count() == whitening.whiten(more).count() == len(_kept(odd_rows, 20)) * 20


def _brute_white(vectors, k=32):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    deviation = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(row, total, strict=True)) for row in x]
    there = value[:k] > 1e-9 * value[0]
    return deviation, (centred @ vector[:, :k] / np.sqrt(np.where(there, value[:k], 1)))[:, there], (value[:k] / value.sum())[there]


def _same_white(got, ids, vectors):
    deviation, white, share = _brute_white(vectors)
    k = white.shape[1]
    rows = sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got)
    assert [r[:4] for r in rows] == sorted((i, c + 1, len(ids), d) for i, d in zip(ids, deviation, strict=True) for c in range(k))
    order = np.argsort(ids, kind="stable")
    found = np.array([r[4] for r in rows]).reshape(-1, k)
    found = found * np.sign((found * white[order]).sum(axis=0))
    assert np.abs(found - white[order]).max() < 1e-6
    assert np.allclose([r[5] for r in rows[:k]], share, rtol=1e-8)
    assert len({r[6] for r in rows}) == 1 and rows[0][6] < 1e-8


def test_white_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    _same_white(op13_whitening(spark, SF).collect(), [r[0] for r in rows], [r[1] for r in rows])


def test_white_odd_rows(spark, odd_rows):
    kept = [r for r in _kept(odd_rows, 20) if r[0] is not None]
    kept = list({r[0]: r for r in kept}.values())
    df = spark.createDataFrame(kept + [r for r in odd_rows if r not in _kept(odd_rows, 20)], KIND).repartition(3)
    _same_white(whitening.whiten(df).collect(), [r[0] for r in kept], [r[1] for r in kept])
    repeated = whitening.whiten(spark.createDataFrame(odd_rows, KIND))
    assert repeated.where("vec_id IS NULL").count() == 20 and repeated.where("vec_id = 3").count() == 80


def test_white_low_rank_and_none(spark):
    rng = np.random.default_rng(7)
    flat = rng.standard_normal((200, 3)) @ np.repeat(np.eye(3), 4, axis=1) * 3  # four equal components each: rank 3
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(flat.astype(np.float32))], KIND)
    _same_white(whitening.whiten(df).collect(), list(range(200)), flat.astype(np.float32))
    for rows in ([], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, None, 0)]):
        assert whitening.whiten(spark.createDataFrame(rows, KIND)).count() == 0


def test_exact_deviations_beyond_doubles(spark):
    rows = [(i, [float(np.float32(3e8 * (i - 2))), 1.0 * i], 0) for i in range(6)]
    got = {(r.vec_id, r.deviation) for r in whitening.whiten(spark.createDataFrame(rows, KIND)).collect()}
    deviation, _, _ = _brute_white([r[1] for r in rows])
    assert got == {(i, d if d < 2**63 else None) for i, d in enumerate(deviation)}


@pytest.mark.parametrize(("dim", "block", "basis"), [(300, 8, 64), (300, 32, 256), (50, 1, 40), (40, 40, 80)])
def test_lanczos_finds_leading_pairs(dim, block, basis):
    rng = np.random.default_rng(dim + block)
    q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    value = np.sort(rng.uniform(0, 1, dim) ** 3)[::-1] * 100
    value[3] = value[2]  # one twice
    a, calls = (q * value) @ q.T, []
    got, vectors = whitening.block_lanczos(lambda x: calls.append(x.shape[1]) or a @ x, dim, 10, block=block, basis=basis, passes=2000)
    assert np.allclose(got, value[:10], rtol=1e-10)
    assert np.abs(vectors.T @ vectors - np.eye(10)).max() < 1e-10
    assert np.abs(a @ vectors - vectors * got).max() < 1e-8
    assert max(calls) <= block


def test_lanczos_restarts_after_breakdown():
    """An operator of few distinct eigenvalues exhausts what a block can reach."""
    value = np.array([5.0] * 6 + [2.0] * 10 + [0.0] * 44)
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((60, 60)))[0]
    a = (q * value) @ q.T
    got, vectors = whitening.block_lanczos(lambda x: a @ x, 60, 12, block=3)
    assert np.allclose(got, value[:12], atol=1e-9) and np.abs(a @ vectors - vectors * got).max() < 1e-8
