"""Whitening of embeddings by matrix-free block Lanczos.

Components become integers first, so sums and deviations are exact.  The
covariance is never formed: a pass over the vectors multiplies it with a block
of directions, task by task, as sums of centred x (x . v).  The driver holds
the basis, whose size is bounded by the dimension and ``BASIS``:

* each new block is orthogonalised twice against the whole basis;
* where a block loses rank (breakdown), random directions that are orthogonal
  to the basis take the place of what is missing;
* a basis that has grown to its bound is replaced by its leading Ritz vectors;
* it ends when the residuals of the wanted pairs are small, which are measured
  against the products of all passes, or when the basis spans all dimensions.

The trace is the sum of the exact deviations, so explained shares need no
further eigenvalues.  One more pass measures the covariance of the result.

Defined results: vectors that are null or empty or have components that are
null or not finite are dropped, and so are those of another length than most
(of equally frequent lengths the greatest counts).  Components of variance
zero, compared with the largest, cannot be scaled and are left out: one vector,
or copies of one, give no rows, as does an empty table.  Repeated rows count
and come out each; a null id stays null.  A deviation beyond 64 bits is null.
Of other columns none is returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import vector_batches as V

#: Components returned, at most; directions of a block.
COMPONENTS = BLOCK = 32
#: Directions held at once, at most.
BASIS = 256
#: An eigenvalue's residual is small enough below this share of it.
TOLERANCE = 1e-12
#: Passes over the vectors, at most.
PASSES = 200
SCALE, SHIFT = 64.0, 1_000_000
SEED = 20240229

_LIMIT = 1 << 62


def block_lanczos(apply: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, block: int = BLOCK, basis: int = BASIS, tolerance: float = TOLERANCE, passes: int = PASSES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric operator, falling, and their unit vectors as columns.

    apply: products of the operator with the columns of a matrix.
    """
    rng = np.random.default_rng(seed)
    wanted = min(wanted, dim)
    block = min(max(block, 1), dim)
    basis = max(basis, 2 * wanted + 2 * block)

    def fresh(candidates: np.ndarray, scale: float, held: np.ndarray, n: int) -> np.ndarray:
        """n orthonormal columns beside those held: of the candidates, then random ones."""
        out = held
        for source in (candidates, None, None, None):
            short = held.shape[1] + n - out.shape[1]
            if short <= 0:
                break
            x = rng.standard_normal((dim, short)) if source is None else source
            least = 1e-13 * scale if source is not None else 1e-6
            for _ in range(2):
                x = x - out @ (out.T @ x)
            u, s, _ = np.linalg.svd(x, full_matrices=False)
            u = u[:, s > least][:, :short]
            u = u - out @ (out.T @ u)
            out = np.concatenate([out, np.linalg.qr(u)[0]], axis=1)
        return out[:, held.shape[1] :]

    held, product = np.zeros((dim, 0)), np.zeros((dim, 0))
    new = fresh(rng.standard_normal((dim, block)), 1.0, held, block)
    broken = False
    for _ in range(passes):
        held = np.concatenate([held, new], axis=1)
        product = np.concatenate([product, apply(new)], axis=1)
        inner = held.T @ product
        value, vector = np.linalg.eigh((inner + inner.T) / 2)
        value, vector = value[::-1], vector[:, ::-1]
        ritz, image = held @ vector, product @ vector
        if held.shape[1] >= dim:
            break
        rest = np.linalg.norm(image[:, :wanted] - ritz[:, :wanted] * value[:wanted], axis=0)
        top = max(abs(value[0]), abs(value[-1]))
        # a pass after a breakdown sees what random directions add before the pairs are taken as found
        if held.shape[1] >= wanted and not broken and (rest <= np.maximum(tolerance * np.abs(value[:wanted]), 4 * np.finfo(float).eps * dim * top)).all():
            break
        last = product[:, -new.shape[1] :]
        residual = last - held @ (held.T @ last)
        broken = np.linalg.matrix_rank(residual, tol=1e-13 * max(top, np.finfo(float).tiny)) < min(new.shape[1], dim - held.shape[1])
        if held.shape[1] + block > basis:
            keep = wanted + block
            held, product = ritz[:, :keep], image[:, :keep]
        new = fresh(residual, top, held, min(block, dim - held.shape[1]))
    return value[:wanted], ritz[:, :wanted]


class Fit(NamedTuple):
    """What the vectors of the fit list have in common."""

    dim: int
    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    directions: np.ndarray
    trace: float
    identity_error: float


def integers(vectors: np.ndarray, scale: float = SCALE, shift: int = SHIFT) -> np.ndarray:
    """floor(scale * c) + shift; what lies beyond 2**62 is held there."""
    return np.clip(np.floor(vectors * scale), -float(_LIMIT), float(_LIMIT)).astype(np.int64) + shift


class _Centre:
    """Integers less their mean: exactly, times n, and as doubles."""

    def __init__(self, n: int, sums: tuple[int, ...], scale: float, shift: int):
        self.n, self.scale, self.shift = n, scale, shift
        self.whole = np.array([s // n for s in sums], np.int64)
        self.part = np.array([s % n for s in sums], np.int64)

    def doubles(self, vectors: np.ndarray) -> np.ndarray:
        return (integers(vectors, self.scale, self.shift) - self.whole) - self.part / self.n

    def deviations(self, vectors: np.ndarray) -> list[int] | np.ndarray:
        """Sums of (n x - S)^2, exact."""
        apart = integers(vectors, self.scale, self.shift) - self.whole
        most = (float(np.abs(apart).max(initial=0)) + 1) * self.n
        if apart.shape[1] * most * most < _LIMIT:
            y = apart * self.n - self.part
            return (y * y).sum(axis=1)
        y = apart.astype(object) * self.n - self.part.astype(object)
        return [int(x) for x in (y * y).sum(axis=1)]


def _rows(vectors: DataFrame, id_column: str, column: str) -> tuple[DataFrame, int | None]:
    kept = V.usable(vectors.select(F.col(id_column).alias("id"), F.col(column).alias("v")), "v")
    dim = V.dimension(kept, "v")
    return (kept if dim is None else kept.where(F.size("v") == dim)), dim


def _sums(rows: DataFrame, dim: int, scale: float, shift: int) -> tuple[int, tuple[int, ...]]:
    """Number of vectors and exact sums of their integers by position."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * dim
        for batch in batches:
            x = integers(V.matrix(batch.column("v"), dim), scale, shift)
            n += len(x)
            safe = int(np.abs(x).max(initial=0)) * len(x) < _LIMIT
            total = [a + int(b) for a, b in zip(total, x.sum(axis=0) if safe else x.astype(object).sum(axis=0), strict=True)]
        if n:
            yield pa.record_batch({"n": pa.array([n] * dim, pa.int64()), "pos": pa.array(range(dim), pa.int32()), "s": pa.array([str(x) for x in total], pa.string())})

    found = rows.select("v").mapInArrow(partial, "n long, pos int, s string").groupBy("pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # a row per component
    found.sort(key=lambda r: r["pos"])
    return found[0]["n"], tuple(int(r["s"]) for r in found)


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT) -> Fit:
    """Leading components of the vectors in ``v``; passes over rows, in their tasks."""
    n, sums = _sums(rows, dim, scale, shift)
    centre, only = _Centre(n, sums, scale, shift), rows.select("v")

    def apply(block: np.ndarray) -> np.ndarray:
        def part(batch: pa.RecordBatch) -> np.ndarray:
            x = centre.doubles(V.matrix(batch.column("v"), dim))
            return (x.T @ (x @ block)).ravel()

        return V.summed(only, part, block.size).reshape(block.shape) / n

    def deviations(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([float(sum(map(int, centre.deviations(V.matrix(batch.column("v"), dim)))))])

    trace = float(V.summed(only, deviations, 1)[0]) / float(n) ** 3
    if trace <= 0:
        return Fit(dim, n, sums, np.zeros(0), np.zeros((dim, 0)), 0.0, 0.0)
    values, directions = block_lanczos(apply, dim, components)
    there = values > 8 * np.finfo(float).eps * dim * values[0]
    values, directions = values[there], directions[:, there]
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(len(values))])
    directions = directions * signs
    k, scaled = len(values), directions / np.sqrt(values)

    def second(batch: pa.RecordBatch) -> np.ndarray:
        z = centre.doubles(V.matrix(batch.column("v"), dim)) @ scaled
        return np.concatenate([(z.T @ z).ravel(), z.sum(axis=0)])

    got = V.summed(only, second, k * k + k) / n
    covariance = got[: k * k].reshape(k, k) - np.outer(got[k * k :], got[k * k :])
    return Fit(dim, n, sums, values, directions, trace, float(np.abs(covariance - np.eye(k)).max()))


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """A row per vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows, dim = _rows(vectors, id_column, column)
    schema = T.StructType([
        T.StructField(id_column, vectors.schema[id_column].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    found = None if dim is None else fit(rows, dim, components, scale, shift)
    if found is None or not len(found.values):
        return vectors.sparkSession.createDataFrame([], schema)
    centre, k = _Centre(found.n, found.sums, scale, shift), len(found.values)
    scaled, explained = found.directions / np.sqrt(found.values), found.values / found.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = V.matrix(batch.column("v"), dim)
            m = len(x)
            deviation = centre.deviations(x)
            if isinstance(deviation, list):
                deviation = [d if d < 1 << 63 else None for d in deviation]
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.record_batch(
                [
                    pc.take(batch.column("id"), each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, found.n)), pc.take(pa.array(deviation, pa.int64()), each),
                    pa.array((centre.doubles(x) @ scaled).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, found.identity_error)),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(project, schema)
