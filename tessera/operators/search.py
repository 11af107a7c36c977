"""Exact nearest neighbours and range search.

A corpus is a DataFrame with ``id`` and ``embedding`` and any metadata; queries
have ``query_id`` and ``embedding``.  Results have query_id, id, score and rank,
closest first, ties by id.

Queries are the stated set: they are sent to the corpus in blocks of bounded
size, never the other way round, so the corpus is read where it is.  Each task
keeps the k best of each query, and only those are shuffled.  Tasks multiply
matrices in Arrow batches; products are rounded otherwise than sums of
components, so they only tell which pairs may belong to the result, and those
pairs are measured component by component, as expressions and SQL do it, to
the last bit.  Kernel ``expr`` measures what was found by expressions again.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.errors import DimensionMismatch, SearchFailed
from tessera.functions import arrays
from tessera.functions import distance as D
from tessera.operators.filters import EVERYTHING, Filter
from tessera.plans.materialize import materialized

#: Queries sent to all tasks at once: 4096 x 1024 doubles are 32 MB.
QUERY_BLOCK = 4096
#: Rows of the corpus held against a block of queries at once.
ROWS = 2048


def live(corpus: DataFrame, deleted: DataFrame | None = None, where: Filter = EVERYTHING) -> DataFrame:
    """Rows that are not deleted and pass the filter."""
    rows = corpus if where.trivial else corpus.where(where.column)
    return rows if deleted is None else rows.join(deleted.select("id"), "id", "left_anti")


def best(scored: DataFrame, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The k closest rows of each query, numbered from 1."""
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank", *keep)


def against(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Every row with every query; about ``QUERY_BLOCK`` queries are broadcast at once, however many there are."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, (rows.crossJoin(F.broadcast(queries if blocks == 1 else queries.where(block == b))) for b in range(blocks)))


def pairs(queries: DataFrame, corpus: DataFrame, metric: str, exclude_self: bool = False) -> DataFrame:
    """query_id, id and score of every query with every row; queries are broadcast in blocks."""
    q = queries.select("query_id", F.col("embedding").alias("__q"))
    columns = [c for c in corpus.columns if c not in ("id", "embedding")]
    if metric == D.COSINE:  # norms once per row, not once per pair
        joined = against(corpus.withColumn("__n", D.norm(F.col("embedding"))), q.withColumn("__nq", D.norm(F.col("__q"))))
        score = D.cosine(F.col("__q"), F.col("embedding"), F.col("__nq"), F.col("__n"))
    else:
        joined = against(corpus, q)
        score = D.distance(metric, F.col("__q"), F.col("embedding"))
    joined = joined.where("query_id <> id") if exclude_self else joined
    return joined.select("query_id", "id", score.alias("score"), *columns)


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries with a vector in blocks of bounded size."""
    ids, vectors = [], []
    for row in queries.where("embedding IS NOT NULL").select("query_id", "embedding").toLocalIterator():
        ids.append(row[0])
        vectors.append(row[1])
        if len(ids) == QUERY_BLOCK:
            yield _names(ids), np.array(vectors, np.float64)
            ids, vectors = [], []
    if ids:
        yield _names(ids), np.array(vectors, np.float64)


def _names(ids: list) -> np.ndarray:
    """Ids as numbers, or else as objects."""
    return np.array(ids) if all(isinstance(x, int) for x in ids) else np.array(ids, dtype=object)


def scores(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances of all pairs of rows."""
    if metric == D.HAMMING:
        a, b = (q >= 0).astype(np.float64), (v >= 0).astype(np.float64)
        return a @ (1 - b).T + (1 - a) @ b.T
    if metric == D.L2:
        return np.maximum((q * q).sum(1)[:, None] - 2 * (q @ v.T) + (v * v).sum(1)[None, :], 0.0)
    product = q @ v.T
    if metric == D.INNER_PRODUCT:
        return -product
    norms = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :]
    return np.where(norms < D.TINY, 1.0, 1.0 - product / np.where(norms < D.TINY, 1.0, norms))


#: Queries that meet a block of rows at once.
ASKED = 1024
#: Unit of rounding.
_EPS = float(np.finfo(np.float64).eps)


def _total(terms: Iterator[np.ndarray], n: int) -> np.ndarray:
    """The sum of terms, one after another."""
    out = np.zeros(n)
    for x in terms:
        out += x
    return out


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, summed in order."""
    return np.sqrt(_total((c * c for c in x.T), len(x)))


def each(metric: str, q: np.ndarray, v: np.ndarray, nq: np.ndarray | None = None, nv: np.ndarray | None = None) -> np.ndarray:
    """Distances of rows of q to the same rows of v, to the last bit as ``distance`` gives them; nq, nv: lengths, if known."""
    q, v = np.ascontiguousarray(q.T), np.ascontiguousarray(v.T)
    n = q.shape[1]
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        if metric == D.HAMMING:
            return ((q < 0) != (v < 0)).sum(axis=0).astype(np.float64)
        if metric == D.L2:
            return _total(((a - b) * (a - b) for a, b in zip(q, v, strict=True)), n)
        product = _total((a * b for a, b in zip(q, v, strict=True)), n)
        if metric == D.INNER_PRODUCT:
            return -product
        both = (norms(q.T) if nq is None else nq) * (norms(v.T) if nv is None else nv)
        return np.where(both < D.TINY, 1.0, 1.0 - product / both)


class Asked:
    """Queries as tasks hold them, and which rows come near them."""

    def __init__(self, metric: str, ids: np.ndarray, q: np.ndarray, exclude_self: bool):
        self.metric, self.ids, self.q, self.exclude_self = metric, ids, q, exclude_self
        self.norm = norms(q)
        self.by_id = np.argsort(ids, kind="stable")
        self.sorted = ids[self.by_id]
        with np.errstate(invalid="ignore", divide="ignore"):
            self.unit = q / self.norm[:, None] if metric == D.COSINE else (q < 0).astype(np.float64) if metric == D.HAMMING else q

    def about(self, a: int, b: int, ids: np.ndarray, x: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of queries a to b with rows, a query's own row at infinity, and by how much they may be wrong; NaN where that is not known."""
        own, far = self.norm[a:b], float(norm.max(initial=0.0))
        slack = 8 * _EPS * (x.shape[1] + 8)
        with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
            if self.metric == D.HAMMING:
                bits = (x < 0).astype(np.float64)
                d = self.unit[a:b].sum(axis=1)[:, None] + bits.sum(axis=1)[None, :] - 2 * (self.unit[a:b] @ bits.T)
                error = np.full(b - a, 0.25)
            elif self.metric == D.COSINE:
                d = 1.0 - self.unit[a:b] @ (x / norm[:, None]).T
                if float(own.min(initial=np.inf)) * float(norm.min(initial=np.inf)) < 1.1 * D.TINY:
                    d[own[:, None] * norm[None, :] < 1.1 * D.TINY] = np.nan
                error = np.full(b - a, slack)
            elif self.metric == D.L2:
                d = self.unit[a:b] @ (-2.0 * x.T)
                d += (own * own)[:, None]
                d += (norm * norm)[None, :]
                error = slack * (own + far) ** 2
            else:
                d = self.unit[a:b] @ -x.T
                error = slack * own * far
        if self.exclude_self:
            low, high = np.searchsorted(self.sorted, ids, "left"), np.searchsorted(self.sorted, ids, "right")
            for c in np.flatnonzero(high > low).tolist():
                at = self.by_id[low[c] : high[c]]
                at = at[(at >= a) & (at < b)]
                d[at - a, c] = np.inf
        return d, error

    def measured(self, who: np.ndarray, which: np.ndarray, x: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Distances of pairs of queries and rows."""
        out = np.empty(len(who))
        for i in range(0, len(who), 1 << 15):
            a, b = who[i : i + (1 << 15)], which[i : i + (1 << 15)]
            out[i : i + (1 << 15)] = each(self.metric, self.q[a], x[b], self.norm[a], norm[b])
        return out

    def own(self, who: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Pairs of a query with its own row, if these do not count."""
        return (self.ids[who] == ids).astype(bool) if self.exclude_self else np.zeros(len(who), bool)


class Best:
    """The k best rows of each query, and at most ``bound`` away, of the rows seen so far; ties by id."""

    def __init__(self, asked: Asked, k: int, bound: float = np.inf):
        self.asked, self.k, self.bound = asked, k, bound
        self.limit = np.full(len(asked.ids), bound)
        self.full = np.zeros(len(asked.ids), bool)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        norm = norms(x)
        for a in range(0, len(self.limit), ASKED):
            b = min(a + ASKED, len(self.limit))
            d, error = self.asked.about(a, b, ids, x, norm)
            limit, open_ = self.limit[a:b].copy(), np.flatnonzero(~self.full[a:b])
            if len(open_) and d.shape[1] > self.k:
                near = np.partition(d[open_], self.k - 1, axis=1)[:, self.k - 1]
                limit[open_] = np.where(np.isnan(near), limit[open_], np.minimum(limit[open_], near + error[open_]))
            who, which = np.nonzero(~(d > (limit + error)[:, None]))
            score = self.asked.measured(who + a, which, x, norm)
            keep = ~self.asked.own(who + a, ids[which])
            if self.bound < np.inf:
                keep &= score <= self.bound
            self.held.append((who[keep] + a, ids[which[keep]], score[keep]))
            self.size += int(keep.sum())
        if self.size > 2 * self.k * len(self.limit) + (1 << 16) or not self.full.all():
            self._fold()

    def _fold(self) -> None:
        who, ids, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((ids, score, who))
        who, ids, score = who[order], ids[order], score[order]
        first = np.searchsorted(who, np.arange(len(self.limit) + 1))
        rank = np.arange(len(who)) - first[who]
        last = np.flatnonzero((rank == self.k - 1) & ~np.isnan(score))
        self.limit[who[last]], self.full[who[last]] = np.minimum(score[last], self.bound), True
        keep = rank < self.k
        self.held, self.size = [(who[keep], ids[keep], score[keep])], int(keep.sum())

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of queries, ids and distances."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self._fold()
        return self.held[0]


def _values(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and vectors of bounded blocks of rows; rows without a vector are at no distance."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            if part.column("embedding").null_count:
                part = part.filter(part.column("embedding").is_valid())
            if part.num_rows:
                yield _values(part.column("id")), arrays.matrix(part.column("embedding"))


def _arrow_types(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema if f.name != "rank"])


def _found(asked: Asked, kinds: pa.Schema, who: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(asked.ids[who], kinds.types[0]), pa.array(ids, kinds.types[1]), pa.array(score, kinds.types[2])], schema=kinds)


def all_distances(queries: DataFrame, corpus: DataFrame, metrics: tuple[str, ...] = D.METRICS, digits: int | None = None) -> DataFrame:
    """query_id, id and a column for each metric, for every query with every row, from blocks; rounded to digits.

    A result has as many rows as there are pairs; none is shuffled.
    """
    kept = result_schema(queries, corpus).fields[:2]
    schema = T.StructType([*kept, *(T.StructField(m, T.DoubleType()) for m in metrics)])
    kinds = _arrow_types(schema)
    step = 1 << 16  # pairs of a batch

    def run(rows: DataFrame, names: np.ndarray, q: np.ndarray) -> DataFrame:
        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, asked = norms(q), pa.array(names, kinds.types[0])
            # a component of all queries stands together
            columns, signs = np.ascontiguousarray(q.T), (q < 0).astype(np.float64)
            for ids, x in _parts(batches):
                length, here = norms(x), pa.array(ids, kinds.types[1])
                some = max(1, step // len(q))
                for i in range(0, len(x), some):
                    v = x[i : i + some]
                    found = _grid(metrics, columns, v, own, length[i : i + some], signs)
                    who = pa.array(np.tile(np.arange(len(q)), len(v)))
                    which = pa.array(np.repeat(np.arange(i, i + len(v)), len(q)))
                    out = [pa.array((f if digits is None else rounded(f, digits)).ravel()) for f in found]
                    yield pa.record_batch([asked.take(who), here.take(which), *out], schema=kinds)

        return rows.mapInArrow(measure, schema)

    blocks = [run(corpus.select("id", "embedding"), *block) for block in _blocks(queries)]
    return reduce(DataFrame.unionByName, blocks) if blocks else corpus.sparkSession.createDataFrame([], schema)


def _grid(metrics: tuple[str, ...], columns: np.ndarray, v: np.ndarray, own: np.ndarray, length: np.ndarray, signs: np.ndarray) -> list[np.ndarray]:
    """Distances of rows of v to all queries, given by components, a matrix for each metric; summed in order."""
    shape, out = (len(v), columns.shape[1]), {}
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        if D.COSINE in metrics or D.INNER_PRODUCT in metrics:
            product = np.zeros(shape)
            for a, b in zip(columns, v.T, strict=True):
                product += a[None, :] * b[:, None]
            both = own[None, :] * length[:, None]
            out[D.COSINE], out[D.INNER_PRODUCT] = np.where(both < D.TINY, 1.0, 1.0 - product / both), -product
        if D.L2 in metrics:
            out[D.L2] = np.zeros(shape)
            for a, b in zip(columns, v.T, strict=True):
                apart = a[None, :] - b[:, None]
                out[D.L2] += apart * apart
        if D.HAMMING in metrics:
            bits = (v < 0).astype(np.float64)
            out[D.HAMMING] = bits.sum(axis=1)[:, None] + signs.sum(axis=1)[None, :] - 2 * (bits @ signs.T)
    return [out[m] for m in metrics]


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """x to so many digits, halves away from zero."""
    scale = 10.0**digits
    big = np.abs(x) * scale
    low = np.floor(big)
    return np.copysign((low + (big - low >= 0.5)) / scale, x)


def measured(frame: DataFrame, metric: str, a: str, b: str, name: str) -> DataFrame:
    """frame with the distance of two of its columns instead of them, in Arrow batches, as expressions give it."""
    rest = [c for c in frame.columns if c not in (a, b)]
    schema = T.StructType([*(frame.schema[c] for c in rest), T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                far = each(metric, arrays.matrix(part.column(a)), arrays.matrix(part.column(b)))
                yield pa.record_batch([*(part.column(c) for c in rest), pa.array(far)], names=[*rest, name])

    return frame.select(*rest, a, b).mapInArrow(run, schema)


def _local_best(metric: str, k: int, ids: np.ndarray, q: np.ndarray, exclude_self: bool, kinds: pa.Schema, bound: float = np.inf):
    """The k best rows of each task for every query."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(Asked(metric, ids, q, exclude_self), k, bound)
        for names, x in _parts(batches):
            best.add(names, x)
        yield _found(best.asked, kinds, *best.rows())

    return search


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    metric: str = D.COSINE,
    where: Filter = EVERYTHING,
    deleted: DataFrame | None = None,
    exclude_self: bool = False,
    kernel: str = "arrow",
    mode: str = "pre",
) -> DataFrame:
    """The k nearest live rows of each query.

    mode 'pre' filters before the search and finds k rows if there are as many;
    'post' takes the 4k nearest first and filters those, so it may find fewer.
    """
    if metric not in D.METRICS:
        raise SearchFailed(f"unknown metric {metric!r}")
    if k <= 0:
        return corpus.sparkSession.createDataFrame([], result_schema(queries, corpus))
    if mode == "post":
        n_deleted = 0 if deleted is None else deleted.count()
        wide = k + n_deleted if where.trivial else 4 * k + n_deleted
        near = knn(queries, corpus, wide, metric, exclude_self=exclude_self, kernel=kernel).drop("rank")
        return best(live(near.join(corpus.drop("embedding"), "id"), deleted, where).select("query_id", "id", "score"), k)
    rows = live(corpus, deleted, where).select("id", "embedding")
    schema = result_schema(queries, corpus)
    if kernel == "expr":
        rows = materialized(rows)
        found = knn(queries, rows, k, metric, exclude_self=exclude_self).select("query_id", "id").distinct()
        q, v = queries.select("query_id", F.col("embedding").alias("__q")), rows.withColumnRenamed("embedding", "__v")
        again = found.join(q, "query_id").join(v, "id").select("query_id", "id", D.distance(metric, F.col("__q"), F.col("__v")).alias("score"))
        return best(again, k)
    return _in_blocks(queries, rows, not where.trivial or deleted is not None, schema, lambda held, names, q: best(held.mapInArrow(_local_best(metric, k, names, q, exclude_self, _arrow_types(schema)), _plain(schema)), k))


def _plain(schema: T.StructType) -> T.StructType:
    return T.StructType([f for f in schema if f.name != "rank"])


def _in_blocks(queries: DataFrame, rows: DataFrame, derived: bool, schema: T.StructType, run: Callable[[DataFrame, np.ndarray, np.ndarray], DataFrame]) -> DataFrame:
    """Results of ``run`` (rows, ids and vectors of a block of queries); derived: rows are kept where several blocks read them."""
    blocks = _blocks(queries)
    one, more = next(blocks, None), next(blocks, None)
    if one is None:
        return rows.sparkSession.createDataFrame([], schema)
    if more is None:
        return run(rows, *one)
    rows, found = materialized(rows) if derived else rows, []
    for block in chain((one, more), blocks):  # each block's result is written before the next block is fetched
        found.append(materialized(run(rows, *block)))
    return reduce(DataFrame.unionByName, found)


#: Rows, and queries, of a cell of a join of blocks: 16384 x 1024 doubles are 128 MB.
CELL = 16_384


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, metric: str = D.COSINE, exclude_self: bool = False, cell: int = CELL) -> DataFrame:
    """The k nearest rows of each query, where queries are as many as rows.

    Both sides are dealt by hash into g blocks, and every two blocks meet in a
    cell: a task that multiplies them and keeps the k best of each query.  g
    follows from the numbers of rows, so a cell is of bounded size, and a row
    travels g times; only the k best of g cells for each query travel on.
    Nothing goes through the driver, and nothing is broadcast.
    """
    if metric not in D.METRICS:
        raise SearchFailed(f"unknown metric {metric!r}")
    schema = _plain(result_schema(queries, corpus))
    kinds = _arrow_types(schema)
    if k <= 0:
        return corpus.sparkSession.createDataFrame([], result_schema(queries, corpus))
    n, m = corpus.count(), queries.count()
    tasks = corpus.sparkSession.sparkContext.defaultParallelism
    g = max(1, -(-max(n, m) // cell), min(math.isqrt(2 * tasks), -(-max(n, m) // 256)))
    each = F.explode(F.sequence(F.lit(0), F.lit(g - 1)))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(g)).cast("int")
    queries, corpus = queries.where("embedding IS NOT NULL"), corpus.where("embedding IS NOT NULL")
    left = queries.select("query_id", "embedding", block("query_id").alias("q"), each.alias("r"))
    right = corpus.select("id", "embedding", block("id").alias("r"), each.alias("q"))

    def meet(asking: pa.Table, rows: pa.Table) -> pa.Table:
        if not asking.num_rows or not rows.num_rows:
            return kinds.empty_table()
        own, names = Asked(metric, _values(asking.column("query_id")), arrays.matrix(asking.column("embedding")), exclude_self), _values(rows.column("id"))
        near, x = Best(own, k), arrays.matrix(rows.column("embedding"))
        for i in range(0, len(x), ROWS):
            near.add(names[i : i + ROWS], x[i : i + ROWS])
        return pa.Table.from_batches([_found(own, kinds, *near.rows())])

    found = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInArrow(meet, schema)
    return best(found, k)


def result_schema(queries: DataFrame, corpus: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("id", corpus.schema["id"].dataType),
        T.StructField("score", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
    ])


def range_search(queries: DataFrame, corpus: DataFrame, max_distance: float, limit: int = 1000, metric: str = D.COSINE, where: Filter = EVERYTHING, deleted: DataFrame | None = None, exclude_self: bool = False, kernel: str = "expr") -> DataFrame:
    """Live rows within a distance (inclusive), the ``limit`` closest of each query.

    Kernel ``expr`` is a plain plan that joins all pairs, for few queries;
    ``arrow`` gives the same rows from blocks, and only those are shuffled.
    """
    if max_distance < 0 and metric != D.INNER_PRODUCT or limit <= 0:
        return corpus.sparkSession.createDataFrame([], result_schema(queries, corpus))
    rows, schema = live(corpus, deleted, where).select("id", "embedding"), result_schema(queries, corpus)
    if kernel == "expr":
        return best(pairs(queries, rows, metric, exclude_self).where(F.col("score") <= max_distance), limit)
    kinds, derived = _arrow_types(schema), not where.trivial or deleted is not None

    def run(held: DataFrame, names: np.ndarray, q: np.ndarray) -> DataFrame:
        if limit <= FEW:
            return best(held.mapInArrow(_local_best(metric, limit, names, q, exclude_self, kinds, max_distance), _plain(schema)), limit)
        held = materialized(held) if derived else held
        bound = _bounds(held, metric, names, q, max_distance, limit, exclude_self)
        return best(held.mapInArrow(_local_within(metric, names, q, bound, max_distance, exclude_self, kinds), _plain(schema)), limit)

    return _in_blocks(queries, rows, derived, schema, run)


#: Results of a query that every task keeps in memory; of more, bounds are found first.
FEW = 64
#: Parts of the range of distances whose rows are counted.
PARTS = 128


def _bounds(rows: DataFrame, metric: str, names: np.ndarray, q: np.ndarray, most: float, limit: int, exclude_self: bool) -> np.ndarray:
    """For each query a distance within which its ``limit`` nearest rows lie, from one pass of counts; ``most`` if it has fewer."""
    low = -float((q * q).sum(axis=1).max(initial=0.0)) if metric == D.INNER_PRODUCT else 0.0
    if not np.isfinite(low) or not most > low:
        return np.full(len(q), most)
    width, n = (most - low) / PARTS, len(q)

    def counted(batch: pa.RecordBatch) -> np.ndarray:
        asked, out = Asked(metric, names, q, exclude_self), np.zeros(n * PARTS)
        for ids, x in _parts(iter([batch])):
            length = norms(x)
            for a in range(0, n, ASKED):
                d, _ = asked.about(a, min(a + ASKED, n), ids, x, length)
                who, which = np.nonzero(d <= most)
                part = np.clip(np.ceil((d[who, which] - low) / width) - 1, 0, PARTS - 1).astype(np.int64)
                out += np.bincount((who + a) * PARTS + part, minlength=n * PARTS)
        return out

    upto = np.cumsum(arrays.summed(rows, counted, n * PARTS).reshape(n, PARTS), axis=1)
    enough = (upto >= limit).argmax(axis=1)
    return np.where(upto[:, -1] >= limit, np.minimum(low + width * (enough + 1) + 1e-9 * width, most), most)


def _local_within(metric: str, names: np.ndarray, q: np.ndarray, bound: np.ndarray, most: float, exclude_self: bool, kinds: pa.Schema):
    """Rows of each task within ``most``, and about within the bound, of every query."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Asked(metric, names, q, exclude_self)
        for ids, x in _parts(batches):
            length = norms(x)
            for a in range(0, len(q), ASKED):
                d, error = asked.about(a, min(a + ASKED, len(q)), ids, x, length)
                who, which = np.nonzero(~(d > (bound[a : a + ASKED] + 2 * error)[:, None]))
                score = asked.measured(who + a, which, x, length)
                keep = (score <= most) & ~asked.own(who + a, ids[which])
                yield _found(asked, kinds, who[keep] + a, ids[which[keep]], score[keep])

    return search


def nearest(query: list[float], corpus: DataFrame, k: int, metric: str = D.COSINE) -> DataFrame:
    """id and score of one query's neighbours, by TakeOrderedAndProject."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return corpus.select("id", D.distance(metric, q, F.col("embedding")).alias("score")).orderBy("score", "id").limit(max(k, 0))


def check_dimension(frame: DataFrame, dim: int) -> None:
    """Raises if a vector has another length."""
    other = frame.select(F.size("embedding").alias("n")).where(F.col("n") != dim).head()
    if other:
        raise DimensionMismatch(dim, other[0])
