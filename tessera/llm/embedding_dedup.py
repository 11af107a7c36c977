"""Near-duplicate vectors by sign hashing, exact cosines and components.

Each of several hash tables keys a vector by the signs of random projections.
Vectors that share a key in any table are compared exactly, in double
precision.  A pair that shares several keys is counted in the first of them
only, so link counts are exact sums over tables without a list of pairs.

Equal vectors count as one class with a weight.  Keys that one class has alone
go no further.  A key's classes are dealt by *blocks* of bounded size: where a
key is frequent its classes are split by hash and every two blocks meet in a
cell of their own, so no task holds a whole group; a cell compares its vectors
with one matrix product and returns counts per vector and a spanning forest of
its links, never a row per pair.  Components come from the forests.

The number of planes follows the logarithm of the number of vectors, so that
chance collisions stay few; the number of tables follows from it and from the
threshold, so that a pair at the threshold is missed with probability ``MISS``
and closer pairs with less.

Defined results: null, empty or zero vectors, and those with components that
are null or not finite, link with nothing and are their own component; vectors
of different length do not link; a null id takes part, but names no component.
Repeated rows are equal vectors and link.  An empty table gives no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import kernels as K
from tessera.llm.components import connected_components
from tessera.llm.spark_util import checkpointed

THRESHOLD = 0.95
#: Probability of missing a pair whose cosine is just the threshold.
MISS = 1e-5
SEED = 20240229
#: Classes of a key that meet in one cell, about.
BLOCK = 1024
#: Groups up to this size are compared pair by pair, larger ones as matrices.
SMALL = 32


def table_shape(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Planes of a table, and tables, for n vectors."""
    planes = max(8, math.ceil(math.log2(max(n, 1))) + 2)
    agree = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, math.ceil(math.log(miss) / math.log1p(-agree))


def signs_of(unit: np.ndarray, planes: int, tables: int) -> np.ndarray:
    """Signs of all projections, by vector and table."""
    normals = np.random.default_rng((SEED, unit.shape[1])).standard_normal((unit.shape[1], tables * planes))
    return (unit @ normals >= 0).reshape(len(unit), tables, planes)


def _by_length(packed: list[bytes]) -> Iterator[list[int]]:
    sizes = [len(x) for x in packed]
    for size in sorted(set(sizes)):
        yield [i for i, x in enumerate(sizes) if x == size]


def _signer(planes: int, tables: int, kind: str):
    """Adds the packed signs of each vector."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                packed = batch.column("vector").to_pylist()
                out = [b""] * len(packed)
                for at in _by_length(packed):
                    bits = np.packbits(signs_of(_unit([packed[j] for j in at], kind), planes, tables), axis=2)
                    for j, row in zip(at, bits, strict=True):
                        out[j] = row.tobytes()
                yield pa.record_batch({"node": batch.column("node"), "weight": batch.column("weight"), "vector": batch.column("vector"), "signs": pa.array(out, pa.binary())})

    return sign


def _keys(signs: list[bytes], tables: int) -> np.ndarray:
    """A key per vector and table."""
    bits = np.frombuffer(b"".join(signs), np.uint8).reshape(len(signs), tables, -1)
    key = np.zeros(bits.shape[:2], np.int64)
    for i in range(bits.shape[2]):
        key = key << 8 | bits[:, :, i]
    return key


def _named(tables: int):
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                node = np.repeat(batch.column("node").to_numpy(), tables)
                yield pa.record_batch({
                    "node": pa.array(node),
                    "table": pa.array(np.tile(np.arange(tables, dtype=np.int32), batch.num_rows)),
                    "key": pa.array(_keys(batch.column("signs").to_pylist(), tables).ravel()),
                })

    return name


def _unit(packed: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as rows of norm 1, in double precision."""
    vectors = np.frombuffer(b"".join(packed), kind).reshape(len(packed), -1).astype(np.float64)
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that no square overflows
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _cleaner(kind: str):
    """Vectors as packed numbers; null if they link with nothing."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                out = []
                for x in batch.column("embedding").to_pylist():
                    v = np.array(x, kind) + 0.0 if x and None not in x else np.zeros(0)  # -0.0 becomes 0.0
                    out.append(v.astype(kind).tobytes() if v.any() and np.isfinite(v).all() else None)
                yield pa.record_batch({"vec_id": batch.column("vec_id"), "vector": pa.array(out, pa.binary())})

    return clean


def _meet(threshold: float, tables: int, kind: str):
    """Links of the cells of a bin: counts per node, and a spanning forest."""

    def meet(table: pa.Table) -> pa.Table:
        column = lambda name: table[name].to_numpy()
        order = np.lexsort((column("node"), column("high"), column("low"), column("key"), column("table")))
        table = table.combine_chunks().take(pa.array(order))
        node, weight, number, low, high, block = (column(x) for x in ("node", "weight", "table", "low", "high", "block"))
        packed = table["vector"].to_pylist()
        keys = _keys(table["signs"].to_pylist(), tables)
        start = K.group_starts(number, column("key"), low, high)
        many = np.diff(np.append(start, len(node)))
        group = np.repeat(np.arange(len(start)), many)
        links = np.zeros(len(node), np.int64)
        parent: dict[int, int] = {}
        a: list[int] = []
        b: list[int] = []

        def root(x: int) -> int:
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def count(x: np.ndarray, y: np.ndarray) -> None:
            """Linked rows; those that an earlier table counts are passed over."""
            earlier = (keys[x] == keys[y]) & (np.arange(tables)[None, :] < number[x][:, None])
            first = ~earlier.any(axis=1)
            x, y = x[first], y[first]
            links[:] += np.bincount(x, weights=weight[y], minlength=len(node)).astype(np.int64)
            links[:] += np.bincount(y, weights=weight[x], minlength=len(node)).astype(np.int64)
            for p, q in zip(node[x].tolist(), node[y].tolist(), strict=True):
                rp, rq = root(p), root(q)
                if rp != rq:
                    parent[max(rp, rq)] = min(rp, rq)
                    a.append(p)
                    b.append(q)

        for at in _by_length(packed):
            rows = np.array(at)
            place = np.full(len(node), -1)
            place[rows] = np.arange(len(rows))
            unit = _unit([packed[i] for i in at], kind)
            fits = lambda x, y: (place[x] >= 0) & (place[y] >= 0) & ((low[x] == high[x]) | (block[x] != block[y]))
            for d in range(1, SMALL):
                x = np.flatnonzero((group[:-d] == group[d:]) & (many[group[:-d]] <= SMALL)) if d < len(node) else rows[:0]
                if not len(x):
                    break
                x = x[fits(x, x + d)]
                for i in range(0, len(x), 20_000):
                    p = x[i : i + 20_000]
                    near = np.einsum("ij,ij->i", unit[place[p]], unit[place[p + d]]) >= threshold
                    count(p[near], p[near] + d)
            for g in np.flatnonzero(many > SMALL).tolist():
                inside = np.arange(start[g], start[g] + many[g])
                inside = inside[place[inside] >= 0]
                for i in range(0, len(inside), 512):
                    some, rest = inside[i : i + 512], inside[i:]
                    x, y = np.nonzero(unit[place[some]] @ unit[place[rest]].T >= threshold)
                    x, y = some[x], rest[y]
                    both = (x < y) & fits(x, y)
                    x, y = x[both], y[both]
                    for k in range(0, len(x), 100_000):
                        count(x[k : k + 100_000], y[k : k + 100_000])
        some = np.flatnonzero(links)
        return pa.table({
            "a": pa.array(np.concatenate([node[some], np.array(a, np.int64)])),
            "b": pa.array(np.concatenate([node[some], np.array(b, np.int64)])),
            "n": pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)])),
        })

    return meet


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding)."""
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"
    cleaned = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_cleaner(kind), "vec_id long, vector binary")
    cleaned = checkpointed(cleaned.withColumn("node", F.xxhash64("vector")))
    classes = cleaned.where("vector IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    classes = checkpointed(classes)
    planes, tables = table_shape(classes.count(), threshold, miss)
    signed = checkpointed(classes.select("node", "weight", "vector").mapInArrow(_signer(planes, tables, kind), "node long, weight long, vector binary, signs binary"))
    named = signed.select("node", "signs").mapInArrow(_named(tables), "node long, table int, key long")
    blocks = named.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1").select("table", "key", F.ceil(F.col("n") / block).alias("blocks"))
    placed = named.join(blocks, ["table", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    cells = F.expr("transform(sequence(0L, blocks - 1), o -> named_struct('low', least(block, o), 'high', greatest(block, o)))")
    dealt = placed.select("node", "table", "key", "block", F.explode(cells).alias("cell")).select("node", "table", "key", "block", "cell.low", "cell.high")
    bins = 4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.withColumn("bin", F.pmod(F.xxhash64("table", "key", "low", "high"), F.lit(bins)))
    met = checkpointed(dealt.join(signed, "node").groupBy("bin").applyInArrow(_meet(threshold, tables, kind), "a long, b long, n long"))
    links = met.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    components = connected_components(met.where("a <> b"))
    names = classes.select("node", "least", "weight").join(components, "node", "left").select("node", "least", "weight", F.coalesce("component", "node").alias("component"))
    least = names.groupBy("component").agg(F.min("least").alias("component_id"))
    known = names.join(least, "component").join(links, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = cleaned.select("vec_id", F.when(F.col("vector").isNotNull(), F.col("node")).alias("node")).join(known, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
