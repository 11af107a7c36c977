"""Product codes of vectors, trained on distinct parts with weights.

Components become integers, so every distance, sum and mean is exact.  Vectors
are kept in chunks of bounded size.  Per chunk and part position equal parts
are counted once; those counts are dealt by a hash of position and part, so a
part that a third of all vectors share arrives once from each chunk, and are
added up to distinct rows with weights.  Lloyd's rounds and the final
assignment see distinct rows only.  A distinct row's code and error then go
back to the chunks that have it, in the order in which they came, and each
chunk looks them up for its vectors.

Sums by label are map-side combined.  Labels with at least one in ``FREQUENT``
of all rows, at most ``FREQUENT`` of them, are joined by broadcast; the others,
of which none is frequent, by a shuffle.

Defined results: vectors that are null or empty or have components that are
null or not finite are dropped, and so are those of another length than most
(of equally frequent lengths the greatest counts).  Where the length is no
multiple of the parts, vectors count as if zeros followed.  Repeated rows count
and come out each; of rows of one id the lower vectors come first in the first
codebooks, and null ids come last.  Fewer vectors than entries make shorter
codebooks; an empty table gives no rows.  Codes are exact at any size of
components; a part's error beyond 2**50 is given as that.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import kernels as K
from tessera.llm import vector_batches as V
from tessera.llm.spark_util import checkpoint_dir

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0
#: Vectors of a chunk, and distances computed at once.
CHUNK, AT_ONCE = 16_384, 1 << 20
#: Distinct rows of a bucket, about.
BUCKET = 1 << 20
#: A label with one in so many rows is frequent.
FREQUENT = 10_000

_LIMIT = float(1 << 62)
#: Squared distances beyond are held here, so that those of all parts fit in 64 bits.
_MOST = 1 << 50


def integers(vectors: np.ndarray, parts: int, scale: float = SCALE) -> np.ndarray:
    """floor(scale * c), cut into parts of equal size: vector, part, component."""
    x = np.clip(np.floor(vectors * scale), -_LIMIT, _LIMIT).astype(np.int64)
    size = -(-x.shape[1] // parts)
    if size * parts > x.shape[1]:
        x = np.concatenate([x, np.zeros((len(x), size * parts - x.shape[1]), np.int64)], axis=1)
    return x.reshape(len(x), parts, size)


def _pack(x: np.ndarray) -> bytes:
    """Integers in the fewest bytes each; the first byte tells how many."""
    for kind in (np.int8, np.int16, np.int32):
        info = np.iinfo(kind)
        if not x.size or info.min <= x.min() and x.max() <= info.max:
            return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()
    return b"\x08" + x.tobytes()


def _unpack(data: pa.Buffer | bytes) -> np.ndarray:
    return np.frombuffer(data, f"<i{memoryview(data)[0]}", offset=1).astype(np.int64)


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a matrix in ascending order, and for each row which of them it is."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    low = rows.min(axis=0)
    width = [int(w) + 1 for w in rows.max(axis=0).astype(object) - low]
    total = 1
    for w in width:
        total *= w
    if total < 1 << 63:
        key = np.zeros(len(rows), np.int64)
        for j, w in enumerate(width):
            key = key * w + (rows[:, j] - low[j])
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        return rows[first], which
    return np.unique(rows, axis=0, return_inverse=True)


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the first of equals, and its squared distance, exact up to ``_MOST``."""
    most = max(np.abs(rows).max(initial=0), np.abs(book).max(initial=0))
    code, error = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    wide = float(most) ** 2 * 4 * rows.shape[1] >= 1 << 52
    step = max(1, AT_ONCE // (len(book) * (rows.shape[1] if wide else 1)))
    for i in range(0, len(rows), step):
        x = rows[i : i + step]
        if wide:
            kind = object if float(most) ** 2 * 4 * rows.shape[1] >= _LIMIT else np.int64
            d = ((x[:, None, :].astype(kind) - book[None].astype(kind)) ** 2).sum(axis=2)
        else:
            a, b = x.astype(np.float64), book.astype(np.float64)
            d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None]  # whole numbers below 2**53
        code[i : i + step] = d.argmin(axis=1)
        error[i : i + step] = np.minimum(d.min(axis=1), _MOST if wide else np.inf).astype(np.int64)
    return code, error


def _chunks(rows: DataFrame, dim: int, parts: int, scale: float, label_type: T.DataType, id_type: T.DataType) -> DataFrame:
    """A row per chunk: its ids, labels and packed integers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, waiting, held = TaskContext.get().partitionId(), 0, [], 0

        def chunk(table: pa.Table) -> pa.RecordBatch:
            x = integers(V.matrix(table.column("v").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float64())), dim), parts, scale)
            lists = [pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type)) for c in ("id", "label")]
            return pa.record_batch([pa.array([(task << 32) | number], pa.int64()), *lists, pa.array([_pack(x)], pa.binary())], names=["chunk", "ids", "labels", "x"])

        for batch in batches:
            waiting.append(batch)
            held += batch.num_rows
            if held >= CHUNK:
                whole = pa.Table.from_batches(waiting)
                for i in range(0, held - CHUNK + 1, CHUNK):
                    yield chunk(whole.slice(i, CHUNK))
                    number += 1
                rest = held % CHUNK
                waiting, held = (whole.slice(whole.num_rows - rest).to_batches() if rest else []), rest
        if held:
            yield chunk(pa.Table.from_batches(waiting))

    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("labels", T.ArrayType(label_type)), T.StructField("x", T.BinaryType())])
    return rows.mapInArrow(pack, schema)


class _Dealt:
    """The distinct parts of a chunk in the order in which buckets get them."""

    def __init__(self, data, parts: int, size: int, buckets: int):
        x = _unpack(data).reshape(-1, parts, size)
        rows, where, self.of = [], [], []
        for p in range(parts):
            values, which = distinct(x[:, p])
            self.of.append(which)
            rows.append(values)
            where.append(np.full(len(values), p, np.int64))
        values, place = np.concatenate(rows), np.concatenate(where)
        counts = np.concatenate([np.bincount(w, minlength=len(v)) for w, v in zip(self.of, rows, strict=True)])
        key = K.mix(place.astype(np.uint64) + np.uint64(1))
        for j in range(size):
            key = K.mix(key ^ values[:, j].astype(np.uint64))
        bucket = (key % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.values, self.place, self.counts, self.bucket = values[self.order], place[self.order], counts[self.order], bucket[self.order]
        self.start = K.group_starts(self.bucket)
        self.stop = np.append(self.start[1:], len(self.bucket))
        self.first = np.cumsum([0, *map(len, rows)])


def _distinct_parts(chunks: DataFrame, parts: int, size: int, buckets: int) -> DataFrame:
    """A row per bucket: distinct (place, value) with weights, and for each chunk which of them it sent."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("x"), strict=True):
                d = _Dealt(data.as_buffer(), parts, size, buckets)
                spans = list(zip(d.start, d.stop, strict=True))
                yield pa.record_batch(
                    [
                        pa.array(d.bucket[d.start]), pa.array(np.full(len(spans), chunk)),
                        *[pa.array([_pack(x[a:b]) for a, b in spans], pa.binary()) for x in (d.place, d.values, d.counts)],
                    ],
                    names=["bucket", "chunk", "place", "value", "weight"],
                )

    def merge(table: pa.Table) -> pa.Table:
        get = lambda c: [_unpack(x.as_buffer()) for x in table.column(c)]
        place, value, weight = get("place"), get("value"), get("weight")
        rows = np.concatenate([np.concatenate(place)[:, None], np.concatenate(value).reshape(-1, size)], axis=1)
        values, which = distinct(rows)
        total = np.zeros(len(values), np.int64)
        np.add.at(total, which, np.concatenate(weight))
        sent = np.split(which, np.cumsum([len(x) for x in place])[:-1])
        return pa.table({
            "bucket": table.column("bucket").slice(0, 1), "place": pa.array([_pack(values[:, 0])], pa.binary()), "value": pa.array([_pack(values[:, 1:])], pa.binary()), "weight": pa.array([_pack(total)], pa.binary()),
            "chunks": pa.array([table.column("chunk").to_pylist()], pa.list_(pa.int64())), "sent": pa.array([[_pack(x) for x in sent]], pa.list_(pa.binary())),
        })

    dealt = chunks.mapInArrow(deal, "bucket long, chunk long, place binary, value binary, weight binary")
    return dealt.groupBy("bucket").applyInArrow(merge, "bucket long, place binary, value binary, weight binary, chunks array<long>, sent array<binary>")


def _each_place(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """row, place, where it stands in the row, values, weights."""
    for r in range(batch.num_rows):
        place, value, weight = (_unpack(batch.column(c)[r].as_buffer()) for c in ("place", "value", "weight"))
        value = value.reshape(-1, size)
        start = K.group_starts(place)
        for a, b in zip(start, np.append(start[1:], len(place)), strict=True):
            yield r, int(place[a]), np.arange(a, b), value[a:b], weight[a:b]


def _round(parts_table: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round of Lloyd over distinct rows with weights."""
    parts, entries, size = books.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, size), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, p, _, value, weight in _each_place(batch, size):
                code, _ = nearest(value, books[p])
                safe = float(np.abs(value).max(initial=0)) * float(weight.sum()) < _LIMIT
                add = np.zeros((entries, size), np.int64 if safe else object)
                np.add.at(add, code, value * weight[:, None] if safe else value.astype(object) * weight[:, None])
                sums[p] += add
                np.add.at(counts[p], code, weight)
        at = np.flatnonzero(counts.ravel())
        if len(at):
            flat = sums.reshape(-1, size)
            yield pa.record_batch({"at": pa.array(at, pa.int32()), "n": pa.array(counts.ravel()[at]), "s": pa.array([[str(x) for x in flat[i]] for i in at], pa.list_(pa.string()))})

    found = parts_table.select("place", "value", "weight").mapInArrow(partial, "at int, n long, s array<string>")
    totals = [F.sum(F.col("s")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(size)]
    out = books.copy().reshape(-1, size)
    for r in found.groupBy("at").agg(F.sum("n").alias("n"), *totals).collect():  # at most a row per entry
        out[r["at"]] = [int(r[f"s{j}"]) // int(r["n"]) for j in range(size)]
    return out.reshape(books.shape)


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error, label_error) of each vector, and the codebooks: part, entry, component.

    code: the entries' numbers in the order of parts, two hex digits each.
    """
    spark, types = vectors.sparkSession, {c: vectors.schema[c].dataType for c in (id_column, label)}
    schema = T.StructType([T.StructField("id", types[id_column]), T.StructField("label", types[label]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not 1 <= entries <= 256:
        raise ValueError("codes have two hex digits: 1 to 256 entries")
    rows = V.usable(vectors.select(F.col(id_column).alias("id"), F.col(label).alias("label"), F.col(column).alias("v")), "v")
    dim = V.dimension(rows, "v")
    if dim is None:
        empty = spark.createDataFrame([], schema).withColumn("label_error", F.lit(None).cast("long"))
        return empty, np.zeros((parts, 0, 0), np.int64)
    rows = rows.where(F.size("v") == dim)
    size = -(-dim // parts)
    folder = f"{checkpoint_dir(spark)}/codes-{uuid.uuid4().hex}"

    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = np.ascontiguousarray(integers(np.array([r["v"] for r in first], np.float64), parts, scale).transpose(1, 0, 2))

    _chunks(rows, dim, parts, scale, types[label], types[id_column]).write.parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")
    n = chunks.agg(F.sum(F.size("ids"))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * parts // BUCKET))
    _distinct_parts(chunks, parts, size, buckets).write.parquet(f"{folder}/parts")
    table = spark.read.parquet(f"{folder}/parts")
    for _ in range(rounds):
        books = _round(table, books)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = [None] * batch.num_rows, [None] * batch.num_rows
            for r, p, at, value, _ in _each_place(batch, size):
                if codes[r] is None:
                    codes[r], errors[r] = (np.zeros(len(_unpack(batch.column("place")[r].as_buffer())), np.int64) for _ in range(2))
                codes[r][at], errors[r][at] = nearest(value, books[p])
            for r in range(batch.num_rows):
                sent = [_unpack(x.as_buffer()) for x in batch.column("sent")[r]]
                yield pa.record_batch({
                    "chunk": pa.array(batch.column("chunks")[r].as_py(), pa.int64()), "bucket": pa.array([batch.column("bucket")[r].as_py()] * len(sent), pa.int64()),
                    "codes": pa.array([codes[r][x].astype(np.uint8).tobytes() for x in sent], pa.binary()), "errors": pa.array([_pack(errors[r][x]) for x in sent], pa.binary()),
                })

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        d = _Dealt(left.column("x")[0].as_buffer(), parts, size, buckets)
        by_bucket = np.argsort(right.column("bucket").to_numpy(), kind="stable").tolist()
        code, error = np.empty(len(d.order), np.uint8), np.empty(len(d.order), np.int64)
        code[d.order] = np.frombuffer(b"".join(right.column("codes")[i].as_py() for i in by_bucket), np.uint8)
        error[d.order] = np.concatenate([_unpack(right.column("errors")[i].as_buffer()) for i in by_bucket])
        mine = [d.first[p] + d.of[p] for p in range(parts)]
        digits = np.stack([code[x] for x in mine], axis=1).tobytes().hex()
        total = sum(error[x] for x in mine)
        ids, labels = left.column("ids")[0].values, left.column("labels")[0].values
        return pa.table({"id": ids, "label": labels, "code": pa.array([digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)], pa.string()), "error": pa.array(total, pa.int64())})

    answers = table.mapInArrow(answer, "chunk long, bucket long, codes binary, errors binary")
    chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(look_up, schema).write.parquet(f"{folder}/coded")
    coded = spark.read.parquet(f"{folder}/coded")
    return _with_label_errors(coded, n), books


def _with_label_errors(coded: DataFrame, n: int) -> DataFrame:
    """coded with the error summed over equal labels, nulls together."""
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows")).withColumnRenamed("label", "other")
    frequent = totals.where(F.col("rows") * FREQUENT >= n).drop("rows")  # at most FREQUENT rows
    same = F.col("label").eqNullSafe(F.col("other"))
    rare = totals.where(F.col("rows") * FREQUENT < n).drop("rows")
    out = coded.join(F.broadcast(frequent), same).drop("other")
    if rare.isEmpty():
        return out
    rest = coded.join(F.broadcast(frequent), same, "left_anti")
    return out.unionByName(rest.join(rare, same).drop("other"))
