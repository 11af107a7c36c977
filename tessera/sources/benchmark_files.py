"""Benchmark files as a data source: train vectors, test vectors and true neighbours in one file.

Read by ranges of bytes, each by a task of its own; written by tasks that each
make a piece, which the commit puts together in order, block by block.

    spark.read.format("benchmark_file").option("part", "train").load(path)
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from tessera.errors import ConstructionFailed, CorruptIndex

# Fixed values of the benchmark file: magic, version and metric codes; the header
# has version, train and test counts, dimension, neighbours, metric and three reserved numbers.
MAGIC, VERSION = b"ANNB", 1
METRIC_CODES = ("cosine", "l2", "inner_product", "hamming")
HEADER = struct.Struct("<4s9I")

PARTS = ("train", "test", "truth")
#: Bytes that a task reads, and that the commit copies at once.
RANGE, COPIED = 32 << 20, 8 << 20


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path or path.startswith("/") else (pafs.LocalFileSystem(), path)


def header(path: str) -> dict:
    """Counts, dimension and metric; raises if the file is none or too short."""
    fs, name = _open(path)
    with fs.open_input_file(name) as f:
        size, raw = f.size(), f.read(HEADER.size)
    if len(raw) < HEADER.size or raw[:4] != MAGIC:
        raise CorruptIndex("not a benchmark file")
    _, version, n_train, n_test, dim, k, metric, *_ = HEADER.unpack(raw)
    if version != VERSION or metric >= len(METRIC_CODES) or size < HEADER.size + 4 * (dim * (n_train + n_test) + n_test * k):
        raise CorruptIndex("a benchmark file of an unknown version, or cut short")
    return {"train": n_train, "test": n_test, "truth": n_test, "dim": dim, "k": k, "metric": METRIC_CODES[metric]}


class BenchmarkFiles(DataSource):
    """Format ``benchmark_file``; option part: train, test or truth, option bytes: of a task's range."""

    @classmethod
    def name(cls) -> str:
        return "benchmark_file"

    def schema(self) -> T.StructType:
        value = T.LongType() if self.options.get("part") == "truth" else T.FloatType()
        return T.StructType([T.StructField("id", T.LongType()), T.StructField("embedding" if value == T.FloatType() else "near", T.ArrayType(value))])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("part", "train"), int(self.options.get("bytes", RANGE)))

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options["metric"])


class _Rows(InputPartition):
    def __init__(self, first: int, stop: int, offset: int, width: int):
        self.first, self.stop, self.offset, self.width = first, stop, offset, width


class _Reader(DataSourceReader):
    def __init__(self, path: str, part: str, range_bytes: int):
        if part not in PARTS:
            raise ConstructionFailed(f"a benchmark file has no part {part!r}")
        self.path, self.part, self.range_bytes = path, part, range_bytes

    def partitions(self) -> list[InputPartition]:
        h = header(self.path)
        vectors = 4 * h["dim"]
        start = HEADER.size + vectors * {"train": 0, "test": h["train"], "truth": h["train"] + h["test"]}[self.part]
        width, n = h["k"] if self.part == "truth" else h["dim"], h[self.part]
        rows = max(1, self.range_bytes // max(1, 4 * width))
        return [_Rows(i, min(i + rows, n), start + 4 * width * i, width) for i in range(0, n, rows)] or [_Rows(0, 0, start, width)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        fs, name = _open(self.path)
        kind, column = ("<u4", "near") if self.part == "truth" else ("<f4", "embedding")
        with fs.open_input_file(name) as f:
            f.seek(partition.offset)
            for i in range(partition.first, partition.stop, 8192):
                n = min(8192, partition.stop - i)
                values = np.frombuffer(f.read(4 * n * partition.width), kind)
                flat = pa.array(values.astype(np.int64)) if self.part == "truth" else pa.array(values)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * partition.width), flat)
                yield pa.record_batch([pa.array(np.arange(i, i + n, dtype=np.int64)), lists], names=["id", column])


class _Piece(WriterCommitMessage):
    def __init__(self, task: int, file: str, counts: list[int], widths: list[int]):
        self.task, self.file, self.counts, self.widths = task, file, counts, widths


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, metric: str):
        self.path, self.metric = path, metric

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        fs, name = _open(self.path)
        file = f"{name}.{uuid.uuid4().hex}.piece"
        counts, widths = [0, 0, 0], [-1, -1]
        with fs.open_output_stream(file) as out:
            for batch in iterator:
                for part, vector, near in zip(*(batch.column(c) for c in ("part", "embedding", "near")), strict=True):
                    truth = part.as_py() == 2
                    values = np.array((near if truth else vector).as_py(), "<u4" if truth else "<f4")
                    if widths[truth] not in (-1, len(values)):
                        raise ConstructionFailed("rows of a benchmark file are of one length")
                    widths[truth] = len(values)
                    counts[part.as_py()] += 1
                    out.write(values.tobytes())
        return _Piece(TaskContext.get().partitionId(), file, counts, widths)

    def commit(self, messages: list) -> None:
        fs, name = _open(self.path)
        pieces = sorted((m for m in messages if m is not None), key=lambda m: m.task)
        count = np.sum([m.counts for m in pieces], axis=0).tolist() if pieces else [0, 0, 0]
        wide = [{m.widths[i] for m in pieces} - {-1} for i in (0, 1)]
        if any(len(w) > 1 for w in wide) or count[1] != count[2]:
            self.abort(messages)
            raise ConstructionFailed("rows of one length, and as many lists of neighbours as test vectors, make a benchmark file")
        dim, k = (next(iter(w), 0) for w in wide)
        with fs.open_output_stream(f"{name}.new") as out:
            out.write(HEADER.pack(MAGIC, VERSION, count[0], count[1], dim, k, METRIC_CODES.index(self.metric), 0, 0, 0))
            for m in pieces:
                with fs.open_input_stream(m.file) as part:
                    while block := part.read(COPIED):
                        out.write(block)
        fs.move(f"{name}.new", name)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, _ = _open(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(m.file)


def read_benchmark(spark: SparkSession, path: str, range_bytes: int = RANGE) -> dict:
    """train, test and truth tables and the metric of a benchmark file; rows are numbered by their place."""
    spark.dataSource.register(BenchmarkFiles)
    part = lambda p: spark.read.format(BenchmarkFiles.name()).option("part", p).option("bytes", range_bytes).load(path)
    metric = header(path)["metric"]
    truth = part("truth").select(F.col("id").alias("query_id"), F.posexplode("near").alias("rank", "id")).select("query_id", "id", (F.col("rank") + 1).alias("rank"))
    return {"train": part("train"), "test": part("test").withColumnRenamed("id", "query_id"), "truth": truth, "metric": metric}


def write_benchmark(path: str, train: DataFrame, test: DataFrame, truth: DataFrame, metric: str) -> None:
    """Writes a benchmark file: train and test in the order of their ids, and each test vector's neighbours by rank."""
    spark = train.sparkSession
    spark.dataSource.register(BenchmarkFiles)
    none, no_ids = F.lit(None).cast("array<float>"), F.lit(None).cast("array<bigint>")
    near = truth.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col("id").cast("bigint").alias("id")))), lambda s: s["id"]).alias("near"))  # k each
    rows = train.select(F.lit(0).alias("part"), F.col("id"), F.col("embedding").cast("array<float>").alias("embedding"), no_ids.alias("near"))
    rows = rows.unionByName(test.select(F.lit(1).alias("part"), F.col("query_id").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), no_ids.alias("near")))
    rows = rows.unionByName(near.select(F.lit(2).alias("part"), F.col("query_id").alias("id"), none.alias("embedding"), "near"))
    ordered = rows.repartitionByRange("part", "id").sortWithinPartitions("part", "id")
    ordered.write.format(BenchmarkFiles.name()).option("metric", metric).mode("append").save(path)
