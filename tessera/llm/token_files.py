"""Token ids of documents in files, and the files as a data source of Spark.

A file holds documents in ascending order of their ids: segments of coded ids
(``range_coder``), then a table of documents, then where that table stands.
``write`` encodes and sorts; each task writes one file under a name of its own,
and the driver's commit writes the manifest that lists the files of successful
tasks, in order, with the number of ids before each.  A reader sees what a
manifest lists, so lost or repeated tasks leave nothing that counts.  Files are
read one per task, and each tells where its ids start.

Folders may be on any file system that Arrow opens by URI.

Defined results: null text is empty, and a document without ids has its end
mark only; strings of special tokens are the tokens, as the library's default
has it.  Documents of one id follow each other by the hash of their text, and
equal ones in the order read; null ids come first.  Texts are encoded whole,
however long.  An empty table gives a folder without files.  Other columns are
ignored.
"""

from __future__ import annotations

import functools
import json
import re
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

from tessera.errors import CorruptIndex
from tessera.llm import range_coder
from tessera.llm.piece_table import PieceTable
from tessera.llm.spark_util import checkpoint_dir
from tessera.llm.token_counts import Bpe, Remembered, batches_of

#: Id put after each document.
END = 0
#: Ids of a segment, and of a file, about.
SEGMENT = range_coder.BLOCK * range_coder.LANES
FILE = SEGMENT
#: Bytes of ids in a batch that is read.
BATCH = 1 << 22

_MAGIC = b"TSQ1"
_TAIL = struct.Struct("<QQ4s")  # where the table of documents starts, its bytes

# Letters that need no Unicode tables, and the pattern that cuts texts before merging.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_UNUSUAL = re.compile(f"[^\t-\r -~{_LETTERS}]")
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")


class ByteBpe(Bpe):
    """A byte-level BPE that keeps white space and case."""

    def _words(self, text: str) -> list[str]:
        if _UNUSUAL.search(text) is None:
            return _PIECES.findall(text)
        return [bytes(self.bytes_of[c] for c in word).decode("utf-8", "surrogateescape") for word, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]


@functools.lru_cache(maxsize=2)
def _remembered(path: str) -> Remembered:
    return Remembered(ByteBpe(path), True)


@functools.lru_cache(maxsize=2)
def _pieces(path: str, end: int) -> PieceTable:
    return PieceTable(ByteBpe(path), end)


def encode(docs: DataFrame, tokenizer: str, end: int = END, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, hash of the text, n_tokens and ids (the end mark last) of each document.

    ids are unsigned and little-endian, of 16 bits if the vocabulary fits in them, else of 32.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _pieces(tokenizer, end)
        kind = np.dtype("<u2" if table.widest < 1 << 16 else "<u4")
        for batch in (part for whole in batches for part in batches_of(whole)):
            ids, n = table.encode(batch.column("text"))
            data, stop = pa.py_buffer(ids.astype(kind)), pa.py_buffer(np.append(0, np.cumsum(n) * kind.itemsize).astype(np.int64))
            packed = pa.Array.from_buffers(pa.large_binary(), len(n), [None, stop, data]).cast(pa.binary())
            yield pa.record_batch([batch.column("id"), batch.column("hash"), pa.array(n, pa.int64()), packed], names=["id", "hash", "n_tokens", "ids"])

    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("hash", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def write(encoded: DataFrame, folder: str, per_file: int = FILE) -> None:
    """Writes encoded documents in ascending order of their ids into files of about so many ids."""
    spark = encoded.sparkSession
    _register(spark)
    staged = f"{checkpoint_dir(spark)}/encoded-{uuid.uuid4().hex}"
    # the number breaks ties between equal rows, so that a group of them can be dealt to several files
    encoded.withColumn("number", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(staged)
    table = spark.read.parquet(staged)
    total = table.agg(F.sum("n_tokens")).first()[0] or 0
    order = [F.col("id").asc_nulls_first(), F.col("hash"), F.col("number")]
    files = table.repartitionByRange(max(1, -(-total // per_file)), *order).sortWithinPartitions(*order)
    files.select("id", "n_tokens", "ids").write.format(TokenFiles.name()).mode("append").save(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """id, start (ids of all documents before), n_tokens and ids of the documents in a folder."""
    _register(spark)
    return spark.read.format(TokenFiles.name()).load(folder)


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(TokenFiles)


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith(("file:", "/")) else (pafs.LocalFileSystem(), folder)


_MANIFEST = "manifest.json"


class TokenFiles(DataSource):
    """Format ``token_files``: a folder of files of coded ids."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def _manifest(self) -> dict:
        fs, root = _open(self.options["path"])
        try:
            with fs.open_input_file(f"{root}/{_MANIFEST}") as f:
                return json.loads(f.read())
        except FileNotFoundError as e:
            raise CorruptIndex(f"no token files at {root}") from e

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("id", T.StructType.fromJson(self._manifest()["schema"])["id"].dataType), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._manifest()["files"])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], schema)


class _Written(WriterCommitMessage):
    def __init__(self, task: int, file: str, ids: int, documents: int):
        self.task, self.file, self.ids, self.documents = task, file, ids, documents


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: T.StructType):
        self.folder, self.schema = folder, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        fs, root = _open(self.folder)
        fs.create_dir(root, recursive=True)
        name = f"{task:06d}-{uuid.uuid4().hex}.ids"
        documents, waiting, held, total = [], [], 0, 0
        with fs.open_output_stream(f"{root}/{name}") as out:

            def flush(whole: bool) -> None:
                nonlocal waiting, held
                ids = np.concatenate(waiting) if waiting else np.zeros(0, "<u2")
                at = 0
                while len(ids) - at >= 2 * SEGMENT or whole and at < len(ids):
                    # what is left at the end is dealt evenly: a small segment costs as many steps as a large one
                    size = -(-(len(ids) - at) // max(1, round((len(ids) - at) / SEGMENT))) if whole else SEGMENT
                    part = range_coder.encode_segment(ids[at : at + size])
                    out.write(struct.pack("<Q", len(part)) + part)
                    at += size
                waiting, held = ([ids[at:].copy()] if at < len(ids) else []), max(0, len(ids) - at)

            for batch in iterator:
                documents.append(batch.select(["id", "n_tokens"]))
                for x, n in zip(batch.column("ids"), batch.column("n_tokens").to_pylist(), strict=True):
                    waiting.append(np.frombuffer(x.as_buffer(), f"<u{len(x.as_buffer()) // n}"))
                    held, total = held + n, total + n
                if held >= 2 * SEGMENT:
                    flush(False)
            flush(True)
            start = out.tell()
            sink = pa.BufferOutputStream()
            if documents:
                with pa.ipc.new_stream(sink, documents[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as ipc:
                    for part in documents:
                        ipc.write_batch(part)
            table = sink.getvalue()
            out.write(table)
            out.write(_TAIL.pack(start, table.size, _MAGIC))
        return _Written(task, name, total, sum(d.num_rows for d in documents))

    def commit(self, messages: list) -> None:
        fs, root = _open(self.folder)
        fs.create_dir(root, recursive=True)
        files, before = [], 0
        for m in sorted((m for m in messages if m is not None and m.documents), key=lambda m: m.task):
            files.append({"file": m.file, "start": before, "ids": m.ids})
            before += m.ids
        with fs.open_output_stream(f"{root}/{_MANIFEST}.new") as out:
            out.write(json.dumps({"schema": self.schema.jsonValue(), "files": files}).encode())
        fs.move(f"{root}/{_MANIFEST}.new", f"{root}/{_MANIFEST}")

    def abort(self, messages: list) -> None:
        fs, root = _open(self.folder)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/{m.file}")


class _File(InputPartition):
    def __init__(self, file: str, start: int):
        self.file, self.start = file, start


class _Reader(DataSourceReader):
    def __init__(self, folder: str, files: list[dict]):
        self.folder, self.files = folder, files

    def partitions(self) -> list[InputPartition]:
        return [_File(f["file"], f["start"]) for f in self.files] or [_File("", 0)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, root = _open(self.folder)
        with fs.open_input_file(f"{root}/{partition.file}") as f:
            size = f.size()
            f.seek(size - _TAIL.size)
            end, table_bytes, magic = _TAIL.unpack(f.read(_TAIL.size))
            if magic != _MAGIC:
                raise CorruptIndex(f"{partition.file} is not a file of token ids")
            f.seek(end)
            table = pa.ipc.open_stream(f.read_buffer(table_bytes)).read_all().combine_chunks()
            f.seek(0)

            def segments() -> Iterator[np.ndarray]:
                while f.tell() < end:
                    yield range_coder.decode_segment(f.read_buffer(struct.unpack("<Q", f.read(8))[0]))

            parts, held, at, start = [], 0, 0, partition.start
            counts = table.column("n_tokens").to_numpy()
            source = segments()
            ids = table.column("id").combine_chunks()
            while at < len(counts):
                stop = at + max(1, int(np.searchsorted(np.cumsum(counts[at : at + 65_536]), BATCH // 4, side="right")))
                need = int(counts[at:stop].sum())
                while held < need:
                    part = next(source, None)
                    if part is None:
                        raise CorruptIndex(f"{partition.file} has fewer ids than its documents")
                    parts.append(part)
                    held += len(part)
                have = np.concatenate(parts) if len(parts) > 1 else parts[0]
                data, parts, held = pa.py_buffer(have[:need].astype("<u4")), [have[need:]], held - need
                edge = np.append(0, np.cumsum(counts[at:stop]))
                values = pa.Array.from_buffers(pa.large_binary(), stop - at, [None, pa.py_buffer(4 * edge.astype(np.int64)), data]).cast(pa.binary())
                yield pa.record_batch([ids.slice(at, stop - at), pa.array(start + edge[:-1], pa.int64()), pa.array(counts[at:stop], pa.int64()), values], names=["id", "start", "n_tokens", "ids"])
                at, start = stop, start + need
