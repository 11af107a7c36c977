"""Small helpers for jobs that must survive lost executors."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a sieve: 8 MB, however many keys it has.
SIEVE = 1 << 26


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only if none is set and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.sparkContext.setCheckpointDir(folder)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder from now on."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def compressed(data: bytes | pa.Buffer) -> bytes:
    """The length of data, and data compressed."""
    size = data.size if isinstance(data, pa.Buffer) else len(data)
    return size.to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def length_of(packed: bytes) -> int:
    """The length of what was compressed."""
    return int.from_bytes(packed[:8], "little")


def restored(packed: bytes) -> bytes:
    return pa.Codec("zstd").decompress(packed[8:], length_of(packed), asbytes=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its names."""
    taken = {x.lower() for x in df.columns}
    while name in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[str]:
    """The names of df's columns, quoted."""
    return ["`" + x.replace("`", "``") + "`" for x in df.columns]


def sieved(df: DataFrame, key: str, keys: DataFrame, inside: bool = True) -> DataFrame:
    """Rows of df whose long ``key`` may be among ``keys`` (one column), or, if not ``inside``, those whose key is not.

    Keys are bits of a table of fixed size, by a hash, so df stays where it is
    however many keys there are; of the rows whose key is not among them a few
    are taken for those that are, and an exact join must follow.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(SIEVE)) + 1
    part, bits, at = fresh(df, "part"), fresh(df, "bits"), place(F.col(key))
    table = keys.select(place(F.col(keys.columns[0])).alias("p")).groupBy(F.bitmap_bucket_number("p").alias(part)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(bits))
    joined = df.withColumn(part, F.bitmap_bucket_number(at)).join(F.broadcast(table), part, "left")
    there = F.coalesce(_bit(F.col(bits), F.bitmap_bit_position(at)), F.lit(0)) == 1
    return joined.where(there if inside else ~there).select(*columns_of(df))


def _bit(bits: Column, at: Column) -> Column:
    """A bit of a bitmap."""
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int"))
