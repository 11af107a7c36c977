"""Versioned folders of Parquet tables.

A save writes a new version folder and names it in a pointer table last, so a
reader sees a whole version or the one before.  All access goes through
Spark's readers and writers, so any file system that Spark knows will do.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import CorruptIndex

FORMAT = 1


def _path(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file on any file system that Spark knows."""
    fs, p = _path(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def names(spark: SparkSession, root: str) -> list[str]:
    """What is in a folder, in order; nothing if there is none."""
    fs, p = _path(spark, root)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n[1:]) for n in names(spark, root) if n.startswith("v") and n[1:].isdigit())


def current(spark: SparkSession, root: str) -> dict:
    """The pointer: version, format and configuration."""
    pointers = [v for v in versions(spark, f"{root}/pointers")]
    if not pointers:
        raise CorruptIndex(f"no index at {root}")
    try:
        found = json.loads(spark.read.text(f"{root}/pointers/v{pointers[-1]}").first()[0])
    except Exception as e:
        raise CorruptIndex(f"the pointer at {root} cannot be read") from e
    if found.get("format") != FORMAT:
        raise CorruptIndex(f"unknown format {found.get('format')!r}")
    return found


def save(spark: SparkSession, root: str, tables: dict[str, DataFrame], config: dict, partitions: dict[str, str] | None = None, keep: int = 2) -> int:
    """Writes a version and points to it; older versions than the last ``keep`` go."""
    version = max([0, *versions(spark, root), *versions(spark, f"{root}/pointers")]) + 1
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        if partitions and name in partitions:
            writer = writer.partitionBy(partitions[name])
        writer.parquet(f"{root}/v{version}/{name}")
    pointer = json.dumps({"format": FORMAT, "version": version, "tables": sorted(tables), "config": config})
    # the pointer is one row in a folder of its own: its rename makes the version visible
    staged = f"{root}/staged-{version}"
    spark.createDataFrame([(pointer,)], "value string").coalesce(1).write.mode("overwrite").text(staged)
    fs, p = _path(spark, f"{root}/pointers")
    fs.mkdirs(p)
    fs.rename(_path(spark, staged)[1], _path(spark, f"{root}/pointers/v{version}")[1])
    for old in versions(spark, f"{root}/pointers")[:-keep]:
        delete(spark, f"{root}/pointers/v{old}")
        delete(spark, f"{root}/v{old}")
    return version


def load(spark: SparkSession, root: str) -> tuple[dict[str, DataFrame], dict]:
    """Tables of the current version, read lazily, and its configuration."""
    pointer = current(spark, root)
    folder = f"{root}/v{pointer['version']}"
    missing = [t for t in pointer["tables"] if not exists(spark, f"{folder}/{t}")]
    if missing:
        raise CorruptIndex(f"{folder} lacks {', '.join(missing)}")
    return {t: spark.read.parquet(f"{folder}/{t}") for t in pointer["tables"]}, pointer["config"]
