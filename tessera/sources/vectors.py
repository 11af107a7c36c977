"""Sources and sinks of vectors: tables, generated data and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_rows(spark: SparkSession, vectors: list[list[float]], ids: list) -> DataFrame:
    """A corpus of vectors in memory."""
    kind = "bigint" if all(isinstance(i, int) for i in ids) else "string"
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], f"id {kind}, embedding array<float>")


def wave(spark: SparkSession, n: int, dim: int, offset: int = 0, a: float = 0.173, b: float = 0.071) -> DataFrame:
    """Generated vectors: sin(i a) + cos(i b) over all components in row order."""
    i = lambda j: (F.col("id") + offset) * dim + j
    component = lambda j: (F.sin(i(j) * a) + F.cos(i(j) * b)).cast("float")
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), component).alias("embedding"))


def key_number(column: str = "id"):
    """The number in keys such as 'v_12'; null if there is none."""
    digits = F.regexp_extract(column, r"([0-9]+)$", 1)
    return F.when(digits != "", digits.cast("bigint"))


REPORT_COLUMNS = ["label", "recall_at_1", "recall_at_10", "recall_at_100", "qps", "build_time_ms", "p50_ms", "p95_ms", "p99_ms"]


def write_report(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """A benchmark report as csv or json."""
    out = rows.select(*REPORT_COLUMNS).coalesce(1).write.mode("overwrite")
    out.option("header", True).csv(path) if kind == "csv" else out.json(path)


def report_table(rows: list[dict]) -> str:
    """A benchmark report as text."""
    cells = [REPORT_COLUMNS, *[[f"{r[c]:.3f}" if isinstance(r[c], float) else str(r[c]) for c in REPORT_COLUMNS] for r in rows]]
    width = [max(len(x[i]) for x in cells) for i in range(len(REPORT_COLUMNS))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, width, strict=True)).rstrip() for line in cells)
