"""A corpus pipeline: from raw documents to packed training sequences.

Each stage takes all that its predecessor kept and returns a DataFrame; all
but the last return the columns of ``documents``.  ``run`` writes the result of
each stage as Parquet in the shared checkpoint folder and reads it again.

Defined results: rows are judged one by one, whatever their ids.  A null or
empty text has no words: it stays unless the classifier rejects it, and is
packed as one end mark.  Texts are judged whole, however long.  Of rows equal in
id and set of shingles one stays.  An empty table gives no rows.  Other columns
come out as they went in, also those named like an operator's results; the last
stage returns ids and places only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, ngram_join, packing, quality, substring_dedup
from tessera.llm.queries import tokenizer_path
from tessera.llm.spark_util import checkpoint_dir, columns_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns as one, so that no operator meets their names."""
    others = [F.col(c) for c in columns_of(docs) if c not in ("`doc_id`", "`text`")]
    return docs.select("doc_id", "text", F.struct(F.lit(True).alias("_"), *others).alias("carried"))


def _restored(out: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    """The columns of docs from rows that carry them."""
    return out.select(*[changed.get(c, F.col(q) if c in ("doc_id", "text") else F.col(f"carried.{q}")).alias(c) for c, q in zip(docs.columns, columns_of(docs), strict=True)])


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier selects; the others go."""
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return _restored(quality.judge(_carried(docs), model).where("kept"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at 0.8."""
    return ngram_join.one_of_each(docs, ngram_join.Similarity(5, 80, 100))


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in several places; other texts stay as they are."""
    out = substring_dedup.remove_repeated_passages(_carried(docs))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("carried.n_chars"))
    return _restored(out, docs, text=text, n_chars=n_chars)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its place in a sequence."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", select_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", remove_passages),
    ("benchmark decontamination", drop_benchmark),
    ("best-fit packing", pack),
]

#: SQL expresses none of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what all stages keep of ``documents``."""
    docs = _table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
