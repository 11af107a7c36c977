"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, embedding_dedup, html_text, ngram_join, packing, quality, substring_dedup, suffix_dedup, token_counts, token_files, url_reputation, vector_codes, whitening
from tessera.llm.spark_util import checkpoint_dir


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(_read(spark, sf_dir, "documents"), ngram_join.Similarity(3, 90, 100))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_path())


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected documents, with their grades."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _read(spark, sf_dir, "labels"))
    return quality.judge(docs, model, keep_text=False).where("kept")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, with the items they contain."""
    return decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.url_verdicts(spark, _read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = packing.pack_documents(docs, tokenizer_path())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.remove_repeated_bytes(docs)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.remove_repeated_passages(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    weights = html_text.fit(html_text.labelled_pages(pages, _read(spark, sf_dir, "documents").select("doc_id", "text")))
    return html_text.extract_text(pages, weights).select("page_id", "url", "text", "n_chars")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(_read(spark, sf_dir, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(vector_codes.codebooks_sha256(books)).alias("codebooks_sha256"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' ids, written to files in the shared folder and read back."""
    folder = f"{checkpoint_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(token_files.encode(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")), folder)
    back = token_files.read(spark, folder)
    return back.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {
        "op1_embedding_dedup": op1_embedding_dedup,
        "op2_ngram_join": op2_ngram_join,
        "op3_token_counts": op3_token_counts,
        "op4_quality": op4_quality,
        "op5_decontaminate": op5_decontaminate,
        "op6_url_reputation": op6_url_reputation,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_html_text": op10_html_text,
        "op11_vector_codes": op11_vector_codes,
        "op12_token_files": op12_token_files,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_url_reputation": url_reputation.verdict_sql("pages", "labels"),
    }
