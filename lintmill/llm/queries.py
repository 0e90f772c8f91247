"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lintmill.llm import decontaminate, html_text, media, mixing, ngram, quality, secrets, simhash, substrings, transcripts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), per_class=1500, dimensions=48, neighbours=25)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.format_conversations(_table(spark, sf_dir, "conversations"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score(_table(spark, sf_dir, "documents"), held_out_fold=1, order=3)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=13, agreement=0.8)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.documents_as_media(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(_table(spark, sf_dir, "documents"), threshold=0.5)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_epochs=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (op1_quality_classifier, op2_simhash_near_dedup, op3_chat_format, op4_html_extract, op5_lm_score, op6_decontaminate, op7_media_columns, op8_secret_scan, op9_mix_sources, op10_substring_dedup, pipeline)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {}
