"""The corpus pipeline: five stages over ``documents``, each written and read again before the next.

1. quality: documents that score under 0.3 go.
2. near_dedup: texts that share 0.8 of their five-word shingles are linked (candidates by Golay keys of SimHash fingerprints); of each
   group the document with the smallest id stays.
3. decontaminate: documents that overlap a benchmark item go.
4. secrets: secrets in the text are masked; no document goes.
5. mix: sources are brought to their target weights; the last stage adds ``copy``, the running number
   of a document's repetition.

Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lintmill.llm import decontaminate, mixing, near_texts, quality, secrets
from lintmill.llm.common import shared_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_texts.keep_representatives(docs, shingle=5, similarity=0.8, radius=9)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, threshold=0.5)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(docs, weights=(3, 1, 2), share=1.5, max_epochs=2.0)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("mix", mix_stage),
]

#: A trained classifier and fuzzy hashing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; what lies between is in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
