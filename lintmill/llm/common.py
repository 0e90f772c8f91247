"""Shared helpers: Arrow column access, durable lineage cuts, word rules."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than space and 0x09-0x0D; ``bytes.split()`` has that rule.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: crc32 remainder of ``doc_id`` that is held out by the operators that learn.
FOLDS = 5


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder. Without one there is no place that all executors see, so that is an error; only a
    local session, where driver and executors are one process, falls back to its warehouse folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master.startswith("local"):
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and go on from the files.

    Unlike a checkpoint's rows these are packed, columns that nobody reads are not read again, and lost executors take nothing with them.
    """
    path = shared_path(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo ``FOLDS``; null ids are in fold 0 of the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Words after lower-casing A-Z; ``bytes.lower`` changes ASCII letters only."""
    return text.lower().split()


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with batches small enough for a Python worker's memory."""
    return df.mapInArrow(fn, schema)


def pieces(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """Slices of a batch that hold about ``limit`` bytes of ``column`` (a single longer row stays whole)."""
    array = batch.column(column)
    sizes = np.array([0 if x is None else x for x in pc.binary_length(array).to_pylist()], dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)
