"""Linting documents as they change: a stream of (uri, version, ts, text, closed).

A change is linted once its document has been quiet for the debounce time: changes of one document that follow
each other closely fall into one session window, and its highest version is taken. A newer version's result replaces an older
one's; a closed document gives a row without text, so that its diagnostics can be cleared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(changes: DataFrame, debounce: str = "150 milliseconds", lateness: str = "10 seconds") -> DataFrame:
    """(uri, version, text, closed, settled_at): the last version of each burst, on a stream or a batch."""
    timed = changes.withColumn("ts", F.col("ts").cast("timestamp"))
    if changes.isStreaming:
        timed = timed.withWatermark("ts", lateness)
    burst = timed.groupBy("uri", F.session_window("ts", debounce).alias("w")).agg(F.max_by(F.struct("version", "text", "closed"), F.struct("version", "ts")).alias("last"))
    return burst.select("uri", "last.version", "last.text", "last.closed", F.col("w.end").alias("settled_at"))


def latest(changes: DataFrame) -> DataFrame:
    """The newest version of each document that is not closed."""
    newest = changes.groupBy("uri").agg(F.max_by(F.struct("version", "text", "closed"), F.struct("version", "ts")).alias("last"))
    return newest.select("uri", "last.version", "last.text", "last.closed").where("not closed")


def lint_batch(changes: DataFrame, config: dict | None = None) -> DataFrame:
    """Diagnostics of the newest open versions, with ``version``."""
    from lintmill.operators.lint import lint
    from lintmill.sources.files import language_of

    now = latest(changes)
    files = now.select(F.col("uri").alias("path"), F.coalesce(language_of(F.col("uri")), F.lit("js")).alias("language"), F.col("text").alias("source"))
    return lint(files, config).join(now.select(F.col("uri").alias("path"), "version"), "path")


def start(changes: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str, config: dict | None = None, debounce: str = "150 milliseconds", **trigger):
    """Lints settled documents of a stream and hands each batch to ``publish(diagnostics, batch id)``.

    Within a batch the newest version of a document counts; rows of closed documents have a null rule.
    """
    from lintmill.operators.lint import lint
    from lintmill.sources.files import language_of

    def each(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("uri").agg(F.max_by(F.struct("version", "text", "closed"), "version").alias("last")).select("uri", "last.*").persist()
        files = newest.where("not closed").select(F.col("uri").alias("path"), F.coalesce(language_of(F.col("uri")), F.lit("js")).alias("language"), F.col("text").alias("source"))
        found = newest.select(F.col("uri").alias("path"), "version", "closed").join(lint(files, config), "path", "left")
        publish(found, batch_id)
        newest.unpersist()

    writer = settled(changes, debounce).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(**trigger) if trigger else writer).start()
