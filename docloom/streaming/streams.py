"""Polling cycles as Structured Streaming: new files are folded into the catalogue and the sessions batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import catalog


def follow(stream: DataFrame, fold: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs ``fold`` on each batch: once over all that is there, or every so often. A failed batch is run again."""
    writer = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def catalogue_batches(spark: SparkSession, table: str) -> Callable[[DataFrame, int], None]:
    """Folds pages (document_id, html) into versions of a catalogue: ``table``/v=<batch>, so a batch that is run again writes
    the same version. A version holds the documents of its batch only, as they are after it; ``latest`` puts versions together."""
    def fold(batch: DataFrame, number: int) -> None:
        pages = batch.groupBy("document_id").agg(F.max_by("html", "at").alias("html")) if "at" in batch.columns else batch
        before = latest(spark, table, number).join(pages.select("document_id"), "document_id", "left_semi") if number else spark.createDataFrame([], catalog.COLUMNS)
        catalog.check_and_update(before, pages).drop("outcome").write.mode("overwrite").parquet(f"{table}/v={number}")

    return fold


def latest(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """Every document as its newest version (of those before a number) has it."""
    rows = spark.read.option("basePath", table).parquet(table).withColumnRenamed("v", "version")
    rows = rows if before is None else rows.filter(F.col("version") < before)
    columns = [c for c in rows.columns if c not in ("document_id", "version")]
    newest = rows.groupBy("document_id").agg(F.max_by(F.struct(*columns), "version").alias("x"))
    return newest.select("document_id", "x.*")


def index_cycle(spark: SparkSession, table: str, index: Callable[[DataFrame], DataFrame], number: int) -> None:
    """One cycle of indexing: ``index`` gets all that waits, failed documents of earlier cycles among it, and gives back
    document_id, chunk_count, error; the outcome is version ``number``."""
    now = latest(spark, table, number)
    waiting = now.join(catalog.pending(now), "document_id", "left_semi")
    done = index(waiting.select("document_id"))
    catalog.mark(waiting, done).write.mode("overwrite").parquet(f"{table}/v={number}")


def session_totals(events: DataFrame, user: str = "user_id", at: str = "ts") -> DataFrame:
    """A running rollup of a stream of events (use output mode complete or update)."""
    return events.groupBy(user).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"), F.count(F.lit(1)).alias("message_count"))
