"""The document catalogue: change detection by content hash, states, chunk upserts, statistics. All native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as nz

PENDING = ("new", "updated", "failed")
COLUMNS = "document_id string, content_hash string, status string, scraped_at timestamp, indexed_at timestamp, chunk_count int, last_error string"


def migrated(catalog: DataFrame) -> DataFrame:
    """A catalogue of an older form, with the columns it lacks."""
    empty = catalog.sparkSession.createDataFrame([], COLUMNS)
    return empty.unionByName(catalog, allowMissingColumns=True)


def check_and_update(catalog: DataFrame, pages: DataFrame, now: Column | None = None) -> DataFrame:
    """The catalogue after pages (document_id, html): unknown ones are new, changed ones updated with their indexing
    reset, the same ones stay as they are. ``outcome`` says which (null: not among the pages)."""
    now = F.current_timestamp() if now is None else now
    fresh = pages.select("document_id", nz.content_hash("html").alias("new_hash"))
    both = migrated(catalog).join(fresh, "document_id", "full_outer")
    outcome = F.when(F.col("new_hash").isNull(), None).when(F.col("content_hash").isNull(), "new").when(F.col("content_hash") != F.col("new_hash"), "updated").otherwise("unchanged")
    both = both.withColumn("outcome", outcome)
    changed = F.col("outcome").isin("new", "updated")

    def kept(name: str, value: Column) -> Column:
        return F.when(changed, value).otherwise(F.col(name)).alias(name)

    return both.select(
        "document_id",
        kept("content_hash", F.col("new_hash")),
        kept("status", F.col("outcome")),
        kept("scraped_at", now),
        kept("indexed_at", F.lit(None).cast("timestamp")),
        kept("chunk_count", F.lit(None).cast("int")),
        kept("last_error", F.lit(None).cast("string")),
        "outcome",
    )


def pending(catalog: DataFrame, include_all: bool = False) -> DataFrame:
    found = catalog if include_all else catalog.filter(F.col("indexed_at").isNull() | F.col("status").isin(*PENDING))
    return found.select("document_id").orderBy("document_id")


def mark(catalog: DataFrame, results: DataFrame, now: Column | None = None) -> DataFrame:
    """results: document_id, chunk_count, error. Indexed ones get their time and count, failed ones their error."""
    now = F.current_timestamp() if now is None else now
    both = catalog.join(results.select("document_id", F.col("chunk_count").alias("n"), "error"), "document_id", "left")
    ok, failed = F.col("n").isNotNull() & F.col("error").isNull(), F.col("error").isNotNull()
    return both.select(
        "document_id",
        "content_hash",
        F.when(ok, "indexed").when(failed, "failed").otherwise(F.col("status")).alias("status"),
        "scraped_at",
        F.when(ok, now).otherwise(F.col("indexed_at")).alias("indexed_at"),
        F.when(ok, F.col("n")).otherwise(F.col("chunk_count")).alias("chunk_count"),
        F.when(ok, None).when(failed, F.left("error", F.lit(1000))).otherwise(F.col("last_error")).alias("last_error"),
    )


def stats(catalog: DataFrame) -> DataFrame:
    waits = F.col("indexed_at").isNull() | F.col("status").isin(*PENDING)
    return catalog.agg(F.count(F.lit(1)).alias("total"), F.count("indexed_at").alias("indexed"), F.count_if(waits).alias("pending"), F.coalesce(F.sum("chunk_count"), F.lit(0)).cast("long").alias("chunks"))


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks by identifier: new ones replace those with theirs."""
    return old.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new, allowMissingColumns=True)


def replace_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of a document go when it has new ones; a document whose new parse is empty keeps its old chunks."""
    return old.join(new.select("document_id").distinct(), "document_id", "left_anti").unionByName(new, allowMissingColumns=True)


def cycle_counts(outcomes: DataFrame, by: str = "outcome") -> DataFrame:
    return outcomes.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
