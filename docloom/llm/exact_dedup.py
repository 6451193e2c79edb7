"""Operator 6: exact deduplication as a stateful stream (DataFrame functions and Structured Streaming only).

A file stream feeds digests into a keyed streaming aggregate whose state lives in RocksDB, is checkpointed to the
shared folder and never expires. Per digest the state holds the identifier that stays, the locator of its content
(file and row number in it) and the number of rows. The state table is then read as data. Every row whose digest was
seen more than once is checked byte by byte against the text found through the locator; digests under which different
texts meet are grouped again by the texts themselves.

Distribution: the shuffle carries a digest and a locator per distinct digest and task (partial aggregation), so a group
with a third of all rows is combined before it moves. Texts move only for repeated digests when the list of those is
small enough to broadcast (its bytes are counted first), else all texts move once by digest, where adaptive execution
splits hot partitions. In the byte check a group of n rows is spread over n / 256 copies of its kept text.

Defined cases: null texts count as empty; a null identifier is smaller than any other; repeated rows are rows of their
own, of which the one with the last locator stays; very long texts are digested whole; an empty table gives an empty
result; the columns of a DataFrame are written as one struct and those of a path read by name into new ones, so extra
columns cannot clash (a path with a column ``_metadata`` is written as a DataFrame is).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_struct, scratch_path, stored, text_of

#: State on disk; without files allocated ahead, as there are many small stores.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}
BROADCAST_BYTES = 16 << 20
GROUP_SLICE = 256


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _at(id_: Column) -> Column:
    return F.struct(id_.alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def fold_stream(stream: DataFrame, checkpoint: str) -> DataFrame:
    """Runs what the stream holds now into the state at ``checkpoint`` and returns the state: digest, keep, n.

    A later call with the same checkpoint reads only files that are new since.
    """
    spark = stream.sparkSession
    old = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        seen = stream.groupBy("digest").agg(F.max("at").alias("keep"), F.count(F.lit(1)).alias("n"))
        run = seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    state = spark.read.format("statestore").load(checkpoint)
    keep, n = state.schema["value"].dataType.names
    return state.select(F.col("key.digest").alias("digest"), F.col("value").getField(keep).alias("keep"), F.col("value").getField(n).alias("n"))


def exact_dedup(
    spark: SparkSession,
    source: str | DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    checkpoint: str | None = None,
    carry: list[str] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """A row per input row: doc (struct of the carried columns), digest, keep_id, group_size, kept.

    ``source`` is a Parquet path, read in place, or a DataFrame, which is first written to the shared folder: the
    stream and the locators need files.
    """
    if not isinstance(source, DataFrame) and "_metadata" in (c.lower() for c in spark.read.parquet(source).columns):
        source = spark.read.parquet(source)  # its column would hide the locators
    if isinstance(source, DataFrame):
        path = scratch_path(spark, "dedup-input")
        carried, id_, text = F.col("doc"), F.col("doc").getField(id_col), text_of(F.col("doc").getField(text_col))
        kept_out = F.struct(*[carried.getField(c).alias(c) for c in (carry or source.columns)])
        source = source.select(row_struct(source).alias("doc"))
        source.write.parquet(path)
        schema = source.schema
    else:
        path, schema = source, spark.read.parquet(source).schema
        named = lambda c: F.col("`" + c.replace("`", "``") + "`")
        id_, text, kept_out = named(id_col), text_of(named(text_col)), F.struct(*[named(c) for c in (carry or schema.names)])
    found = spark.read.schema(schema).parquet(path)
    rows = found.select(digest(text).alias("digest"), _at(id_).alias("at"), text.alias("content"))
    # As a glob the path may also be a single file; a plain stream path must be a folder.
    stream = spark.readStream.schema(schema).parquet(f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]").select(digest(text).alias("digest"), _at(id_).alias("at"))
    state = stored(fold_stream(stream, checkpoint or scratch_path(spark, "dedup-state")), "dedup-groups")

    repeated = state.filter("n > 1").withColumn("slices", F.ceil(F.col("n") / GROUP_SLICE))
    bytes_repeated = repeated.agg(F.sum(F.length("digest") + F.length("keep.file") + 64)).first()[0] or 0
    if not bytes_repeated:
        differing = None
    else:
        hits = rows.join(F.broadcast(repeated) if bytes_repeated <= broadcast_bytes else repeated, "digest")
        members = hits.filter("at != keep").withColumn("slice", F.pmod(F.xxhash64("at"), F.col("slices")))
        kept = hits.filter("at = keep").select("digest", F.col("content").alias("kept_content"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
        pairs = members.join(kept, ["digest", "slice"])
        differing = stored(pairs.filter(F.col("content").cast("binary") != F.col("kept_content").cast("binary")).select("digest").distinct(), "dedup-differing")
        if differing.isEmpty():
            differing = None

    docs = found.select(kept_out.alias("doc"), digest(text).alias("digest"), _at(id_).alias("at"), *([text.alias("content")] if differing is not None else []))
    if differing is not None:  # under these digests the texts themselves are the keys
        again = rows.join(differing, "digest", "left_semi").groupBy("digest", "content").agg(F.max("at").alias("keep"), F.count(F.lit(1)).alias("n"))
        regrouped = docs.join(again, ["digest", "content"]).drop("content")
        joined = docs.drop("content").join(state.join(differing, "digest", "left_anti"), "digest").unionByName(regrouped)
    else:
        joined = docs.join(state, "digest")
    return joined.select("doc", "digest", F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("at") == F.col("keep")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark, f"{sf_dir}/documents.parquet", carry=["doc_id"])
    return out.select("doc.doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
