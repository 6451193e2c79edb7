"""What the training-data operators share: table access, word counts and shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed by the query contracts: a word is a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Most bytes of text that a sample for training brings to the driver.
SAMPLE_BYTES = 128 << 20

_own_scratch: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_struct(df: DataFrame, carry: list[str] | None = None) -> Column:
    """The carried columns (all by default) as one struct, so that no name clashes; names may hold dots or backticks."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in (carry or df.columns)]
    return F.struct(*[F.col(c) for c in quoted])


def text_of(col: Column) -> Column:
    """Null texts count as empty ones."""
    return F.coalesce(col, F.lit(""))


def n_words(col: Column) -> Column:
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def held_out(id_col: Column) -> Column:
    """The fold that no model may learn from: crc32 of the identifier's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def bounded_sample(rows: DataFrame, label_col: str, key: Column, bound: int) -> DataFrame:
    """About ``bound`` rows of each label, or all where there are fewer: those whose key has a small hash.

    The choice depends on the rows alone. Labels are classes of a model, so their counts are few.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label_col).count().collect() if r[0] is not None}
    if not counts:
        return rows.limit(0)
    share = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, min(1.0, bound / n))])
    return rows.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < F.try_element_at(share, F.col(label_col)) * (1 << 30))


def one_text_each(sample: DataFrame, label_col: str, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, object]]:
    """(text, label) of a bounded sample with columns id, text and the label, in the order of identifiers.

    Rows that repeat an identifier with a label count once, with their smallest text, so a repeated or missing
    identifier adds one row however many rows have it. Texts beyond ``most_bytes`` in the order of a hash are left out.
    """
    once = sample.groupBy("id", label_col).agg(F.min("text").alias("text"))
    by_hash = Window.orderBy(F.xxhash64("id", F.lit("order")), "id", label_col)  # over the sample only
    within = once.withColumn("so_far", F.sum(F.octet_length("text").cast("long")).over(by_hash)).filter(F.col("so_far") <= most_bytes)
    found = within.orderBy("id", "text").select("text", label_col).toArrow()
    return list(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """Texts and labels for training: bounded in number by ``bound`` per label, never from the held-out fold.

    Of several labels of a document the largest counts. The sample of labels is drawn first, so the texts are found by
    a broadcast of at most a few thousand identifiers.
    """
    one = labels.select(labels[id_col].alias("id"), labels[label].cast("int").alias("y")).dropna().filter(~held_out(F.col("id")))
    one = one.groupBy("id").agg(F.max("y").alias("y"))
    chosen = bounded_sample(one, "y", F.col("id"), bound)
    texts = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text")).join(F.broadcast(chosen), "id")
    return one_text_each(texts, "y")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where that is unset, a temporary one, in local mode only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own_scratch:
            _own_scratch.append(tempfile.mkdtemp(prefix="docloom-"))
        shared = f"file://{_own_scratch[0]}"
        spark.sparkContext.setCheckpointDir(shared)
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{scratch_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder and reads it back, so a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
