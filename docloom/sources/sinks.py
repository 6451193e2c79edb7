"""Sinks: results as JSON or text, chunk collections as partitioned Parquet, session tables by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_markdown(df: DataFrame, path: str, column: str = "markdown") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def ensure_collection(spark, path: str, dimension: int) -> None:
    """An existing collection must hold vectors of this size."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        sizes = [r[0] for r in spark.read.parquet(path).select(F.size("vector").alias("n")).distinct().limit(2).collect()]
        if sizes and sizes != [dimension]:
            raise ValueError(f"the collection holds vectors of {sizes}, not of {dimension}")


def write_collection(old: DataFrame | None, new: DataFrame, path: str) -> None:
    """The collection after new chunks replaced those of their documents; written beside the old one, by section."""
    merged = new if old is None else catalog.replace_documents(old, new)
    merged.write.mode("errorifexists").partitionBy("section_type").parquet(path)


def write_sessions(sessions: DataFrame, path: str) -> None:
    sessions.write.mode("overwrite").parquet(path)
