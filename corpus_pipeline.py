"""The corpus pipeline: five stages, each written as Parquet and read again as the input of the next.

Each stage calls one operator of ``docloom.llm`` on all that the stage before kept; all but the last return the columns
of the documents. Null and empty texts, repeated rows, empty tables and extra columns are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import quality
from docloom.llm.common import stored, table
from docloom.llm.decontaminate import decontaminate
from docloom.llm.exact_dedup import exact_dedup
from docloom.llm.jaccard_join import jaccard_components
from docloom.llm.mix import emitted, mix

#: Near duplicates: word shingles of five, similarity of 0.8 and more.
NGRAM, PERCENT = 5, 80


def good_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below one half go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter("score >= 0.5").select("doc.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest identifier stays."""
    return exact_dedup(spark, docs).filter("kept").select("doc.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near duplicates the document with the smallest identifier stays."""
    return jaccard_components(docs, ngram=NGRAM, percent=PERCENT).filter("kept").select("doc.*")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("NOT contaminated").select("doc.*")


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return emitted(mix(docs))


STAGES = [
    ("quality classifier", good_lines),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", target_weights),
]

#: SQL can express neither the training of the quality classifier nor reachability in the Jaccard join at this size; the
#: stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
