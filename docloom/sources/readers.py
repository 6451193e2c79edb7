"""Sources. Rendering, recognition, fetching and models stay outside: they are functions that the caller passes in."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import normalize as nz


def binary_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def mapped(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """An outside step (a renderer, a recogniser, a model, a fetcher) over batches; one call for each batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)


def recognised_blocks(raw: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Recognised blocks in reading order within the page, with our names for their kinds (unknown ones are text); without
    errors, skipped ones, pictures and blank pages."""
    kinds = F.create_map(*[F.lit(x) for kv in (labels or fixed.BLOCK_KINDS).items() for x in kv])
    kept = raw.filter(~F.coalesce("skipped", F.lit(False)) & ~F.coalesce("error", F.lit(False)) & ~F.coalesce("label", F.lit("")).isin(fixed.SKIPPED_BLOCKS))
    place = F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("reading_order")) - 1
    return kept.withColumns({"kind": F.coalesce(F.try_element_at(kinds, F.col("label")), F.lit("text")), "pos": place})


def contract_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of the outside interface, a file each, as VARIANT: the key ``contract`` or the whole."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "^﻿", "").alias("value"))
    parsed = raw.withColumn("v", F.try_parse_json("value"))
    return parsed.select("file", F.coalesce(F.try_variant_get("v", "$.contract", "variant"), "v").alias("contract"))


def request_body(contract_id, template: str | None = None, id_field: str = "id"):
    """The body of a request: a template with {{id}}, else an object with the identifier."""
    quoted = F.to_json(F.struct(nz.col(contract_id).cast("string").alias("v")))
    escaped = F.regexp_extract(quoted, '^\\{"v":"(.*)"\\}$', 1)
    if template and "{{id}}" in template:
        return F.replace(F.lit(template), F.lit("{{id}}"), escaped)
    fields = json.loads(template) if template else {}
    return F.to_json(F.struct(*[F.lit(json.dumps(v) if isinstance(v, (dict, list)) else v).alias(k) for k, v in fields.items()], nz.col(contract_id).cast("string").alias(id_field)))


def response_error(status, body):
    """Why a response is no contract, or null."""
    v = F.try_parse_json(nz.col(body))
    has = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "variant") for k in ("contract", "idn", "docNo")]).isNotNull()
    s = nz.col(status)
    return F.when(s.isin(401, 403), "not authorised").when(s >= 400, F.concat(F.lit("status "), s.cast("string"))).when(v.isNull(), "not JSON").when(~has, "no contract")


def valid_page(html):
    return F.coalesce(F.contains(nz.col(html), F.lit('id="divCont"')), F.lit(False))


def document_list(spark: SparkSession, path: str) -> DataFrame:
    """Identifiers of a list, once each, in order of first appearance."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    found = lines.select(nz.document_id("value").alias("document_id"), "at").filter("document_id IS NOT NULL")
    return found.groupBy("document_id").agg(F.min("at").alias("at")).orderBy("at").select("document_id")


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages, a file for each document."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(-?\d+)\.html$", 1).alias("document_id"), F.col("value").alias("html"))


def numbered_pairs(extracted: DataFrame, api: DataFrame, key: str = "contract_id") -> DataFrame:
    return extracted.join(api, key)


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
