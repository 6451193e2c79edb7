"""Operator 9: mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source is expected ``f = target / source_size`` times. Within a source the documents stand in a
fixed order, their expected copies are prefix-summed, one random offset ``u`` is added, and a document is emitted once
for each integer boundary that its interval ``(u + f * (rank - 1), u + f * rank]`` crosses. The order is by size class,
hash bucket and size, so the words taken stay within about one long document of the target.

Distribution: ranks need no window over a whole source. Documents fall into cells (source, size class, hash bucket);
cell counts are aggregated map-side first, prefix-summed in two short levels, and a document's rank is its cell's start
plus its row number in the cell. A source, or one size, with a third of all rows still spreads over ``buckets`` cells.
Only the table of sources (a row per source) is sorted in one task.

Defined cases: a null text has size 0; a null source is a source of its own and stands last; a null identifier is
ordered by the hash of its text; very long texts are counted whole, by words; repeated rows are separate documents; an empty table gives an empty result; sources
without words have target 0 and take nothing. Columns of the input are carried as one struct, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, row_struct, table, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
BUCKETS = 1024
SEED = "docloom-mix"


def _unit(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the md5 of a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Targets by water-filling; ``sources`` has skey and source_size, a row per source.

    Uncapped targets are ``level * weight``; the level is the largest of those left when the sources with the
    smallest caps per weight are filled one by one, which is the fixpoint of resharing the excess by weight.
    """
    by_key = Window.orderBy("skey")
    by_ratio = Window.orderBy("ratio", "skey")
    everything = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_key) - 1) % len(weights) + 1).cast("int"))
    x = sources.withColumn("weight", w.cast("double")).withColumn("top", F.col("source_size") * F.lit(cap))
    x = x.withColumn("ratio", F.col("top") / F.col("weight"))
    left = F.lit(share) * F.sum("source_size").over(everything) - (F.sum("top").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("top"))
    x = x.withColumn("level", left / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    x = x.withColumn("target", F.least("top", F.col("weight") * F.max("level").over(everything)))
    return x.select("skey", "source_size", "target")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    buckets: int = BUCKETS,
    seed: str = SEED,
    carry: list[str] | None = None,
) -> DataFrame:
    """A row per document: doc (struct of the carried columns), size, source_size, target, copies (long)."""
    text, key = docs[text_col], docs[id_col].cast("string")
    rows = docs.select(
        row_struct(docs, carry).alias("doc"),
        F.coalesce(F.concat(F.lit("s"), docs[source_col]), F.lit("t")).alias("skey"),
        n_words(text).alias("size"),
        F.substring(F.md5(F.concat(F.coalesce(key, F.lit("")), F.lit("|"), text_of(text)).cast("binary")), 1, 16).alias("mark"),
    )
    # A size class keeps the five leading bits of the size.
    rows = rows.withColumn("exp", F.greatest(F.length(F.bin("size")) - 5, F.lit(0))).withColumn("cls", F.expr("exp * 16L + shiftright(size, exp)"))
    rows = rows.withColumn("cell", F.conv(F.substring("mark", 1, 7), 16, 10).cast("long") % buckets).drop("exp")

    cells = rows.groupBy("skey", "cls", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    classes = cells.groupBy("skey", "cls").agg(F.sum("n").alias("n_cls"), F.sum("words").alias("words_cls"))
    per_source = targets(classes.groupBy("skey").agg(F.sum("words_cls").alias("source_size")), weights, share, cap)
    classes = classes.withColumn("cls_start", F.sum("n_cls").over(Window.partitionBy("skey").orderBy("cls")) - F.col("n_cls"))
    starts = cells.withColumn("start", F.sum("n").over(Window.partitionBy("skey", "cls").orderBy("cell")) - F.col("n"))
    starts = starts.join(classes, ["skey", "cls"]).join(per_source, "skey")
    starts = starts.select(
        "skey",
        "cls",
        "cell",
        "source_size",
        "target",
        (F.col("cls_start") + F.col("start")).alias("before"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("f"),
        _unit(F.concat(F.lit(f"{seed}|"), F.col("skey"))).alias("u"),
    )
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("skey", "cls", "cell").orderBy("size", "mark")))
    joined = ranked.join(starts, ["skey", "cls", "cell"]).withColumn("rank", F.col("before") + F.col("rank"))
    copies = F.floor(F.col("u") + F.col("f") * F.col("rank")) - F.floor(F.col("u") + F.col("f") * (F.col("rank") - 1))
    return joined.select("doc", "size", "source_size", "target", copies.cast("long").alias("copies"))


def emitted(mixed: DataFrame) -> DataFrame:
    """The mix itself: the carried columns, once for each copy."""
    return mixed.filter(F.col("copies") > 0).select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH docs AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 't' ELSE 's' || source END AS skey,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 16) AS mark
  FROM documents),
celled AS (
  SELECT *, greatest(length(bin(size)) - 5, 0) * 16 + (size >> CAST(greatest(length(bin(size)) - 5, 0) AS BIGINT)) AS cls,
    CAST('0x' || substr(mark, 1, 7) AS BIGINT) % 1024 AS cell FROM docs),
keyed AS (
  SELECT skey, CAST(sum(size) AS DOUBLE) AS source_size, CAST(CASE (row_number() OVER (ORDER BY skey) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight
  FROM celled GROUP BY skey),
topped AS (SELECT *, source_size * 2.0::DOUBLE AS top, source_size * 2.0::DOUBLE / weight AS ratio FROM keyed),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(top) OVER (ORDER BY ratio, skey ROWS UNBOUNDED PRECEDING) - top))
    / sum(weight) OVER (ORDER BY ratio, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM topped),
aimed AS (
  SELECT skey, source_size, least(top, weight * max(level) OVER ()) AS target,
    CAST('0x' || substr(md5('docloom-mix|' || skey), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM levels),
ranked AS (
  SELECT c.*, a.source_size, a.target, a.u, CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0.0::DOUBLE END AS f,
    row_number() OVER (PARTITION BY c.skey ORDER BY cls, cell, size, mark) AS rank
  FROM celled c JOIN aimed a USING (skey))
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(floor(u + f * rank) - floor(u + f * (rank - 1)) AS BIGINT) * size AS taken
FROM ranked
"""
