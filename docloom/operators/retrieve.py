"""Vector search, context assembly and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize as nz
from .nearest import nearest

THRESHOLD, CONTEXT_CHARS, HISTORY_TURNS = 0.80, 18_000, 3
BROADCAST_BYTES = 64 << 20
#: Kind of a request to its least and most characters and its most items.
REQUESTS = {"question": (3, 2000, 20), "query": (2, 2000, 50)}


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def top_k(queries: DataFrame, corpus: DataFrame, *, k: int = 8, section: Column | None = None, threshold: float | None = None, query_id: str = "query_id", item_id: str = "item_id", vector: str = "vector") -> DataFrame:
    """The k most similar items of every query: query_id, item_id, score, rank; ties by item.

    Queries are a stated set in blocks against all items: each block's counted bytes are broadcast to the partitions of
    items, which keep their own k best of a query (``nearest``), so the shuffle carries k rows a query and partition. A
    vector without length has a null score and ranks last.
    """
    if not 1 <= k <= 50:
        raise ValueError("top_k is 1 to 50")
    items = corpus.filter(section) if section is not None else corpus
    items = items.select(F.col(item_id).alias("item_id"), F.col(vector).cast("array<double>").alias("item_vector"))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("query_vector"))
    columns = T.StructType([q.schema["query_id"], items.schema["item_id"], T.StructField("score", T.DoubleType()), T.StructField("key", T.DoubleType())])
    n, width = q.agg(F.count(F.lit(1)), F.max(F.size("query_vector"))).first()
    per_block = max(1, BROADCAST_BYTES // (max(width or 1, 1) * 8 + 64))
    blocks = -(-n // per_block) or 1
    found = None
    for block in range(blocks):
        part = q if blocks == 1 else q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        scored = items.mapInArrow(nearest(q.sparkSession.sparkContext.broadcast(part.toArrow()), k, threshold), columns)
        found = scored if found is None else found.unionByName(scored)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("key"), "item_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("key")


def holders(texts: DataFrame, needles: DataFrame, *, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """item_id, needle against texts (hay) -> item_id and the number of texts that contain the needle.

    The needles are a stated set, broadcast in blocks of counted bytes; the texts are scanned once a block, stay where
    they are, and are counted before the shuffle.
    """
    size = needles.agg(F.sum(F.octet_length("needle") + 64)).first()[0] or 0
    blocks = size // block_bytes + 1
    found = None
    for block in range(blocks):
        part = needles if blocks == 1 else needles.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        hits = texts.join(F.broadcast(part), F.contains("hay", "needle")).groupBy("item_id").agg(F.count(F.lit(1)).alias("holders"))
        found = hits if found is None else found.unionByName(hits)
    return needles.select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("holders", F.lit(0)).alias("holders"))


def request_error(kind: str, text, top_k=None) -> Column:
    """Why a request is refused, null if it is not: ``question`` and ``query`` have 3 and 2 to 2000 characters and ask for
    at most 20 and 50 items."""
    least, most, items = REQUESTS[kind]
    n = F.length(nz.col(text))
    wrong = F.when(n.isNull() | ~n.between(least, most), F.lit(f"{kind} has {least} to {most} characters"))
    return wrong if top_k is None else wrong.when(~nz.col(top_k).between(1, items), F.lit(f"top_k is 1 to {items}"))


def budgeted_context(chunks: DataFrame, *, by: str = "query_id", budget: int = CONTEXT_CHARS) -> DataFrame:
    """Best chunks first (by rank), equal texts once, up to the first that would pass the budget."""
    once = chunks.withColumn("copy", F.row_number().over(Window.partitionBy(by, "text").orderBy("rank"))).filter("copy = 1").drop("copy")
    so_far = F.sum(F.length("text")).over(Window.partitionBy(by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return once.withColumn("used", so_far).filter(F.col("used") <= budget)


def unique_sources(hits: DataFrame, by: str = "query_id") -> DataFrame:
    """The best-ranked chunk of each document, article and element."""
    best = Window.partitionBy(by, "document_id", "band_number", "element_id").orderBy("rank")
    return hits.withColumn("copy", F.row_number().over(best)).filter("copy = 1").drop("copy")


def prompt_messages(question: Column, context: Column, turns: Column, system: str, fold_system: bool = False) -> Column:
    """Messages for a model: system, the last turns with both sides, then context and question."""
    both = F.filter(turns, lambda t: ~nz.is_blank(t["question"]) & ~nz.is_blank(t["answer"]))
    last = F.slice(both, F.greatest(F.size(both) - (HISTORY_TURNS - 1), F.lit(1)), HISTORY_TURNS)

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    said = F.flatten(F.transform(last, lambda t: F.array(message("user", t["question"]), message("assistant", t["answer"]))))
    asked = F.concat(F.lit("[KONTEKST]\n"), context, F.lit("\n\n[SAVOL]\n"), question)
    if fold_system:
        return F.concat(said, F.array(message("user", F.concat(F.lit(f"{system}\n\n"), asked))))
    return F.concat(F.array(message("system", F.lit(system))), said, F.array(message("user", asked)))


def with_prefix(text: Column, kind: str = "passage") -> Column:
    return F.concat(F.lit(f"{kind}: "), text)


def token_budget(prompt: Column, most: int = 8192, window: int = 20480) -> Column:
    """Output tokens that a prompt leaves: at least 1024."""
    return F.greatest(F.lit(1024), F.least(F.lit(most), F.lit(window) - (F.floor(F.length(prompt) / 2) + 500))).cast("int")
