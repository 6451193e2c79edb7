"""Operator 10: benchmark decontamination by spaced-seed hashing (DataFrame functions only).

Texts become lower-case alphanumeric tokens. Each fixed mask reads some of the ``SPAN`` tokens from a position on and
ignores the others, so a substituted token at an ignored place does not change the hash. Hashes of documents and of
benchmark items are joined; each hit fixes an alignment (document position minus item position), and the alignment is
verified: some ``WINDOW`` aligned tokens must hold at least ``NEEDED`` equal ones. The masks read each pair of the four
blocks of tokens 0-2, 3-5, 7-9 and 10-12. Two substitutions touch two blocks at most, so every window that passes the
verification is found. Items of fewer than ``SPAN`` tokens are joined whole: documents also have a hash of every run of
each such length that occurs, and all tokens of the item must be equal.

Distribution: the search reads documents once and shuffles no text. Seeds of the benchmark are broadcast when their counted
bytes are within ``BROADCAST_BYTES``; otherwise the same join runs as a shuffled one. Items with equal tokens are
searched once. Hits are collapsed to distinct alignments, with partial aggregation, before they are verified, so a
passage that a third of all documents share costs one row per document. Texts of documents with hits are then read
again for the verification; the list of those is broadcast only when it is small.

Defined cases: null texts and texts without a token match nothing; an item of fewer than ``SPAN`` tokens matches the
documents that hold it whole, however short they are; very long texts are read whole; repeated rows each get the result
of their text; ties between items go to the smallest item_id, which may be of any ordered type, a null one last; empty
tables give no matches. Extra columns are carried in a struct and cannot clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_struct, stored, table, text_of

#: Every mask spans 13 tokens; 1 is a token that is read.
MASKS = ("1111110000000", "0000000111111", "1110000000111", "0001110111000", "1110000111000", "0001110000111")
SPAN = 13
WINDOW = 13
NEEDED = 11
BROADCAST_BYTES = 64 << 20
#: Characters of scripts that put no spaces between words (Thai, Lao, Tibetan, Burmese, Khmer and their neighbours, kana,
#: Han, Yi); each is a token.
UNSEGMENTED = r"[\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u1950-\u19FF\u1A20-\u1AAF\u1B00-\u1B7F\u2E80-\u2FDF\u3005-\u3007\u3040-\u312F\u31A0-\u31BF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uA000-\uA4CF\uA980-\uA9FF\uAA60-\uAADF\uF900-\uFAFF\uFF66-\uFF9F\x{1AFF0}-\x{1B16F}\x{20000}-\x{3FFFF}]"


def tokens(text: Column) -> Column:
    """Lower-case runs without ASCII white space, controls or punctuation, and single characters of unsegmented scripts."""
    spaced = F.regexp_replace(F.lower(text_of(text)), f"({UNSEGMENTED})", " $1 ")
    return F.array_remove(F.split(spaced, r"[\x00-/:-@\[-`{-\x7F]+"), "")


def _blocks(mask: str) -> list[tuple[int, int]]:
    """Start and length of each run of tokens that a mask reads."""
    return [(m.start(), len(m[0])) for m in re.finditer("1+", mask)]


def _whole(words: str, at: str, n: Column) -> Column:
    """The hash of all of ``n`` tokens from a position on."""
    return F.xxhash64(F.lit("whole"), F.slice(words, F.col(at) + 1, n))


def _seeds(words: str, at: str, lengths: list[int]) -> Column:
    """One hash for each mask and each length of a run at a position counted from 0, null where it does not fit; ``words`` names an array of token hashes."""
    left = F.size(words) - F.col(at)
    each = [F.when(left >= SPAN, F.xxhash64(F.lit(k), *[F.slice(words, F.col(at) + (i + 1), n) for i, n in _blocks(mask)])) for k, mask in enumerate(MASKS)]
    return F.array(*each, *[F.when(left >= n, _whole(words, at, F.lit(n))) for n in lengths])


def _positions(words: str, span: int = SPAN) -> Column:
    """All positions from which ``span`` tokens fit."""
    n = F.size(words) - span
    return F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def best_window(doc_words: Column, item_words: Column, diagonal: Column) -> Column:
    """Most equal tokens in any WINDOW tokens, or all of a shorter item, of an alignment (item token i beside document token i + diagonal)."""
    window = F.least(F.size(item_words), F.lit(WINDOW))
    first, last = F.greatest(-diagonal, F.lit(0)), F.least(F.size(item_words), F.size(doc_words) - diagonal)
    same = F.transform(F.sequence(first, last - 1), lambda i: (F.get(doc_words, i + diagonal) == F.get(item_words, i)).cast("int"))
    sums = F.transform(F.sequence(F.lit(1), last - first - window + 1), lambda k: F.aggregate(F.slice(same, k, window), F.lit(0), lambda a, x: a + x))
    return F.when(last - first >= window, F.array_max(sums)).otherwise(0)


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    tokens_of = tokens(benchmark[item_text_col])
    return benchmark.select(benchmark[item_col].alias("item_id"), tokens_of.alias("item_tokens")).withColumn("item_key", F.xxhash64("item_tokens"))


def matches(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", key: Column, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Verified matches: doc_key, item_id, equal (tokens of the best window); a row per document and item, also of items with equal tokens."""
    found = distinct_matches(docs, benchmark, text_col=text_col, item_col=item_col, item_text_col=item_text_col, key=key, broadcast_bytes=broadcast_bytes)
    members = _items(benchmark, item_col, item_text_col).select("item_key", "item_id").distinct()
    return found.drop("item_id").join(members, "item_key").groupBy("doc_key", "item_id").agg(F.max("equal").alias("equal"))


def distinct_matches(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", key: Column, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Verified matches: doc_key, item_key, item_id (the smallest), equal; a row per document and class of items with equal tokens."""
    items = _items(benchmark, item_col, item_text_col)
    same = stored(items.groupBy("item_key", "item_tokens").agg(F.min("item_id").alias("item_id")), "benchmark")
    words = same.filter(F.size("item_tokens") > 0).select("item_key", _hashed(F.col("item_tokens")).alias("item_words"), (F.size("item_tokens") < SPAN).alias("short"))
    lengths = sorted(r[0] for r in words.filter("short").select(F.size("item_words")).distinct().collect())  # fewer than SPAN numbers
    masked = words.filter("NOT short").withColumn("item_at", F.explode(_positions("item_words")))
    masked = masked.select("item_key", "short", "item_at", F.explode(_seeds("item_words", "item_at", [])).alias("seed"))
    whole = words.filter("short").withColumn("item_at", F.lit(0))
    whole = whole.select("item_key", "short", "item_at", _whole("item_words", "item_at", F.size("item_words")).alias("seed"))
    seeds = stored(masked.unionByName(whole), "benchmark-seeds")
    n_bytes = seeds.count() * 64

    texts = docs.select(key.alias("doc_key"), _hashed(tokens(docs[text_col])).alias("words"))
    spots = texts.select("doc_key", "words", F.explode(_positions("words", min([SPAN, *lengths]))).alias("at"))
    hits = spots.select("doc_key", "at", F.explode(_seeds("words", "at", lengths)).alias("seed")).join(F.broadcast(seeds) if n_bytes <= broadcast_bytes else seeds, "seed")
    # All tokens of a short item are in its hash, so its first place in a document stands for the others.
    diagonal = F.col("at") - F.col("item_at")
    places = hits.groupBy("doc_key", "item_key", F.when(~F.col("short"), diagonal).alias("place")).agg(F.min(diagonal).alias("diagonal"))
    aligned = stored(places.drop("place"), "alignments")

    # The texts of the hits: only these are split again.
    few = (aligned.agg(F.count(F.lit(1)) * 64).first()[0] or 0) <= broadcast_bytes
    hit_docs = aligned.select("doc_key").distinct()
    hit_texts = docs.select(key.alias("doc_key"), text_of(docs[text_col]).alias("content"))
    hit_texts = hit_texts.join(F.broadcast(hit_docs) if few else hit_docs, "doc_key", "left_semi").dropDuplicates(["doc_key"])
    pairs = aligned.join(hit_texts.select("doc_key", _hashed(tokens(F.col("content"))).alias("words")), "doc_key").join(words, "item_key")
    enough = F.when(F.col("short"), F.size("item_words")).otherwise(NEEDED)
    scored = pairs.select("doc_key", "item_key", best_window(F.col("words"), F.col("item_words"), F.col("diagonal")).alias("equal"), enough.alias("enough"))
    verified = scored.filter("equal >= enough").groupBy("doc_key", "item_key").agg(F.max("equal").alias("equal"))
    return verified.join(same.select("item_key", "item_id"), "item_key").select("doc_key", "item_key", "item_id", "equal")


def _key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """Rows with the same identifier and text have the same result."""
    text = text_of(docs[text_col])
    return F.struct(docs[id_col].alias("id"), F.xxhash64(text).alias("h"), F.length(text).alias("n"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row per document: doc (struct of the carried columns), contaminated, n_items, item_id and equal of the best match.

    As in the SQL, items with equal tokens count as one in ``n_items``, under their smallest item_id; ``matches`` has them all.
    """
    key = _key(docs, id_col, text_col)
    found = distinct_matches(docs, benchmark, text_col=text_col, key=key, broadcast_bytes=broadcast_bytes)
    per_doc = stored(found.groupBy("doc_key").agg(F.count(F.lit(1)).alias("items"), F.max("equal").alias("equal"), F.min_by("item_id", F.struct(-F.col("equal"), F.col("item_id").isNull(), F.col("item_id"))).alias("item_id")), "leaks")
    per_doc = per_doc.select(F.col("doc_key.id").alias("id"), F.col("doc_key.h").alias("h"), F.col("doc_key.n").alias("n"), "items", "equal", "item_id")
    keyed = docs.select(row_struct(docs, carry).alias("doc"), key.alias("doc_key"))
    joined = keyed.join(per_doc, keyed.doc_key.id.eqNullSafe(per_doc.id) & (keyed.doc_key.h == per_doc.h) & (keyed.doc_key.n == per_doc.n), "left")
    return joined.select("doc", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.lit(0)).cast("long").alias("n_items"), "item_id", F.coalesce("equal", F.lit(0)).alias("equal"))


def query(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return out.select("doc.doc_id", "contaminated", "n_items", "item_id", F.col("equal").cast("long").alias("equal_tokens"))


#: The rule itself, without masks: items and documents are laid side by side wherever they have a token in common.
_SPACED = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", UNSEGMENTED)
_TOKENS = rf"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '({_SPACED})', ' \1 ', 'g'), '[\x00-/:-@\[-`{{-\x7F]+'), lambda x: x <> '')"
SQL = rf"""
WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
b0 AS (SELECT item_id, {_TOKENS} AS t FROM benchmark),
b AS (SELECT min(item_id) AS item_id, t, len(t) < {SPAN} AS short FROM b0 WHERE len(t) > 0 GROUP BY t),
dt AS (SELECT doc_id, unnest(t) AS w, unnest(range(0, len(t))) AS p FROM d),
bt AS (SELECT item_id, short, len(t) AS n, unnest(t) AS w, unnest(range(0, len(t))) AS p FROM b),
hits AS (SELECT doc_id, item_id, short, n, dt.p - bt.p AS diagonal, count(*) AS alike FROM dt JOIN bt USING (w) GROUP BY ALL HAVING count(*) >= least(n, {NEEDED})),
same AS (
  SELECT h.doc_id, h.item_id, list_transform(range(greatest(-diagonal, 0), least(len(b.t), len(d.t) - diagonal)), lambda i: CASE WHEN d.t[i + diagonal + 1] = b.t[i + 1] THEN 1 ELSE 0 END) AS m
  FROM hits h JOIN d ON d.doc_id = h.doc_id JOIN b ON b.item_id = h.item_id WHERE NOT h.short),
windows AS (SELECT doc_id, item_id, CASE WHEN len(m) >= {WINDOW} THEN list_max(list_transform(range(1, len(m) - {WINDOW} + 2), lambda k: list_sum(m[k:k + {WINDOW - 1}]))) ELSE 0 END AS equal FROM same),
found AS (
  SELECT doc_id, item_id, max(equal) AS equal FROM windows GROUP BY ALL HAVING max(equal) >= {NEEDED}
  UNION ALL SELECT DISTINCT doc_id, item_id, n AS equal FROM hits WHERE short AND alike = n),
best AS (SELECT doc_id, count(*) AS n_items, arg_max(item_id, equal * 1000000000 - item_id) AS item_id, max(equal) AS equal FROM found GROUP BY doc_id)
SELECT documents.doc_id, best.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, item_id, CAST(coalesce(equal, 0) AS BIGINT) AS equal_tokens
FROM documents LEFT JOIN best ON best.doc_id = documents.doc_id
"""
