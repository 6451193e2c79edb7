"""Operator 8: secret scans with corpus-wide ownership frequency.

Each text is scanned for the base kinds (assign, access, hex) and for other random-looking tokens. All candidates are
hashed, and the hashes are aggregated over the corpus by distinct repositories and owners (here: documents and their
``source``). A candidate that several owners hold is a copied example; one that stays with an owner in few repositories
looks live. The base spans always stay; random-looking tokens are added, as kind ``token``: those that look live beside
the base spans, the others as examples. Every span says whether it looks live.

Distribution: the scan is one map over Arrow batches whose result, a few numbers a document, is written to the shared
folder. Ownership is counted in four aggregations, each combined before it moves: distinct (hash, owner, text), then
distinct (hash, owner, repository), then per (hash, owner), then per hash; a hash in a third of all documents is a third
of the rows only of the first two, whose keys are even. Verdicts are joined back by hash, where adaptive execution splits hot hashes.

Defined cases: null and empty texts have no spans; a null owner counts as an owner of its own, a null identifier as a
repository of its own; repeated rows are scanned each but count as one repository, as do an owner's repositories with
the same text, under the smallest identifier; very long texts are scanned whole; an empty table gives an empty result;
columns are carried in a struct and cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_texts import map_texts
from .common import row_struct, stored, table
from .pii import touching

#: Fixed by the query contract; (pattern, group whose length counts, least length).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of 24 and more, as those of [0-9a-f]+ that pass
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Other candidates: long runs with letters and digits whose characters vary.
LOOSE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_DIGITS, LEAST_LETTERS, LEAST_ENTROPY = 4, 4, 3.2
#: A candidate looks live when at most this many owners and repositories hold it.
LIVE_OWNERS, LIVE_REPOSITORIES = 1, 3


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind index, end, the secret itself) of the base kinds."""
    found = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def loose_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Random-looking tokens that touch no base span."""
    found = []
    touches = touching((a, b) for a, _, b, _ in base)
    for m in LOOSE.finditer(text):
        s = m[0]
        digits = sum(c.isdigit() for c in s)
        if digits >= LEAST_DIGITS and sum(c.isalpha() for c in s) >= LEAST_LETTERS and entropy(s) >= LEAST_ENTROPY and not touches(m.start(), m.end()):
            found.append((m.start(), len(KINDS), m.end(), s))
    return found


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()), ("hash", pa.binary())]))


def _scan(texts: pa.Array) -> list[pa.Array]:
    rows = []
    for text in texts.to_pylist():
        base = base_spans(text) if text else []
        found = base + (loose_spans(text, base) if text else [])
        rows.append([{"start": a, "kind": k, "stop": b, "hash": hashlib.sha256(s.encode("utf-8", "surrogatepass")).digest()[:16]} for a, k, b, s in found])
    return [pa.array(rows, _SPAN)]


def scan(docs: DataFrame, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """A row per document: doc, found (array of start, kind, stop, hash), base kinds first."""
    return map_texts(docs, text_col, carry or docs.columns, "found array<struct<start: bigint, kind: int, stop: bigint, hash: binary>>", _scan)


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, owner, repository, text (its digest) -> hash, owners, repositories (distinct, over the corpus; an owner's copies of a text count once)."""
    texts = candidates.groupBy("hash", "owner", "text").agg(F.min("repository").alias("repository"))
    once = texts.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """A row per document: doc, found and examples (spans with kind, start, stop, owners, repositories, live), sorted by start and kind.

    ``found`` holds the base spans and the loose tokens that look live, ``examples`` the other loose tokens.
    """
    text = docs[text_col].cast("string")
    held = docs.select(row_struct(docs, carry).alias("row"), docs[owner_col].alias("owner"), docs[repository_col].alias("repository"), F.sha2(text.cast("binary"), 256).alias("digest"), text.alias("text"))
    scanned = scan(held, text_col="text", carry=["row", "owner", "repository", "digest"]).withColumn("row", F.monotonically_increasing_id())
    scanned = stored(scanned, "secrets")
    each = scanned.filter(F.size("found") > 0).select("row", F.col("doc.owner").alias("owner"), F.col("doc.repository").alias("repository"), F.col("doc.digest").alias("text"), F.explode("found").alias("at"))
    each = each.select("row", "owner", "repository", "text", "at.*")
    counts = stored(ownership(each), "ownership")
    live = (F.col("owners") <= LIVE_OWNERS) & (F.col("repositories") <= LIVE_REPOSITORIES)
    judged = each.join(counts, "hash").withColumn("live", live)
    spans = judged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "owners", "repositories", "live"))).alias("found"))
    doc = F.col("doc.row").alias("doc")
    none = F.array().cast(spans.schema["found"].dataType)
    every = scanned.drop("found").join(spans, "row", "left").select(doc, F.coalesce("found", none).alias("every"))
    example = lambda s: ~s["live"] & (s["kind"] >= len(KINDS))
    return every.select("doc", F.filter("every", lambda s: ~example(s)).alias("found"), F.filter("every", example).alias("examples"))


def counts_by_kind(spans: str, kinds: tuple[str, ...]) -> list[Column]:
    """n_<kind> for each kind. (A second argument of the lambda would be the place in the array, so the kind is no default.)"""

    def count(k: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")

    return [count(k).alias(f"n_{name}") for k, name in enumerate(kinds)]


def joined_spans(spans, kinds: tuple[str, ...]):
    """kind:start:end of an array of spans, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), carry=["doc_id"])
    found = found.select("doc", F.array_sort(F.concat("found", "examples")).alias("found"))
    base = F.filter("found", lambda s: s["kind"] < len(KINDS))
    n = counts_by_kind("found", KINDS)
    return found.select(
        "doc.doc_id",
        *n,
        F.sha2(joined_spans(base, KINDS).cast("binary"), 256).alias("base_sha256"),
        joined_spans(F.col("found"), (*KINDS, "token")).alias("spans"),
        F.array_join(F.transform("found", lambda s: F.when(s["live"], "live").otherwise("example")), ",").alias("classes"),
        F.size(F.filter("found", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )
