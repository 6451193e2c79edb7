"""The library's queries over whole tables, and for each that SQL can express the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import compare as cp
from ..functions import fuzzy
from ..functions import normalize as nz
from ..operators import catalog, contracts, documents, retrieve, sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _search(spark, sf_dir, **options) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    items = e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")
    found = retrieve.top_k(q, items, **options)
    return found.select("query_id", "item_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def _search_sql(k: int, where: str = "TRUE", threshold: str = "TRUE") -> str:
    return f"""
WITH pairs AS (
  SELECT q.vec_id AS query_id, i.vec_id AS item_id, list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS score
  FROM embeddings q, embeddings i WHERE q.vec_id % 20 = 0 AND {where}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank FROM pairs WHERE {threshold})
SELECT query_id, item_id, round(score, 4) AS score, rank FROM ranked WHERE rank <= {k}"""


@query(_search_sql(8))
def vector_topk(spark, sf_dir):
    return _search(spark, sf_dir, k=8)


@query(_search_sql(10, "i.label = 1"))
def vector_topk_filtered(spark, sf_dir):
    return _search(spark, sf_dir, k=10, section=F.col("label") == 1)


@query(_search_sql(20, threshold="score >= 0.8"))
def vector_threshold(spark, sf_dir):
    return _search(spark, sf_dir, k=20, threshold=retrieve.THRESHOLD)


@query("""
WITH r AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS runs FROM documents)
SELECT doc_id, array_to_string(list_filter(runs, lambda x: length(x) = 9), ',') AS inn, array_to_string(list_filter(runs, lambda x: length(x) = 5), ',') AS mfo,
  array_to_string(list_filter(runs, lambda x: length(x) = 20), ',') AS accounts FROM r""")
def digit_candidates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", *[F.array_join(nz.digit_runs("text", n), ",").alias(name) for name, n in (("inn", 9), ("mfo", 5), ("accounts", 20))])


@query(r"""
SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?')), ',') AS swift
FROM documents""")
def swift_candidates(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(nz.swift_codes("text"), ",").alias("swift"))


@query(r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
hits AS (SELECT doc_id, k, contains(lower(line), 'th') AS near, unnest(regexp_extract_all(line, '[0-9]+')) AS run, generate_subscripts(regexp_extract_all(line, '[0-9]+'), 1) AS j FROM lines),
five AS (SELECT *, bool_or(near) OVER (PARTITION BY doc_id) AS any_near FROM hits WHERE length(run) = 9),
kept AS (SELECT doc_id, run, min(k * 1000000 + j) AS place FROM five WHERE near OR NOT any_near GROUP BY doc_id, run)
SELECT d.doc_id, coalesce(string_agg(run, ',' ORDER BY place), '') AS found FROM documents d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id""")
def context_candidates(spark, sf_dir):
    found = nz.by_context(F.split("text", "\n"), lambda x: nz.digit_runs(x, 9), ["th"])
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("found"))


@query()
def document_candidates(spark, sf_dir):
    found = nz.extract_candidates("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(found).alias("candidates"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders""")
def normalize_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    months = F.array(*[F.lit(m) for m in ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")])
    worded = F.concat(F.dayofmonth(d).cast("string"), F.lit(" "), F.get(months, F.month(d) - 1), F.lit(" "), F.year(d).cast("string"), F.lit(" г."))
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, F.date_format(d, "dd.MM.yyyy")).when(k == 1, F.date_format(d, "yyyy/MM/dd")).when(k == 2, worded).when(k == 3, F.date_format(d, "'signed 'd-M-yyyy")).otherwise(F.date_format(d, "'99.'MM.yyyy 'or ' dd 'mart' yyyy"))
    return o.select("o_orderkey", nz.normalize_date(raw).alias("iso"))


@query("""
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 3 THEN round(l_extendedprice * 1000) ELSE round(l_extendedprice, 2) END AS amount FROM lineitem""")
def normalize_amounts(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    us = F.format_number(F.round("l_extendedprice", 2), 2)
    k = F.col("l_linenumber") % 4
    raw = F.when(k == 0, us).when(k == 1, F.translate(us, ",.", " ,")).when(k == 2, F.concat(F.lit("  "), F.translate(us, ",.", ".,"))).otherwise(F.format_string("%.3f", F.round(F.col("l_extendedprice") * 1000) / 1000))
    return li.select("l_orderkey", "l_linenumber", nz.normalize_amount(raw).alias("amount"))


@query("""
WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS ours, p_retailprice AS theirs FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey, l_linenumber, abs(ours - theirs) <= greatest(abs(theirs) * 0.005::DOUBLE, 0.05::DOUBLE) AS numbers_equal,
  abs(ours - theirs) <= greatest(0.01::DOUBLE * greatest(abs(ours), abs(theirs)), 0.05::DOUBLE) AS close FROM x""")
def compare_prices(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    x = x.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_quantity")).alias("ours"), F.col("p_retailprice").alias("theirs"))
    return x.select("l_orderkey", "l_linenumber", cp.numbers_equal("ours", "theirs").alias("numbers_equal"), cp.close("ours", "theirs").alias("close"))


@query("""
WITH s AS (SELECT l_orderkey AS contract_id, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS line_sum,
    count(*) FILTER (WHERE NOT abs(l_quantity * 1000 - l_extendedprice) <= greatest(0.01::DOUBLE * greatest(l_quantity * 1000, l_extendedprice), 0.05::DOUBLE)) AS bad_rows
  FROM lineitem GROUP BY 1)
SELECT contract_id, line_sum, bad_rows = 0 AS rows_ok, bad_rows, abs(line_sum - o_totalprice) <= greatest(0.01::DOUBLE * greatest(abs(line_sum), abs(o_totalprice)), 0.05::DOUBLE) AS total_ok
FROM s JOIN orders ON o_orderkey = contract_id""")
def order_total_check(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("contract_id"), F.col("l_quantity").alias("quantity"), F.lit(1000.0).alias("price"), F.col("l_extendedprice").alias("amount"))
    totals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("contract_id"), F.array("o_totalprice", F.lit(None).cast("double")).alias("totals"))
    return contracts.check_arithmetic(items, totals)


@query("""
WITH f AS (SELECT source, n_chars % 2 = 0 AS required, CASE WHEN quality IS NULL THEN 'na' WHEN quality = 0 THEN 'low' WHEN toxic = 1 THEN 'failed' ELSE 'high' END AS confidence FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT source AS contract_id, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'low') AS low, count(*) FILTER (confidence = 'failed') AS failed,
    count(*) FILTER (confidence = 'na') AS na, count(*) FILTER (confidence = 'na' AND required) AS critical_missing FROM f GROUP BY 1),
n AS (SELECT *, failed + critical_missing AS bad, CASE WHEN high + low + failed + critical_missing = 0 THEN 1 ELSE high + low + failed + critical_missing END AS judged FROM c)
SELECT contract_id, high, low, failed, na, critical_missing, CASE WHEN bad = 0 AND 10 * low <= judged THEN 'high' WHEN 5 * bad <= judged THEN 'low' ELSE 'failed' END AS overall FROM n""")
def confidence_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    c = F.when(F.col("quality").isNull(), "na").when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "failed").otherwise("high")
    rows = d.select(F.col("source").alias("contract_id"), c.alias("confidence"), (F.col("n_chars") % 2 == 0).alias("required"))
    return contracts.overall_confidence(rows)


@query("""
WITH p AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'доллары США' WHEN 2 THEN '840' WHEN 3 THEN 'EUR' ELSE '' END AS written,
  CASE WHEN c_nationkey % 3 = 0 THEN '840' WHEN c_nationkey % 3 = 1 THEN '978' ELSE '000' END AS code,
  CASE c_custkey % 4 WHEN 0 THEN 'DAT' WHEN 1 THEN 'fob' WHEN 2 THEN '4' ELSE 'CIP' END AS term, CASE WHEN c_nationkey % 2 = 0 THEN '15' ELSE '4' END AS term_code FROM customer)
SELECT c_custkey, CASE WHEN code = '840' THEN written IN ('USD', 'доллары США', '840') WHEN code = '978' THEN written = 'EUR' END AS currency_ok,
  CASE term_code WHEN '15' THEN term = 'DAT' ELSE term IN ('fob', '4') END AS term_ok FROM p""")
def code_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k, n = F.col("c_custkey") % 5, F.col("c_nationkey")
    written = F.when(k == 0, "USD").when(k == 1, "доллары США").when(k == 2, "840").when(k == 3, "EUR").otherwise("")
    code = F.when(n % 3 == 0, "840").when(n % 3 == 1, "978").otherwise("000")
    t = F.col("c_custkey") % 4
    term = F.when(t == 0, "DAT").when(t == 1, "fob").when(t == 2, "4").otherwise("CIP")
    return c.select("c_custkey", cp.currency_matches(written, code).alias("currency_ok"), cp.term_matches(term, F.when(n % 2 == 0, "15").otherwise("4")).alias("term_ok"))


@query("""
WITH p AS (SELECT c_custkey, c_name AS ours, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN replace(c_name, '#', ' № ') ELSE c_name || 'X' END AS theirs, c_custkey % 7 = 0 AS none FROM customer)
SELECT c_custkey, CASE WHEN theirs IS NULL OR trim(theirs) = '' THEN CASE WHEN none THEN 'missing_pdf' ELSE 'missing_api' END WHEN none THEN 'mismatch'
  WHEN c_custkey % 4 = 2 THEN 'match' ELSE 'mismatch' END AS status FROM p""")
def field_status(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 4
    theirs = F.when(k == 0, None).when(k == 1, "  ").when(k == 2, F.replace("c_name", F.lit("#"), F.lit(" № "))).otherwise(F.concat("c_name", F.lit("X")))
    ours = F.when(F.col("c_custkey") % 7 != 0, F.col("c_name"))
    return c.select("c_custkey", ours.alias("ours"), theirs.alias("theirs")).select("c_custkey", cp.compare_value("ours", "theirs", "id")["status"].alias("status"))


def _contract_pairs(spark, sf_dir) -> DataFrame:
    """Orders as contracts: what was extracted, and the record to compare it with (some fields changed by key)."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    party = lambda name, country, inn: F.struct(name.alias("name"), country.alias("country"), inn.alias("inn"))
    inn = F.lpad(F.col("c_custkey").cast("string"), 9, "3")
    home = F.when(F.col("o_orderkey") % 3 == 0, "Uzbekistan").otherwise("O'zbekiston")
    extracted = F.struct(
        F.concat(F.lit("N-"), F.col("o_orderkey").cast("string")).alias("contract_number"),
        day.alias("contract_date"),
        F.lit("USD").alias("currency"),
        F.col("o_totalprice").alias("total_amount"),
        party(F.concat(F.lit("LLC "), F.col("n_name"), F.lit(" Trade")), F.lit("Germany"), F.lit(None).cast("string")).alias("seller"),
        party(F.col("c_name"), home, inn).alias("buyer"),
    )
    api = F.struct(
        F.concat(F.lit("N "), (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0)).cast("string")).alias("docNo"),
        F.date_format("o_orderdate", "dd.MM.yyyy").alias("docDate"),
        F.lit("840").alias("currCode1"),
        F.round(F.col("o_totalprice") * F.when(F.col("o_orderkey") % 7 == 0, 1.2).otherwise(1.0), 2).alias("amount1"),
        F.concat(F.col("n_name"), F.lit(" TRADE")).alias("contractorForName"),
        F.lit("276").alias("contractorForCountryCode"),
        F.col("c_name").alias("contractorUzName"),
        inn.alias("contractorUzInn"),
        F.lit("02").alias("cntrType"),
    )
    return o.select(F.col("o_orderkey").alias("contract_id"), F.parse_json(F.to_json(extracted)).alias("extracted"), F.parse_json(F.to_json(api)).alias("api"))


_MATCHING = "'FOR.country', 'FOR.name', 'UZ.inn', 'UZ.name', 'contract_date', 'contract_type', 'currency'"
_STATUSES = f"""
WITH o AS (SELECT o_orderkey AS contract_id, o_orderkey % 11 = 0 AS other_number, o_totalprice AS ours, round(o_totalprice * CASE WHEN o_orderkey % 7 = 0 THEN 1.2::DOUBLE ELSE 1 END, 2) AS theirs FROM orders),
f AS (SELECT unnest([{_MATCHING}, 'contract_number', 'total_amount', 'payment_currency', 'FOR.address', 'FOR.bank.attributes', 'FOR.bank.name', 'UZ.address', 'delivery.incoterms', 'delivery.place',
  'manufacturer.country', 'manufacturer.inn', 'manufacturer.name', 'payment_deadline', 'receiver.country', 'receiver.inn', 'receiver.name', 'specification_number', 'supplier.country', 'supplier.inn', 'supplier.name']) AS field),
s AS (SELECT contract_id, field, CASE WHEN field IN ({_MATCHING}) THEN 'match' WHEN field = 'contract_number' THEN CASE WHEN other_number THEN 'mismatch' ELSE 'match' END
  WHEN field = 'total_amount' THEN CASE WHEN abs(ours - theirs) <= greatest(abs(theirs) * 0.005::DOUBLE, 0.05::DOUBLE) THEN 'match' ELSE 'mismatch' END
  WHEN field = 'payment_currency' THEN 'missing_api' ELSE 'missing_pdf' END AS status FROM o, f)
"""


@query(_STATUSES + "SELECT contract_id, 'import' AS orientation, field, status, CASE status WHEN 'match' THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM s")
def contract_reconcile(spark, sf_dir):
    return contracts.compare_contracts(_contract_pairs(spark, sf_dir)).select("contract_id", "orientation", "field", "status", "score")


@query(_STATUSES + "SELECT contract_id, count(*) FILTER (status = 'match') AS matched, count(*) FILTER (status = 'mismatch') AS mismatched, count(*) AS total_compared FROM s GROUP BY contract_id")
def contract_counts(spark, sf_dir):
    return contracts.counts(contracts.compare_contracts(_contract_pairs(spark, sf_dir)))


_OLD = "SELECT CAST(doc_id AS VARCHAR) AS document_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS content_hash, CASE WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'indexed' END AS status, CASE WHEN doc_id % 7 <> 0 THEN 3 END AS chunk_count FROM documents WHERE doc_id % 3 <> 0"


def _catalogue(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    pages = d.select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("html"))
    then = F.lit("2024-01-01").cast("timestamp")
    failed = F.col("doc_id") % 7 == 0
    old = d.filter("doc_id % 3 <> 0").select(
        F.col("doc_id").cast("string").alias("document_id"),
        nz.content_hash(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"),
        F.when(failed, "failed").otherwise("indexed").alias("status"),
        then.alias("scraped_at"),
        F.when(~failed, then).alias("indexed_at"),
        F.when(~failed, 3).alias("chunk_count"),
    )
    return old, pages


_CHANGED = f"""WITH old AS ({_OLD}), fresh AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, sha256(text) AS new_hash FROM documents),
x AS (SELECT document_id, CASE WHEN content_hash IS NULL THEN 'new' WHEN content_hash <> new_hash THEN 'updated' ELSE 'unchanged' END AS outcome, new_hash, status, chunk_count FROM fresh LEFT JOIN old USING (document_id)),
after AS (SELECT document_id, outcome, new_hash AS content_hash, CASE WHEN outcome = 'unchanged' THEN status ELSE outcome END AS status, CASE WHEN outcome = 'unchanged' THEN chunk_count END AS chunk_count,
  outcome = 'unchanged' AND status = 'indexed' AS is_indexed FROM x)
"""


@query(_CHANGED + "SELECT document_id, outcome, content_hash, status, CAST(coalesce(chunk_count, -1) AS BIGINT) AS chunk_count FROM after")
def document_changes(spark, sf_dir):
    return catalog.check_and_update(*_catalogue(spark, sf_dir)).select("document_id", "outcome", "content_hash", "status", F.coalesce("chunk_count", F.lit(-1)).cast("long").alias("chunk_count"))


@query(_CHANGED + "SELECT document_id FROM after WHERE NOT is_indexed OR status IN ('new', 'updated', 'failed')")
def pending_documents(spark, sf_dir):
    return catalog.pending(catalog.check_and_update(*_catalogue(spark, sf_dir)))


@query(_CHANGED + "SELECT count(*) AS total, count(*) FILTER (WHERE is_indexed) AS indexed, count(*) FILTER (WHERE NOT is_indexed) AS pending, CAST(coalesce(sum(chunk_count), 0) AS BIGINT) AS chunks FROM after")
def catalogue_stats(spark, sf_dir):
    return catalog.stats(catalog.check_and_update(*_catalogue(spark, sf_dir)))


@query(_CHANGED + "SELECT outcome, count(*) AS n FROM after GROUP BY outcome")
def cycle_counts(spark, sf_dir):
    return catalog.cycle_counts(catalog.check_and_update(*_catalogue(spark, sf_dir)))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", nz.content_hash("text").alias("content_hash"))


@query("SELECT user_id, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS message_count FROM events GROUP BY user_id")
def session_rollup(spark, sf_dir):
    return sessions.touch(table(spark, sf_dir, "events"), at="ts")


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3")
def history_last_turns(spark, sf_dir):
    return sessions.history(table(spark, sf_dir, "conversations"), 3, user="conv_id", order="turn")


@query("""SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND next_role = 'assistant'""")
def question_answers(spark, sf_dir):
    return sessions.turn_pairs(table(spark, sf_dir, "conversations"))


@query("""
WITH c AS (SELECT doc_id % 97 AS query_id, text, doc_id AS rank, doc_id FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY rank) AS copy FROM c),
u AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM o WHERE copy = 1)
SELECT query_id, doc_id, CAST(used AS BIGINT) AS used FROM u WHERE used <= 18000""")
def context_budget(spark, sf_dir):
    c = table(spark, sf_dir, "documents").select((F.col("doc_id") % 97).alias("query_id"), "text", F.col("doc_id").alias("rank"), "doc_id")
    return retrieve.budgeted_context(c).select("query_id", "doc_id", "used")


@query("""
WITH h AS (SELECT doc_id % 10 AS query_id, source AS document_id, lang AS band_number, CASE WHEN n_chars > 2000 THEN 'x' END AS element_id, doc_id AS rank FROM documents)
SELECT query_id, document_id, band_number, coalesce(element_id, '-') AS element_id, min(rank) AS rank FROM h GROUP BY 1, 2, 3, element_id""")
def unique_sources(spark, sf_dir):
    h = table(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("query_id"), F.col("source").alias("document_id"), F.col("lang").alias("band_number"), F.when(F.col("n_chars") > 2000, "x").alias("element_id"), F.col("doc_id").alias("rank"))
    return retrieve.unique_sources(h).select("query_id", "document_id", "band_number", F.coalesce("element_id", F.lit("-")).alias("element_id"), "rank")


@query("""
SELECT conv_id, turn, CASE WHEN text IS NULL OR length(text) < 3 OR length(text) > 2000 THEN 'question has 3 to 2000 characters' WHEN turn + 1 > 20 THEN 'top_k is 1 to 20' END AS error
FROM conversations""")
def request_errors(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", retrieve.request_error("question", "text", F.col("turn") + 1).alias("error"))


@query("""
WITH q AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id)
SELECT conv_id, 'passage: ' || text AS passage, greatest(1024, least(8192, 20480 - (length(text) // 2 + 500))) AS tokens FROM conversations JOIN q USING (conv_id) WHERE turn = last""")
def prompt_budget(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return c.withColumn("rn", last).filter("rn = 1").select("conv_id", retrieve.with_prefix(F.col("text")).alias("passage"), retrieve.token_budget(F.col("text")).alias("tokens"))


@query("""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))), ',') AS links FROM pages""")
def page_links(spark, sf_dir):
    links = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(links, ",").alias("links"))


@query("SELECT CAST(page_id AS BIGINT) AS page_id, CASE page_id % 4 WHEN 0 THEN '-' || page_id WHEN 1 THEN CAST(page_id AS VARCHAR) WHEN 2 THEN '-' || page_id END AS document_id FROM pages")
def document_list_ids(spark, sf_dir):
    i = F.col("page_id").cast("string")
    k = F.col("page_id") % 4
    line = F.when(k == 0, F.concat(F.lit(" https://x/uz/docs/-"), i, F.lit("?ONDATE=1"))).when(k == 1, F.concat(F.lit("/acts/"), i)).when(k == 2, F.concat(F.lit(" -"), i)).otherwise(F.concat(F.lit("# "), i))
    return table(spark, sf_dir, "pages").select("page_id", nz.document_id(line).alias("document_id"))


@query(r"""
WITH a AS (SELECT page_id, string_split_regex(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '<x>', 'g'), '<[^>]*>') AS parts FROM pages),
b AS (SELECT page_id, list_filter(list_transform(parts, lambda x: regexp_replace(replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&amp;', '&'), '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM a)
SELECT page_id, regexp_replace(replace(array_to_string(parts, ' '), chr(160), ' '), '[ \t]{2,}', ' ', 'g') AS text FROM b""")
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", documents.html_text("html").alias("text"))


def _pages_as_documents(spark, sf_dir) -> DataFrame:
    """Texts laid out as legal documents, so the parser has articles and tables to read."""
    d = table(spark, sf_dir, "documents")
    esc = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    parts = F.transform(F.split(esc, "\n"), lambda x, i: F.concat(F.lit('<div class="ACT_TEXT"><div id="-'), i.cast("string"), F.lit('"></div>'), (i + 1).cast("string"), F.lit(". "), x, F.lit("</div>")))
    rows = F.concat(F.lit("<tr><th>T/r</th><th>lang</th><th>source</th></tr><tr><td>1.</td><td>"), F.coalesce("lang", F.lit("")), F.lit("</td><td>"), F.coalesce("source", F.lit("")), F.lit("</td></tr>"))
    html = F.concat(F.lit('<div id="divCont"><div class="ACT_TITLE">Doc</div><div class="TEXT_HEADER_DEFAULT">One</div>'), F.array_join(parts, ""), F.lit('<div class="TABLE_STD"><table>'), rows, F.lit("</table></div></div>"))
    return d.select(F.col("doc_id").cast("string").alias("document_id"), html.alias("html"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k, lang, source FROM documents),
t AS (SELECT *, regexp_replace(k || '. ' || line, '[ \t]{2,}', ' ', 'g') AS raw FROM l),
s AS (SELECT *, regexp_replace(raw, '\s+$', '') AS text FROM t),
g AS (SELECT *, CASE WHEN regexp_matches(text, '^\d+\.\s') THEN 1 ELSE 0 END AS starts FROM s),
b AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY k) AS band FROM g),
bands AS (SELECT doc_id, band, CASE WHEN max(starts) = 1 THEN CAST(min(k) AS VARCHAR) END AS band_number, '-' || (min(k) - 1) AS element_id, string_agg(text, chr(10) ORDER BY k) AS embed_text FROM b GROUP BY ALL),
ends AS (SELECT doc_id, arg_max(text, k) AS lead, any_value(lang) AS lang, any_value(source) AS source FROM b GROUP BY 1),
rows AS (
  SELECT doc_id, 'band' AS kind, band_number, element_id, embed_text, band AS place FROM bands
  UNION ALL SELECT doc_id, 'jadval', NULL, NULL, 'Doc' || CASE WHEN length(lead) BETWEEN 20 AND 120 AND NOT ends_with(lead, '.') THEN ' — ' || lead ELSE '' END || ' — ' || lang || '; source: ' || source, 1000000000 FROM ends WHERE coalesce(lang, '') <> '' AND coalesce(source, '') <> '')
SELECT CAST(doc_id AS VARCHAR) AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS pos, kind, band_number, element_id, embed_text FROM rows""")
def parsed_articles(spark, sf_dir):
    return documents.parse_documents(_pages_as_documents(spark, sf_dir)).select("document_id", F.col("pos").cast("long").alias("pos"), "kind", "band_number", "element_id", "embed_text")


@query()
def document_chunks(spark, sf_dir):
    chunks = documents.to_chunks(documents.parse_documents(_pages_as_documents(spark, sf_dir)))
    return chunks.select("chunk_id", "document_id", "kind", "part_no", "part_total", "embed_text", F.length("context_text").alias("context_chars"))


@query(r"""
WITH p AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS para, generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), 1) AS k FROM documents)
SELECT doc_id, count(*) AS paragraphs, CAST(sum(length(para)) AS BIGINT) AS chars, count(*) FILTER (WHERE length(para) > 1200) AS long_paragraphs FROM p GROUP BY doc_id""")
def paragraphs(spark, sf_dir):
    units = F.filter(F.transform(F.split("text", "\n"), nz.strip), lambda x: x != "")
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(units).alias("para"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("para")).alias("chars"), F.count_if(F.length("para") > 1200).alias("long_paragraphs"))


@query(r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS s FROM documents),
p AS (SELECT doc_id, s, list_filter(list_transform(string_split(s, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS paras FROM t),
q AS (SELECT doc_id, s, flatten(list_transform(paras, lambda x: CASE WHEN length(x) <= 1200 THEN [x] ELSE list_filter(list_transform(string_split(regexp_replace(x, '([.!?;:])\s+', '\1' || chr(1), 'g'), chr(1)), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')), lambda y: y <> '') END)) AS parts FROM p),
u AS (SELECT doc_id, CASE WHEN s = '' THEN [] WHEN length(s) <= 1200 THEN [s] ELSE flatten(list_transform(parts, lambda x: CASE WHEN length(x) <= 1200 THEN [x] ELSE list_transform(range(0, (length(x) - 1) // 1200 + 1), lambda k: substr(x, k * 1200 + 1, 1200)) END)) END AS units FROM q),
-- one unit after the other: the chunk that is open (its first unit and size), and the chunk that a unit closes
n AS (SELECT doc_id, units, len(units) AS n, list_transform(units, lambda x: length(x) + 1) AS sizes FROM u WHERE len(units) > 0),
w AS (
  SELECT doc_id, 1 AS k, 1 AS first, sizes[1] AS size, 0 AS part_no, CAST(NULL AS VARCHAR) AS closed FROM n
  UNION ALL
  SELECT doc_id, k + 1, CASE WHEN size + sizes[k + 1] > 1200 THEN k + 1 - back ELSE first END, CASE WHEN size + sizes[k + 1] > 1200 THEN coalesce(list_sum(sizes[k + 1 - back:k]), 0) + sizes[k + 1] ELSE size + sizes[k + 1] END,
    CASE WHEN size + sizes[k + 1] > 1200 THEN part_no + 1 ELSE part_no END, CASE WHEN size + sizes[k + 1] > 1200 THEN array_to_string(units[first:k], chr(10)) END
  FROM (SELECT w.*, n.units, n.sizes, n.n, len(list_filter(range(1, w.k - w.first + 2), lambda b: list_sum(n.sizes[w.k - b + 1:w.k]) - 1 <= 150)) AS back FROM w JOIN n USING (doc_id) WHERE w.k < n.n)),
c AS (SELECT doc_id, part_no - 1 AS part_no, closed AS chunk FROM w WHERE closed IS NOT NULL UNION ALL SELECT doc_id, part_no, array_to_string(units[first:k], chr(10)) FROM w JOIN n USING (doc_id) WHERE k = n),
d AS (SELECT *, lag(chunk) OVER x AS before, lead(chunk) OVER x IS NULL AS last FROM c WINDOW x AS (PARTITION BY doc_id ORDER BY part_no)),
e AS (SELECT * FROM d WHERE NOT (last AND before IS NOT NULL AND contains(before, chunk)))
SELECT doc_id, part_no, count(*) OVER (PARTITION BY doc_id) AS part_total, chunk FROM e""")
def text_chunks(spark, sf_dir):
    parts = documents.explode_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return parts.select("doc_id", "part_no", F.col("part_total").cast("long").alias("part_total"), F.col("part").alias("chunk"))


@query("""
WITH h AS (SELECT doc_id, substr(sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc|' || doc_id)), 1, 32) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id FROM h""")
def chunk_ids(spark, sf_dir):
    name = F.concat(F.lit("doc|"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", nz.uuid5(documents.CHUNK_NAMESPACE, name).alias("chunk_id"))


@query(r"SELECT p_partkey, regexp_replace(lower(strip_accents(p_name)), '[^0-9a-z]+', ' ', 'g') AS plain FROM part")
def plain_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(F.lower(nz.plain_letters("p_name")), "[^0-9a-z]+", " ").alias("plain"))


@query("SELECT p_partkey, lower(p_name) || ' 7a ' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN ' toshkent' ELSE '' END AS norm, CASE WHEN p_partkey = 7 THEN '7a,7' ELSE '7a,' || p_partkey END AS keys FROM part")
def name_tokens(spark, sf_dir):
    name = F.concat(F.lit("LLC «"), F.upper("p_name"), F.lit("» 7A #"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, ", Ташкент ООО").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", nz.norm_text(name).alias("norm"), F.array_join(nz.key_tokens(name), ",").alias("keys"))


@query()
def fuzzy_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    other = p.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("other"))
    x = p.join(other, "p_partkey")
    return x.select("p_partkey", *[F.round(f("p_name", "other"), 6).alias(n) for n, f in (("ratio", fuzzy.ratio_of), ("token_sort", fuzzy.token_sort_of), ("token_set", fuzzy.token_set_of), ("partial", fuzzy.partial_of))])


def _items(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    ours = li.select(F.col("l_orderkey").alias("contract_id"), F.col("l_linenumber").alias("p"), F.col("p_name").alias("name"), F.col("l_partkey").cast("string").alias("hs_code"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("amount"))
    theirs = li.filter("l_linenumber % 5 <> 4").select(F.col("l_orderkey").alias("contract_id"), F.col("l_linenumber").alias("g"), F.concat("p_name", F.lit(" / item")).alias("name"), F.col("l_partkey").cast("string").alias("hs_code"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("amount"))
    return ours, theirs


def _numbered_items(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Items whose names hold their place in the order, and goods that lack every fifth and differ in some fields."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey")).withColumn("p", place)
    named = F.concat_ws(" ", "p_name", "p")
    ours = li.select(F.col("l_orderkey").alias("contract_id"), "p", named.alias("name"), F.col("l_partkey").cast("string").alias("hs_code"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_extendedprice").alias("amount"), F.lit("kg").alias("unit"))
    g = F.col("p")
    changed = {"name": F.concat("name", F.lit(" / item "), g.cast("string")), "hs_code": F.when(g % 3 == 0, F.concat("hs_code", F.lit("9"))).otherwise(F.col("hs_code")), "quantity": F.col("quantity") * F.when(g % 2 == 0, 2).otherwise(1), "price": F.col("price") * F.when(g % 3 == 0, 1.1).otherwise(1.0), "unit": F.lit("166")}
    return ours, ours.filter("p % 5 <> 4").withColumns(changed).withColumnRenamed("p", "g")


_NUMBERED = "WITH x AS (SELECT l_orderkey AS contract_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS p FROM lineitem)"


@query(_NUMBERED + """ SELECT contract_id, p, CASE WHEN p % 5 <> 4 THEN p END AS g, CASE WHEN p % 5 <> 4 THEN 1 + CASE WHEN p % 3 = 0 THEN 0 ELSE 0.3 END + CASE WHEN p % 2 = 0 THEN 0 ELSE 0.2 END END::DOUBLE AS score FROM x""")
def product_match(spark, sf_dir):
    return contracts.match_products(*_numbered_items(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query()
def product_match_by_name(spark, sf_dir):
    """Names of few words, many of them alike: the choice is by similarity and order, which SQL cannot follow (tested by a loop)."""
    return contracts.match_products(*_items(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(_NUMBERED + """ SELECT contract_id, count(*) FILTER (p % 5 = 4) AS unmatched_pdf, CAST(0 AS BIGINT) AS unmatched_api, CAST(coalesce(sum(CASE WHEN p % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN p % 2 = 0 THEN 1 ELSE 0 END) FILTER (p % 5 <> 4), 0) AS BIGINT) AS differing,
  count(*) FILTER (p % 5 = 4) + CAST(coalesce(sum(CASE WHEN p % 3 = 0 THEN 2 ELSE 0 END + CASE WHEN p % 2 = 0 THEN 1 ELSE 0 END) FILTER (p % 5 <> 4), 0) AS BIGINT) AS product_issues FROM x GROUP BY contract_id""")
def product_issues(spark, sf_dir):
    ours, theirs = _numbered_items(spark, sf_dir)
    return contracts.product_issues(contracts.item_pairs(contracts.match_products(ours, theirs), ours, theirs))


@query("""
WITH l AS (SELECT l_orderkey AS contract_id, l_linenumber AS n, CASE WHEN l_orderkey % 13 <> 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS amount FROM lineitem),
t AS (SELECT contract_id, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS pdf_sum, CAST(coalesce(sum(amount) FILTER (n % 5 <> 4), 0) AS DOUBLE) AS api_sum, count(*) FILTER (n % 5 <> 4) AS goods FROM l GROUP BY 1)
SELECT contract_id, pdf_sum, api_sum, CASE WHEN goods = 0 THEN 'missing' WHEN abs(pdf_sum - api_sum) <= greatest(abs(api_sum) * 0.005::DOUBLE, 0.05::DOUBLE) THEN 'match' ELSE 'mismatch' END AS status FROM t""")
def product_totals(spark, sf_dir):
    amount = F.when(F.col("contract_id") % 13 != 0, F.col("amount").cast("decimal(18,2)"))
    return contracts.product_totals(*(x.withColumn("amount", amount) for x in _items(spark, sf_dir)))


@query("""
WITH x AS (SELECT *, l_linenumber % 4 = 3 AS is_total FROM lineitem),
t AS (SELECT l_orderkey, arg_min(l_extendedprice, l_linenumber) AS total FROM x WHERE is_total GROUP BY 1)
SELECT l_orderkey AS contract_id, l_linenumber AS p, coalesce(total, -1) AS total_amount FROM x LEFT JOIN t USING (l_orderkey) WHERE NOT is_total""")
def last_total_rows(spark, sf_dir):
    is_total = F.col("l_linenumber") % 4 == 3
    # Orders repeat line numbers; of equal ones the first in the table counts, which the SQL leaves open.
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber IS NOT NULL").select(
        F.col("l_orderkey").alias("contract_id"),
        F.col("l_linenumber").alias("p"),
        F.when(is_total, "Итого").otherwise("item").alias("name"),
        F.when(~is_total, F.col("l_quantity")).alias("quantity"),
        F.lit(1.0).alias("price"),
        F.col("l_extendedprice").alias("amount"),
        F.lit(None).cast("double").alias("total_amount"),
        F.when(is_total, F.col("_metadata.file_path")).alias("file"),
        F.when(is_total, F.col("_metadata.row_index")).alias("row"),
    )
    return contracts.drop_total_rows(rows, ("p", "file", "row")).select("contract_id", "p", F.coalesce("total_amount", F.lit(-1.0)).alias("total_amount"))


@query("""
WITH x AS (SELECT p_partkey % 500 AS contract_id, p_partkey, p_name || ' ' || p_partkey AS latin, 'деталь ' || p_partkey AS cyrillic FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY p_partkey) AS n FROM x)
SELECT contract_id, CASE WHEN p_partkey % 3 = 0 THEN 2 * n ELSE 2 * n - 1 END AS p, CASE WHEN p_partkey % 3 = 0 THEN cyrillic || ' ' ELSE latin || ' / ' || cyrillic END AS name FROM r
UNION ALL SELECT contract_id, 2 * n - 1, latin FROM r WHERE p_partkey % 3 = 0""")
def bilingual_merge(spark, sf_dir):
    k = F.col("p_partkey")
    latin, cyrillic = F.concat("p_name", F.lit(" "), k.cast("string")), F.concat(F.lit("деталь "), k.cast("string"), F.when(k % 3 == 0, " ").otherwise(""))
    each = table(spark, sf_dir, "part").select((k % 500).alias("contract_id"), k, F.posexplode(F.array(latin, cyrillic)).alias("side", "name"), "p_retailprice")
    place = F.row_number().over(Window.partitionBy("contract_id").orderBy("p_partkey", "side"))
    # Every third pair differs in its price, so its rows stay apart.
    price = F.when((k % 3 == 0) & (F.col("side") == 1), F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice"))
    rows = each.select("contract_id", place.alias("p"), "name", k.cast("string").alias("hs_code"), F.lit(1.0).alias("quantity"), price.alias("price"), price.alias("amount"))
    return contracts.merge_bilingual(rows).select("contract_id", F.col("p").cast("long").alias("p"), "name")


@query("""
SELECT item_id, count(d.doc_id) AS holders FROM benchmark b LEFT JOIN documents d ON contains(trim(lower(regexp_replace(d.text, '\\s+', ' ', 'g'))), trim(lower(regexp_replace(b.text, '\\s+', ' ', 'g')))) GROUP BY item_id""".replace("\\\\", "\\"))
def text_containment(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", nz.squeeze("text").alias("needle"))
    d = table(spark, sf_dir, "documents").select(nz.squeeze("text").alias("hay"))
    return retrieve.holders(d, b)
