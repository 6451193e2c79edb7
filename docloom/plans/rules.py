"""Queries of single operators over the driver's tables, each with its rule written again in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compare as cp
from ..functions import normalize as nz
from ..operators import catalog, contracts, documents, retrieve, sessions
from ..sources import readers
from .catalogue import query, table


def _choice(key: Column, *values) -> Column:
    """The value at the key's remainder."""
    given = [v if isinstance(v, Column) else F.lit(v) for v in values]
    return F.element_at(F.array(*given), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _statuses(df: DataFrame, key: str, **compared: Column) -> DataFrame:
    return df.select(key, *[c["status"].alias(n) for n, c in compared.items()])


# --- extraction and normalisation ------------------------------------------------------------------------------------


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'DPU' WHEN 1 THEN 'CIF' WHEN 2 THEN NULL WHEN 3 THEN 'DAP' ELSE 'EXW' END AS term FROM customer")
def trade_terms(spark, sf_dir):
    text = _choice(F.col("c_custkey"), "условия DAT Ташкент", "cif hamburg", "XDATX, no term", "DAF/CIP border", "exw (factory), DDU later")
    return table(spark, sf_dir, "customer").select("c_custkey", nz.normalize_term(text).alias("term"))


@query("""
WITH o AS (SELECT o_orderkey, printf('%.2f', o_totalprice) AS p FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN replace(p, '.', ',') ELSE p END AS found FROM o""")
def amounts_found(spark, sf_dir):
    plain = F.format_string("%.2f", "o_totalprice")
    text = F.concat(F.lit("jami: "), F.when(F.col("o_orderkey") % 2 == 0, F.replace(plain, F.lit("."), F.lit(","))).otherwise(plain), F.lit(" USD"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(nz.amounts_in(text), "|").alias("found"))


@query("SELECT c_custkey, 'ABC-' || c_custkey || ' Xopom' AS looks, 'ABC' || c_custkey = 'ABC' || (c_custkey + c_custkey % 2) AS same_id FROM customer")
def lookalike_ids(spark, sf_dir):
    key = F.col("c_custkey")
    cyrillic = F.concat(F.lit("АВС-"), key.cast("string"), F.lit(" Хором"))
    same = cp.compare_id(F.concat(F.lit("АВС №"), key.cast("string")), F.concat(F.lit("abc–"), (key + key % 2).cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", nz.lookalikes(cyrillic).alias("looks"), (same["status"] == "match").alias("same_id"))


@query("SELECT p_partkey, p_name || '|' || lower(p_brand) AS script, CASE WHEN p_partkey % 3 = 0 THEN p_partkey || 'h' ELSE '' END AS keys, CASE p_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 0.5 END::DOUBLE AS cyrillic FROM part")
def name_scripts(spark, sf_dir):
    k = F.col("p_partkey")
    keyed = F.concat(F.lit("ООО «"), F.col("p_name"), F.lit("» "), F.when(k % 3 == 0, F.concat(k.cast("string"), F.lit("х"))).otherwise(""))
    share = nz.cyrillic_share(_choice(k, "Pump 24", "Насос 24", "аb 7"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit("|"), F.lower("p_brand")).alias("script"), F.array_join(nz.key_tokens(keyed), ",").alias("keys"), share.alias("cyrillic"))


@query("SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' toshkent' WHEN 1 THEN ' buxoro zavod' ELSE ' zavod' END AS norm FROM part".replace("buxoro", "buhoro"))
def folded_names(spark, sf_dir):
    more = _choice(F.col("p_partkey"), " ТАШКЕНТ", " Bukhara zavod", " MCHJ zavod")
    return table(spark, sf_dir, "part").select("p_partkey", nz.norm_text(F.concat(F.lit("«"), F.initcap("p_name"), F.lit("» ООО"), more)).alias("norm"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' / ' || p_brand || '|' || p_name || '|' || p_brand ELSE p_name END AS parts FROM part")
def bilingual_parts(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" / "), "p_brand")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(nz.split_bilingual(name), "|").alias("parts"))


@query("SELECT doc_id, CASE WHEN doc_id % 100 < 70 THEN source || printf('⟨%.2f⟩', (doc_id % 100) / 100.0::DOUBLE) ELSE source END AS marked FROM documents")
def low_confidence_marks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("confidence", F.col("doc_id") % 100 / 100.0)
    return d.select("doc_id", nz.mark_low_confidence("source", "confidence").alias("marked"))


@query("""
SELECT r_regionkey, '| ' || r_name || ' | col2 | x\\|y |' || chr(10) || '|---|---|---|' || chr(10) || '| ' || r_regionkey || ' | a b |  |' AS markdown FROM region""")
def markdown_tables(spark, sf_dir):
    header = F.array("r_name", F.lit(""), F.lit("x|y"))
    rows = F.array(F.array(F.col("r_regionkey").cast("string"), F.lit("a\nb")))
    return table(spark, sf_dir, "region").select("r_regionkey", nz.markdown_table(header, rows).alias("markdown"))


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || ' [...]' ELSE text END AS cut FROM documents")
def truncated_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", nz.truncate("text", 300, " [...]").alias("cut"))


@query("""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE array_to_string(list_sort(list_distinct(['-' || page_id, CAST(page_id + 1 AS VARCHAR)])), ',') END AS ids FROM pages""")
def linked_documents(spark, sf_dir):
    k = F.col("page_id")
    links = F.concat(F.lit('<a href="/uz/docs/-'), k.cast("string"), F.lit('">x</a> https://x/docs/'), (k + 1).cast("string"), F.lit("?y /docs/-"), k.cast("string"))
    html = F.concat("html", F.when(k % 3 == 0, F.lit("<a href='/acts/-5'>")).otherwise(links))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(nz.link_ids(html), ",").alias("ids"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'question ' || conv_id WHEN 1 THEN 'old ' || conv_id ELSE 'old ' || conv_id END AS question FROM conversations")
def cleaned_queries(spark, sf_dir):
    k = F.col("conv_id").cast("string")
    rewritten = _choice(F.col("turn"), F.concat(F.lit("\n «question "), k, F.lit("» \nexplanation")), F.lit(" \n "), F.repeat(F.lit("long "), F.lit(80)))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", nz.clean_query(rewritten, F.concat(F.lit("old "), k)).alias("question"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'kv.m' WHEN 2 THEN 'sht' ELSE 'upakovka' END AS unit FROM part")
def unit_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", nz.unit_key(_choice(F.col("p_partkey"), " КГ. ", "Кв. м", "шт..", "упаковка")).alias("unit"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 <> 0 THEN strftime(ts, '.%f') ELSE '' END AS iso FROM events")
def iso_timestamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", nz.iso_timestamp("ts").alias("iso"))


@query("SELECT o_orderkey, least(o_orderkey % 7, o_custkey % 5) AS x0, least(o_orderkey % 3, 1) AS y0, greatest(o_orderkey % 7, o_custkey % 5) AS x1, greatest(o_orderkey % 3, 1) AS y1 FROM orders")
def polygon_boxes(spark, sf_dir):
    xs, ys = F.array(F.col("o_orderkey") % 7, F.col("o_custkey") % 5), F.array(F.col("o_orderkey") % 3, F.lit(1).cast("long"))
    box = documents.bbox(F.array(F.array(xs[0], ys[0]), F.array(xs[1], ys[1])))
    return table(spark, sf_dir, "orders").select("o_orderkey", box.alias("b")).select("o_orderkey", "b.*")


# --- comparators -----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'mismatch' ELSE 'match' END AS date, CASE o_orderkey % 3 WHEN 0 THEN 'match' WHEN 1 THEN 'match' ELSE 'mismatch' END AS raw FROM orders")
def date_comparison(spark, sf_dir):
    day, k = F.col("o_orderdate"), F.col("o_orderkey")
    theirs = F.date_format(F.when(k % 7 == 0, F.date_add(day, 1)).otherwise(day), "dd/MM/yyyy")
    raw = cp.compare_date(_choice(k, " soon ", "3.4.2020", "32.13.2020"), _choice(k, "soon", "2020-04-03", "2020-04-03"))
    return _statuses(table(spark, sf_dir, "orders"), "o_orderkey", date=cp.compare_date(F.date_format(day, "yyyy-MM-dd"), theirs), raw=raw)


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'missing_api' WHEN o_orderkey % 5 = 1 THEN 'missing_pdf' WHEN o_orderkey % 5 = 2 THEN 'mismatch' WHEN o_orderkey % 5 = 3 OR o_totalprice <= 10 THEN 'match'
  WHEN abs(o_totalprice * 1.004::DOUBLE - o_totalprice) <= greatest(abs(o_totalprice) * 0.005::DOUBLE, 0.05::DOUBLE) THEN 'match' ELSE 'mismatch' END AS number FROM orders""")
def number_comparison(spark, sf_dir):
    price, k = F.col("o_totalprice"), F.col("o_orderkey")
    text = lambda x: F.format_string("%.2f", x)
    ours = _choice(k, text(price), F.lit(None).cast("string"), F.lit(" "), F.replace(text(price), F.lit("."), F.lit(",")), text(price * 1.004))
    theirs = _choice(k, F.lit(" "), F.lit(None).cast("string"), text(price), text(price), text(price))
    return _statuses(table(spark, sf_dir, "orders"), "o_orderkey", number=cp.compare_value(ours, theirs, "number"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'mismatch' ELSE 'match' END AS held, CASE c_custkey % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'match' WHEN 2 THEN 'mismatch' ELSE 'unknown_code' END AS unit,
  CASE c_custkey % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'match' WHEN 2 THEN 'mismatch' ELSE 'unknown_code' END AS type FROM customer""")
def code_comparison(spark, sf_dir):
    k = F.col("c_custkey")
    held = cp.compare_contains(_choice(k, F.col("c_name"), F.lower("c_name"), F.concat("c_name", F.lit("?"))), F.concat(F.lit("No "), F.replace("c_name", F.lit("#"), F.lit(" # ")), F.lit(" end")))
    unit = cp.COMPARATORS["unit"](_choice(k, "кг / kg", "pcs", "литр", "kg"), _choice(k, "166", "796", "166", "999"))
    type_ = cp.COMPARATORS["contract_type"](_choice(k, "import", " EXPORT ", "import", "import"), _choice(k, "2", "01", "1", "77"))
    return _statuses(table(spark, sf_dir, "customer"), "c_custkey", held=held, unit=unit, type=type_)


@query("""
SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'match' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'missing_pdf' WHEN 3 THEN 'missing_api' ELSE 'mismatch' END AS status,
  CASE s_suppkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 0.5 ELSE 0 END::DOUBLE AS score FROM supplier""")
def bank_comparison(spark, sf_dir):
    k = F.col("s_suppkey")
    account = F.lpad(k.cast("string"), 10, "8")
    theirs = _choice(k, F.concat(F.lit("swift DEUT-DEFF, No "), account), F.concat(F.lit("swift deutdeff "), F.lit("0")), F.lit("x"), F.lit(" "), F.lit("any text"))
    found = cp.compare_bank(_choice(k, "DEUTDEFF", "DEUTDEFF", " ", "DEUTDEFF", "--"), F.when(F.pmod(k, F.lit(5)) < 2, account), theirs)
    return table(spark, sf_dir, "supplier").select("s_suppkey", found["status"].alias("status"), found["score"].alias("score"))


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN contains(regexp_replace(text, '[^0-9]', '', 'g'), CAST(doc_id AS VARCHAR)) ELSE true END AS found,
  contains(regexp_replace(text, '[^0-9]', '', 'g'), '12') AS number FROM documents""")
def values_in_text(spark, sf_dir):
    words = F.split("text", r"\s+")
    value = _choice(F.col("doc_id"), F.lit(None).cast("string"), F.lit("  "), F.array_join(F.slice(words, 1, 3), "  "), F.col("doc_id").cast("string"))
    digits = F.lit(12.0)
    return table(spark, sf_dir, "documents").select("doc_id", cp.in_text(value, "text").alias("found"), cp.number_in_text(digits, "text").alias("number"))


@query("""
SELECT c_custkey, c_custkey % 3 < 2 AS inn, c_custkey % 2 = 0 AS mfo, c_custkey % 3 = 1 AS account, c_custkey % 4 IN (0, 1) AS swift FROM customer""")
def format_checks(spark, sf_dir):
    k = F.col("c_custkey")
    values = {
        "inn": _choice(k, "211 212 877", "211\t212 877", "21121287"),
        "mfo": _choice(k, "01 234", "0123a"),
        "account": _choice(k, "1234 5678", "1234 5678 9012 3456 7890", "x"),
        "swift": _choice(k, "DEUTDEFF", "DEUT DEFF 500", "deutdeff", "DEUTDEF"),
    }
    return table(spark, sf_dir, "customer").select("c_custkey", *[cp.format_ok(v, n).alias(n) for n, v in values.items()])


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'import' WHEN 1 THEN 'export' ELSE 'import' END AS orientation FROM customer")
def orientations(spark, sf_dir):
    k = F.col("c_custkey")
    side = lambda country: F.struct(F.concat(F.lit("Firm "), k.cast("string")).alias("name"), country.alias("country"))
    e = F.struct(side(_choice(k, "Germany", "Узбекистан", "Germany")).alias("seller"), side(_choice(k, "O'zbekiston", "France", "France")).alias("buyer"))
    pairs = table(spark, sf_dir, "customer").select(k.alias("contract_id"), F.parse_json(F.to_json(e)).alias("extracted"), F.parse_json(F.lit('{"contractorForName":"none of them"}')).alias("api"))
    return contracts.orientation_of(pairs).select(F.col("contract_id").alias("c_custkey"), "orientation")


@query("""
SELECT o_orderkey AS contract_id, field, CASE field WHEN 'contract_number' THEN 'N-' || o_orderkey WHEN 'currency' THEN 'USD' WHEN 'payment_currency' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'USD' ELSE 'EUR' END
    WHEN 'FOR.name' THEN 'Seller ' || o_custkey WHEN 'UZ.name' THEN 'Buyer' WHEN 'delivery.place' THEN NULL END AS ours,
  CASE field WHEN 'contract_number' THEN CAST(o_orderkey AS VARCHAR) WHEN 'currency' THEN '840' WHEN 'delivery.place' THEN o_orderpriority END AS theirs
FROM orders, (SELECT unnest(['contract_number', 'currency', 'payment_currency', 'FOR.name', 'UZ.name', 'delivery.place']) AS field)""")
def compared_paths(spark, sf_dir):
    k = F.col("o_orderkey")
    e = F.struct(
        F.concat(F.lit("N-"), k.cast("string")).alias("contract_number"),
        F.lit("USD").alias("currency"),
        F.when(k % 2 == 0, F.lit("  ")).otherwise("EUR").alias("payment_currency"),
        F.struct(F.concat(F.lit("Seller "), F.col("o_custkey").cast("string")).alias("name")).alias("seller"),
        F.struct(F.lit("Buyer").alias("name")).alias("buyer"),
    )
    a = F.struct(k.cast("string").alias("docNo"), F.lit("840").alias("currCode1"), F.array(F.struct(F.col("o_orderpriority").alias("destination"))).alias("deliveryTerms"))
    pairs = table(spark, sf_dir, "orders").select(k.alias("contract_id"), F.parse_json(F.to_json(e)).alias("extracted"), F.parse_json(F.to_json(a)).alias("api"))
    wanted = ("contract_number", "currency", "payment_currency", "FOR.name", "UZ.name", "delivery.place")
    return contracts.field_rows(pairs, F.lit("import")).filter(F.col("field").isin(*wanted)).select("contract_id", "field", "ours", "theirs")


# --- line items, parties, validation ---------------------------------------------------------------------------------


@query("""
SELECT l_orderkey AS contract_id, (row_number() OVER w - 1) // 3 AS s, (row_number() OVER w - 1) % 3 AS g, l_partkey, l_quantity FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity)""")
def flattened_goods(spark, sf_dir):
    good = F.struct("l_linenumber", "l_partkey", "l_quantity")
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(good)).alias("all"))
    n = F.ceil(F.size("all") / 3).cast("int")
    specs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.slice("all", i * 3 + 1, 3).alias("goods")))
    return contracts.goods(per.select(F.col("l_orderkey").alias("contract_id"), specs.alias("specifications"))).select("contract_id", F.col("s").cast("long").alias("s"), F.col("g").cast("long").alias("g"), "l_partkey", "l_quantity")


@query("""
WITH x AS (SELECT DISTINCT l_orderkey, l_linenumber, l_orderkey % 3 AS k, l_linenumber % 2 = 0 AS even FROM lineitem)
SELECT l_orderkey AS contract_id, l_linenumber::BIGINT AS p, 'match' AS name, CASE k WHEN 0 THEN 'missing_pdf' WHEN 1 THEN 'match' ELSE 'mismatch' END AS hs_code, 'match' AS quantity,
  CASE WHEN even THEN 'mismatch' ELSE 'match' END AS amount, CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 'match' ELSE 'unknown_code' END AS unit FROM x""")
def item_fields(spark, sf_dir):
    k, even = F.col("contract_id") % 3, F.col("p") % 2 == 0
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("contract_id"), F.col("l_linenumber").cast("long").alias("p")).agg(F.min("l_quantity").alias("quantity"), F.min("l_extendedprice").alias("amount"))
    hs = F.concat(F.lit("84"), F.col("p").cast("string"))
    ours = li.withColumns({"name": F.lit("Nasos X100"), "hs_code": F.when(k > 0, hs), "price": F.lit(None).cast("double"), "unit": F.when(k > 0, F.lit("kg"))})
    theirs = li.withColumns({"name": F.lit("Насос X100 / Nasos X100"), "hs_code": F.when(k == 2, F.lit("1")).otherwise(hs), "price": F.lit(None).cast("double"), "unit": F.when(k == 2, F.lit("999")).otherwise("166"), "amount": F.when(even, F.col("amount") * 2).otherwise(F.col("amount"))})
    theirs = theirs.withColumnRenamed("p", "g")
    wide = contracts.item_pairs(li.select("contract_id", "p", F.col("p").alias("g")), ours, theirs)
    by = F.map_from_entries(F.transform("fields", lambda f: F.struct(f["field"], f["status"])))
    found = contracts.with_item_fields(wide).withColumn("by", by)
    return found.select("contract_id", "p", *[F.try_element_at("by", F.lit(n)).alias(n) for n in ("name", "hs_code", "quantity", "amount", "unit")])


def _party(**fields) -> Column:
    return F.struct(*[fields.get(n, F.lit(None).cast("string")).alias(n) for n in ("name", "country", "inn")])


@query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '123456789' ELSE NULL END AS seller_inn, CASE c_custkey % 3 WHEN 0 THEN '123456789' WHEN 1 THEN '987654321' ELSE '987654321' END AS buyer_inn FROM customer""")
def reassigned_numbers(spark, sf_dir):
    k = F.col("c_custkey")
    seller = _party(country=_choice(k, "Germany", "Uzbekistan", "Germany"), inn=_choice(k, "123 456 789", "123456789", "123456789"))
    buyer = _party(country=F.lit("Узбекистан"), inn=F.when(k % 3 > 0, "987654321"))
    meta = contracts.reassign_inn(table(spark, sf_dir, "customer").select("c_custkey", seller.alias("seller"), buyer.alias("buyer")))
    return meta.select("c_custkey", F.replace("seller.inn", F.lit(" "), F.lit("")).alias("seller_inn"), F.replace("buyer.inn", F.lit(" "), F.lit("")).alias("buyer_inn"))


@query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN 'Other Works' ELSE c_name END AS receiver, CASE c_custkey % 3 WHEN 2 THEN NULL ELSE '987654321' END AS receiver_inn, 'Seller' AS supplier, '55' AS maker_inn FROM customer""")
def inherited_parties(spark, sf_dir):
    k = F.col("c_custkey")
    meta = table(spark, sf_dir, "customer").select(
        "c_custkey",
        _party(name=F.lit("Seller"), country=F.lit("Germany"), inn=F.lit("55")).alias("seller"),
        _party(name=F.col("c_name"), inn=F.lit("987654321")).alias("buyer"),
        _party(name=_choice(k, F.lit(None).cast("string"), F.col("c_name"), F.lit("Other Works"))).alias("receiver"),
        _party().alias("supplier"),
        _party(name=F.lit("SELLER LLC")).alias("manufacturer"),
    )
    return contracts.inherit_parties(meta).select("c_custkey", F.col("receiver.name").alias("receiver"), F.col("receiver.inn").alias("receiver_inn"), F.col("supplier.name").alias("supplier"), F.col("manufacturer.inn").alias("maker_inn"))


def _extracted(spark, sf_dir) -> DataFrame:
    """Orders as extracted contracts, with their recognised text."""
    line = F.struct("l_linenumber", F.concat(F.lit("item "), F.col("l_partkey").cast("string")).alias("name"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_extendedprice").alias("amount"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("all"))
    o = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    k = F.col("o_orderkey")
    changed = F.transform("all", lambda x: F.struct(x["name"].alias("name"), x["quantity"].alias("quantity"), x["price"].alias("price"), F.when(k % 5 == 0, x["amount"] * 2).otherwise(x["amount"]).alias("amount")))
    nothing = F.lit(None).cast("string")
    bank = F.struct(F.lit("Bank").alias("name"), F.lit("12345").alias("account"), F.lit("01234").alias("mfo"), F.lit("DEUTDEFF").alias("swift"))
    seller = F.struct(F.lit("Alpha Pumps").alias("name"), nothing.alias("country"), nothing.alias("address"), F.when(k % 3 == 0, "12").otherwise("211 212 877").alias("inn"), nothing.alias("director"), F.when(k % 2 == 0, bank).alias("bank"))
    total = F.when(k % 7 > 0, F.aggregate(changed, F.lit(0.0), lambda a, x: a + x["amount"]))
    meta = F.struct(F.concat(F.lit("N-"), k.cast("string")).alias("contract_number"), F.lit("2020-01-01").alias("contract_date"), F.lit("USD").alias("currency"), total.alias("total_amount"), nothing.alias("payment_terms"), seller.alias("seller"), F.when(k < 0, seller).alias("buyer"), F.lit(None).cast("struct<name:string,country:string,address:string,inn:string>").alias("receiver"), F.lit(None).cast("struct<incoterms:string,place:string>").alias("delivery"))
    numbers = F.array_join(F.transform(changed, lambda x: F.concat_ws(" ", x["name"], *[F.format_string("%.2f", x[n]) for n in ("quantity", "price", "amount")])), " ")
    text = F.concat_ws(" ", F.concat(F.lit("n-"), k.cast("string")), F.lit("USD Alpha  Pumps 211 212 877 Bank DEUTDEFF 12345 01234 12"), F.format_string("%.2f", total), numbers)
    return o.select(k.alias("contract_id"), meta.alias("meta"), F.struct(changed.alias("products"), F.lit(None).cast("double").alias("total_amount")).alias("products"), text.alias("plain_text"))


@query("""
WITH n AS (SELECT l_orderkey AS contract_id, count(*) AS items FROM lineitem GROUP BY 1),
f AS (SELECT contract_id, items, contract_id % 7 = 0 AS no_total, contract_id % 3 = 0 AS bad_inn, contract_id % 2 = 0 AS bank, contract_id % 5 = 0 AS bad_rows FROM n JOIN orders ON o_orderkey = contract_id),
-- number, date, currency, name of the seller and the items' names and numbers are high; payment, country, address, director and the buyer are missing
c AS (SELECT contract_id, 4 + CASE WHEN no_total THEN 0 ELSE 1 END + CASE WHEN bad_inn THEN 0 ELSE 1 END + CASE WHEN bank THEN 3 ELSE 0 END + items * CASE WHEN bad_rows THEN 3 ELSE 4 END AS high,
  CASE WHEN bad_rows THEN items ELSE 0 END AS low, CASE WHEN bad_inn THEN 1 ELSE 0 END + CASE WHEN bank THEN 1::BIGINT ELSE 0 END AS failed, 5 + CASE WHEN no_total THEN 1::BIGINT ELSE 0 END AS na,
  1 + CASE WHEN no_total THEN 1::BIGINT ELSE 0 END AS critical_missing FROM f)
SELECT *, CASE WHEN 5 * (failed + critical_missing) <= high + low + failed + critical_missing THEN 'low' ELSE 'failed' END AS overall FROM c""")
def validation_summaries(spark, sf_dir):
    return contracts.overall_confidence(contracts.validate_contracts(_extracted(spark, sf_dir)))


@query("""
WITH s AS (SELECT l_orderkey AS contract_id, sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CASE WHEN l_orderkey % 5 = 0 THEN 2 ELSE 1 END) AS line_sum FROM lineitem GROUP BY 1)
SELECT contract_id, CAST(line_sum AS DOUBLE) AS line_sum, contract_id % 5 <> 0 AS rows_ok, CASE WHEN contract_id % 7 > 0 THEN true END AS total_ok FROM s JOIN orders ON o_orderkey = contract_id""")
def arithmetic_checks(spark, sf_dir):
    return contracts.arithmetic(_extracted(spark, sf_dir)).select("contract_id", F.round("line_sum", 2).alias("line_sum"), "rows_ok", "total_ok")


# --- documents and pages ---------------------------------------------------------------------------------------------


@query("""
WITH b AS (SELECT doc_id, doc_id % 11 AS doc, doc_id % 3 + 1 AS page, ['Text', 'Form', 'Picture', 'SectionHeader', 'PageFooter', 'Odd'][doc_id % 6 + 1] AS label, doc_id % 17 = 0 AS skipped FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY doc_id) - 1 AS pos FROM b WHERE label <> 'Picture' AND NOT skipped)
SELECT doc_id, pos, CASE label WHEN 'Form' THEN 'table' WHEN 'SectionHeader' THEN 'section-header' ELSE 'text' END AS kind FROM k WHERE label <> 'PageFooter'""")
def page_blocks(spark, sf_dir):
    k = F.col("doc_id")
    raw = table(spark, sf_dir, "documents").select(k, (k % 11).cast("string").alias("doc"), (k % 3 + 1).alias("page_no"), k.alias("reading_order"), _choice(k, "Text", "Form", "Picture", "SectionHeader", "PageFooter", "Odd").alias("label"), (k % 17 == 0).alias("skipped"), F.lit(None).cast("boolean").alias("error"))
    blocks = readers.recognised_blocks(raw.withColumnRenamed("doc_id", "id").withColumnRenamed("doc", "doc_id"))
    return documents.kept_blocks(blocks).select(F.col("id").alias("doc_id"), F.col("pos").cast("long").alias("pos"), "kind")


# --- stores, sessions, prompts ---------------------------------------------------------------------------------------


@query("""
SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE doc_id % 3 WHEN 0 THEN 'indexed' WHEN 1 THEN 'failed' ELSE 'new' END AS status, CASE doc_id % 3 WHEN 0 THEN CAST(doc_id % 50 AS BIGINT) END AS chunk_count,
  CASE doc_id % 3 WHEN 1 THEN left(repeat('e' || doc_id, 400), 1000) END AS last_error FROM documents""")
def marked_catalogue(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    key, k = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    fresh = catalog.check_and_update(spark.createDataFrame([], catalog.COLUMNS), d.select(key.alias("document_id"), F.col("text").alias("html")))
    results = d.filter("doc_id % 3 < 2").select(key.alias("document_id"), F.when(k == 0, F.col("doc_id") % 50).cast("int").alias("chunk_count"), F.when(k == 1, F.repeat(F.concat(F.lit("e"), key), F.lit(400))).alias("error"))
    return catalog.mark(fresh.drop("outcome"), results).select("document_id", "status", F.col("chunk_count").cast("long").alias("chunk_count"), "last_error")


@query("""
WITH old AS (SELECT doc_id AS chunk_id, doc_id % 20 AS document_id, 'old' AS v FROM documents WHERE doc_id % 3 > 0), new AS (SELECT doc_id AS chunk_id, doc_id % 20 AS document_id, 'new' AS v FROM documents WHERE doc_id % 4 = 0)
SELECT 'upsert' AS how, v, count(*) AS n FROM (SELECT v FROM new UNION ALL SELECT v FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM new)) GROUP BY v
UNION ALL SELECT 'replace', v, count(*) FROM (SELECT v FROM new UNION ALL SELECT v FROM old WHERE document_id NOT IN (SELECT document_id FROM new)) GROUP BY v""")
def chunk_stores(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 20).alias("document_id"))
    old, new = (d.filter(where).withColumn("v", F.lit(v)) for where, v in (("chunk_id % 3 > 0", "old"), ("chunk_id % 4 = 0", "new")))
    each = [after.select(F.lit(how).alias("how"), "v") for how, after in (("upsert", catalog.upsert_chunks(old, new)), ("replace", catalog.replace_documents(old, new)))]
    return each[0].unionByName(each[1]).groupBy("how", "v").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS message_count FROM events GROUP BY user_id")
def merged_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    before, after = (sessions.touch(e.filter(where), at="ts") for where in ("event_id % 2 = 0", "event_id % 2 = 1"))
    return sessions.merge_sessions(before, after)


@query("""
SELECT user_id, count(*) AS messages, max(event_id) AS last_id, max(ts) AS last_seen_at, count(*) AS message_count FROM events GROUP BY user_id""")
def logged_messages(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("question"), F.lit("a").alias("answer"), F.col("ts").alias("created_at"))
    old, new = e.filter("id % 3 = 0"), e.filter("id % 3 > 0")
    messages, known = sessions.log_messages(old, sessions.touch(old), new)
    held = messages.groupBy("user_id").agg(F.count(F.lit(1)).alias("messages"), F.max("id").alias("last_id"))
    return held.join(known, "user_id").select("user_id", "messages", "last_id", "last_seen_at", "message_count")


@query("SELECT user_id, count(*) AS n, CASE WHEN user_id % 4 = 0 THEN 'deleted' ELSE 'left' END AS what FROM events GROUP BY user_id")
def cleared_history(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left, deleted = sessions.clear_history(e, e.filter("user_id % 4 = 0").select("user_id").distinct())
    left = left.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("left"))
    return left.unionByName(deleted.select("user_id", F.col("deleted").alias("n"), F.lit("deleted").alias("what")))


@query("""
WITH c AS (SELECT c_custkey, substr(md5(CAST(c_custkey AS VARCHAR)), 1, 32) AS h FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) END AS user_id, c_custkey % 3 = 2 AS is_new FROM c""")
def resolved_sessions(spark, sf_dir):
    h = F.md5(F.col("c_custkey").cast("string").cast("binary"))
    header = _choice(F.col("c_custkey"), F.concat(F.lit("{"), F.upper(h), F.lit("}")), F.lit("not one"), F.lit(None).cast("string"))
    cookie = _choice(F.col("c_custkey"), F.lit("x"), h, F.lit(""))
    s = table(spark, sf_dir, "customer").select("c_custkey", nz.resolve_session(header, cookie).alias("s"))
    return s.select("c_custkey", F.when(~F.col("s.is_new"), F.col("s.user_id")).alias("user_id"), "s.is_new")


@query("""
WITH p AS (SELECT conv_id, turn, text AS q, lead(text) OVER w AS a, role, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM p WHERE role = 'user' AND next_role = 'assistant' AND trim(q) <> '' AND trim(a) <> ''),
m AS (SELECT conv_id, string_agg('user=' || q || chr(10) || 'assistant=' || a, chr(10) ORDER BY turn) AS said FROM t WHERE back <= 3 GROUP BY 1)
SELECT conv_id, 'system=S' || chr(10) || said || chr(10) || 'user=[KONTEKST]' || chr(10) || 'C' || chr(10) || chr(10) || '[SAVOL]' || chr(10) || 'Q' AS messages FROM m""")
def prompt_messages(spark, sf_dir):
    pairs = sessions.turn_pairs(table(spark, sf_dir, "conversations"))
    turns = pairs.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "question", "answer"))), lambda t: F.struct(t["question"].alias("question"), t["answer"].alias("answer"))).alias("turns"))
    turns = turns.filter(F.exists("turns", lambda t: ~nz.is_blank(t["question"]) & ~nz.is_blank(t["answer"])))
    made = retrieve.prompt_messages(F.lit("Q"), F.lit("C"), F.col("turns"), "S")
    return turns.select("conv_id", F.array_join(F.transform(made, lambda m: F.concat_ws("=", m["role"], m["content"])), "\n").alias("messages"))
