"""Contract operators: repair of extracted records, field and line-item comparison, validation."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import compare as cp
from ..functions import fixed, fuzzy
from ..functions import normalize as nz

FLOOR, ACCEPT, HS_BONUS, QTY_BONUS, RELAXED = 0.45, 0.6, 0.3, 0.2, 0.7

ITEM_COLUMNS = ["name", "hs_code", "quantity", "price", "amount", "unit"]

#: (extracted path, API path, kind); FOR and UZ stand for the foreign and the domestic party.
FIELDS = [
    ("contract_number", "docNo", "id"),
    ("contract_date", "docDate", "date"),
    ("currency", "currCode1", "currency"),
    ("total_amount", "amount1", "number"),
    ("FOR.name", "contractorForName", "text"),
    ("FOR.country", "contractorForCountryCode", "country"),
    ("FOR.address", "contractorForAddress", "address"),
    ("FOR.bank.name", "bankForName", "text"),
    ("UZ.name", "contractorUzName", "text"),
    ("UZ.inn", "contractorUzInn", "id"),
    ("UZ.address", "contractorUzAddress", "address"),
    ("delivery.place", "deliveryTerms.0.destination", "text"),
    ("delivery.incoterms", "deliveryTerms.0.incotermsCode", "incoterms"),
    ("payment_currency", "accCurrCode1", "currency"),
    ("receiver.name", "consignees.0.name", "text"),
    ("receiver.country", "consignees.0.countryCode", "country"),
    ("receiver.inn", "consignees.0.inn", "id"),
    ("supplier.name", "consignors.0.name", "text"),
    ("supplier.country", "consignors.0.countryCode", "country"),
    ("supplier.inn", "consignors.0.inn", "id"),
    ("manufacturer.name", "manufacturers.0.name", "text"),
    ("manufacturer.country", "manufacturers.0.countryCode", "country"),
    ("manufacturer.inn", "manufacturers.0.inn", "id"),
    ("specification_number", "specifications.0.docNo", "id"),
    ("payment_deadline", "importTerms.0.paymentDeadline", "id"),
]
ORIENTATION_FIELDS = ("FOR.name", "FOR.country", "UZ.name", "UZ.inn")


def get_path(value: Column, path: str) -> Column:
    """A dotted path into a VARIANT; names and array positions; anything missing is null, never an error."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split("."))
    return F.try_variant_get(value, f"${steps}", "string")


def flatten_extracted(extracted: DataFrame) -> DataFrame:
    """meta.* and the products, as one row a contract."""
    return extracted.select(*[c for c in extracted.columns if c not in ("meta", "products")], "meta.*", F.col("products.products").alias("products"), F.col("products.total_amount").alias("products_total"))


def field_rows(pairs: DataFrame, orientation: Column, kinds: tuple[str, ...] = tuple(cp.COMPARATORS)) -> DataFrame:
    """contract_id, extracted and api (VARIANT) -> a row for each compared field of these kinds: field, api_field, kind, ours, theirs.

    One literal list drives the unpivot; receivers are left out for contract types without one.
    """
    type_code = nz.zfill(F.coalesce(nz.strip(get_path(F.col("api"), "cntrType")), F.lit("")), 2)
    buyer_is_foreign = orientation == "export"

    def ours(path: str) -> Column:
        if path.startswith(("FOR.", "UZ.")):
            side, rest = path.split(".", 1)
            as_seller, as_buyer = get_path(F.col("extracted"), f"seller.{rest}"), get_path(F.col("extracted"), f"buyer.{rest}")
            return F.when(buyer_is_foreign == F.lit(side == "FOR"), as_buyer).otherwise(as_seller)
        value = get_path(F.col("extracted"), path)
        return F.coalesce(F.when(~nz.is_blank(value), value), get_path(F.col("extracted"), "currency")) if path == "payment_currency" else value

    rows = [F.struct(F.lit(p).alias("field"), F.lit(a).alias("api_field"), F.lit(k).alias("kind"), ours(p).alias("ours"), get_path(F.col("api"), a).alias("theirs")) for p, a, k in FIELDS if k in kinds]
    if "contract_type" in kinds:
        rows.append(F.struct(F.lit("contract_type").alias("field"), F.lit("cntrType").alias("api_field"), F.lit("contract_type").alias("kind"), orientation.alias("ours"), get_path(F.col("api"), "cntrType").alias("theirs")))
    out = pairs.select("contract_id", type_code.alias("type_code"), orientation.alias("orientation"), F.explode(F.array(*rows)).alias("x")).select("contract_id", "type_code", "orientation", "x.*")
    return out.filter(~(F.col("field").startswith("receiver.") & F.col("type_code").isin(fixed.NO_RECEIVER_TYPES))).drop("type_code")


def compared(rows: DataFrame, kinds: tuple[str, ...] = tuple(cp.COMPARATORS)) -> DataFrame:
    result = cp.compare_value("ours", "theirs", F.col("kind"), kinds)
    return rows.withColumn("result", result).select(*rows.columns, "result.status", "result.score")


def bank_rows(pairs: DataFrame, orientation: Column) -> DataFrame:
    """The foreign bank's code and account against their free text."""
    side = F.when(orientation == "export", F.lit("buyer")).otherwise(F.lit("seller"))

    def bank(name: str) -> Column:
        return F.when(side == "buyer", get_path(F.col("extracted"), f"buyer.bank.{name}")).otherwise(get_path(F.col("extracted"), f"seller.bank.{name}"))

    api = get_path(F.col("api"), "bankForAttributes")
    found = cp.compare_bank(bank("swift"), bank("account"), api)
    return pairs.select("contract_id", orientation.alias("orientation"), F.lit("FOR.bank.attributes").alias("field"), F.lit("bankForAttributes").alias("api_field"), F.lit("bank").alias("kind"), cp.bank_display(bank("swift"), bank("account")).alias("ours"), api.alias("theirs"), found["status"].alias("status"), found["score"].alias("score"))


def orientation_of(pairs: DataFrame) -> DataFrame:
    """contract_id, orientation: by which party is domestic; else by the scores of four fields, ties to import."""
    def domestic(side: str) -> Column:
        country = get_path(F.col("extracted"), f"{side}.country")
        return F.when(~nz.is_blank(country), cp.country_matches(country, F.lit(fixed.DOMESTIC)))

    seller, buyer = domestic("seller"), domestic("buyer")
    known = F.when(seller & ~F.coalesce(buyer, F.lit(False)), "export").when(buyer & ~F.coalesce(seller, F.lit(False)), "import")
    decided = pairs.withColumn("known", known)
    open_ = decided.filter("known IS NULL").withColumn("guess", F.explode(F.array(F.lit("import"), F.lit("export"))))
    kinds = tuple(dict.fromkeys(k for path, _, k in FIELDS if path in ORIENTATION_FIELDS))
    scored = compared(field_rows(open_, F.col("guess"), kinds).filter(F.col("field").isin(*ORIENTATION_FIELDS)), kinds)
    sums = scored.groupBy("contract_id", "orientation").agg(F.sum("score").alias("score"))
    best = sums.groupBy("contract_id").agg(F.max_by("orientation", F.struct("score", "orientation")).alias("orientation"))  # "import" sorts after "export"
    return decided.filter("known IS NOT NULL").select("contract_id", F.col("known").alias("orientation")).unionByName(best)


def compare_contracts(pairs: DataFrame, confidence: DataFrame | None = None) -> DataFrame:
    """All compared fields of all contracts, with the validation's confidence of ours where given. Fields whose comparators
    need Python are a branch of their own, so no other field is sent there; each path is read in one branch only."""
    sided = pairs.join(orientation_of(pairs), "contract_id")
    native = tuple(k for k in cp.COMPARATORS if k not in cp.PYTHON_KINDS)
    rows = bank_rows(sided, F.col("orientation"))
    for kinds in (native, cp.PYTHON_KINDS):
        rows = rows.unionByName(compared(field_rows(sided, F.col("orientation"), kinds), kinds))
    if confidence is not None:
        seller_is = F.when(F.col("orientation") == "export", F.lit("buyer.")).otherwise(F.lit("seller."))
        buyer_is = F.when(F.col("orientation") == "export", F.lit("seller.")).otherwise(F.lit("buyer."))
        path = F.when(F.col("field").startswith("FOR."), F.concat(seller_is, F.substring("field", 5, 200))).when(F.col("field").startswith("UZ."), F.concat(buyer_is, F.substring("field", 4, 200))).otherwise(F.col("field"))
        rows = rows.withColumn("path", path).join(confidence.select("contract_id", "path", F.col("confidence").alias("ocr_confidence")), ["contract_id", "path"], "left").drop("path")
    return rows


def counts(rows: DataFrame, by: str = "contract_id") -> DataFrame:
    return rows.groupBy(by).agg(F.count_if(F.col("status") == "match").alias("matched"), F.count_if(F.col("status") == "mismatch").alias("mismatched"), F.count(F.lit(1)).alias("total_compared"))


# --- line items ----------------------------------------------------------------------------------------------------


def goods(api: DataFrame) -> DataFrame:
    """Goods of all specifications, in order."""
    specs = api.select("contract_id", F.posexplode("specifications").alias("s", "spec"))
    return specs.select("contract_id", "s", F.posexplode("spec.goods").alias("g", "good")).select("contract_id", "s", "g", "good.*")


def name_score(norm_ours: str, norm_names: list[str]) -> float:
    return max((max(fuzzy.token_sort_ratio(norm_ours, n), fuzzy.token_set_ratio(norm_ours, n)) for n in norm_names), default=0.0) / 100


def _greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of contracts, one contract after the other: its products (p alone), its goods (g alone), then scored candidates by
    p and g -> the pairs taken and what is left on either side. Products take their best free good in order (the first of
    equal ones). Only the present contract is held."""
    names = ["contract_id", "p", "g", "score"]

    def settled(contract: int, products: list[int], goods_: list[int], candidates: dict[int, list[tuple[int, float]]]) -> Iterator[tuple]:
        free = dict.fromkeys(goods_)
        for p in products:
            open_ = [(g, s) for g, s in candidates.get(p, ()) if g in free]
            g, score = max(open_, key=lambda x: x[1], default=(None, 0.0))
            taken = score >= ACCEPT
            if taken:
                del free[g]
            yield (contract, p, g, score) if taken else (contract, p, None, None)
        yield from ((contract, None, g, None) for g in free)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names).astype(object)
        return out.astype({"contract_id": "int64", "p": "Int64", "g": "Int64", "score": "Float64"})

    present, products, goods_, candidates = None, [], [], {}
    for rows in batches:
        out: list[tuple] = []
        for c, side, p, g, s in zip(rows["contract_id"], rows["side"], rows["p"].array, rows["g"].array, rows["score"], strict=True):
            if c != present:
                if present is not None:
                    out += settled(present, products, goods_, candidates)
                present, products, goods_, candidates = c, [], [], {}
            if side == 0:
                products.append(int(p))
            elif side == 1:
                goods_.append(int(g))
            else:
                candidates.setdefault(int(p), []).append((int(g), s))
        yield frame(out)
    if present is not None:
        yield frame(list(settled(present, products, goods_, candidates)))


@lru_cache(fuzzy.REMEMBERED)
def _lines_score(ours: str, lines: str) -> float:
    return name_score(ours, lines.split("\n"))


@F.pandas_udf(T.DoubleType())
def _name_scores(ours: pd.Series, names: pd.Series) -> pd.Series:
    """``names``: normalised names, which hold no line ends, one a line."""
    return pd.Series([_lines_score(o, n) for o, n in zip(ours, names, strict=True)], dtype="float64")


def match_products(products: DataFrame, goods_: DataFrame) -> DataFrame:
    """products (contract_id, p, name, hs_code, quantity, ...) and goods (contract_id, g, name, hs_code, quantity, ...)
    -> contract_id, p, g, score for matches, unmatched ones with a null on the other side.

    Candidates are an equi join on the contract and scored in the JVM and one vectorised function; only the greedy choice,
    which depends on order, runs by contract, in one pass over items of both sides and pairs that passed the floor.
    """
    a = products.select("contract_id", "p", nz.norm_text("name").alias("norm"), F.col("hs_code").alias("hs"), F.col("quantity").alias("qty"))
    a = a.withColumn("keys", nz.digit_tokens("norm"))
    b = goods_.select("contract_id", "g", F.transform(nz.split_bilingual("name"), nz.norm_text).alias("each"), F.col("hs_code").alias("g_hs"), F.col("quantity").alias("g_qty"))
    b = b.withColumns({"norms": F.array_join("each", "\n"), "g_keys": nz.digit_tokens(F.get("each", F.lit(0)))}).drop("each")
    pairs = a.join(b, "contract_id").filter((F.size("keys") == 0) | (F.size("g_keys") == 0) | F.arrays_overlap("keys", "g_keys"))
    name = _name_scores(F.coalesce("norm", F.lit("")), "norms")
    pairs = pairs.withColumn("name_score", name).filter(F.col("name_score") >= FLOOR)
    hs = F.when((F.coalesce("hs", F.lit("")) != "") & (F.col("hs") == F.col("g_hs")), HS_BONUS).otherwise(0.0)
    qty = F.when(F.abs(F.col("qty") - F.col("g_qty")) <= F.abs("g_qty") * 0.001, QTY_BONUS).otherwise(0.0)

    def side(df: DataFrame, number: int, **known) -> DataFrame:
        given = {"p": F.lit(None).cast("bigint"), "g": F.lit(None).cast("bigint"), "score": F.lit(None).cast("double")} | known
        return df.select(F.col("contract_id").cast("bigint").alias("contract_id"), F.lit(number).alias("side"), *[c.alias(n) for n, c in given.items()])

    p, g = F.col("p").cast("bigint"), F.col("g").cast("bigint")
    everything = side(products, 0, p=p).unionByName(side(goods_, 1, g=g)).unionByName(side(pairs, 2, p=p, g=g, score=F.col("name_score") + hs + qty))
    return everything.repartition("contract_id").sortWithinPartitions("contract_id", "side", "p", "g").mapInPandas(_greedy, "contract_id bigint, p bigint, g bigint, score double")


def with_item_fields(wide: DataFrame) -> DataFrame:
    """Items beside their goods (name, hs_code, quantity, price, amount, unit and g_*, as ``item_pairs`` gives them) -> also
    ``fields``: field, ours, theirs, status, score of each compared field; none for items without a partner. Columns of
    numbers are compared as they are, texts are read as amounts first."""
    types = dict(wide.dtypes)

    def number(name: str) -> Column:
        return nz.normalize_amount(name) if types[name] == "string" else F.col(name).cast("double")

    def status_of(n: str, result: Column) -> Column:
        ours, theirs = nz.is_blank(F.col(n).cast("string")), nz.is_blank(F.col(f"g_{n}").cast("string"))
        if n == "name":
            relaxed = (result["status"] == "mismatch") & (F.col("name_score") >= RELAXED)
            return F.when(ours | theirs, "missing_pdf").when(relaxed, "match").otherwise(result["status"])
        if n == "hs_code":
            return F.when(ours, "missing_pdf").when(theirs, "mismatch").otherwise(result["status"])
        if n == "unit":
            return F.when(theirs, "unknown_code").otherwise(result["status"])
        return F.when(ours | theirs, "mismatch").otherwise(result["status"])  # a number on one side alone differs, unlike in the fields of contracts

    results = {n: cp.compare_amounts(number(n), number(f"g_{n}")) for n in ("quantity", "price", "amount")}
    results |= {"name": cp.compare_text("name", "g_name"), "hs_code": cp.compare_id("hs_code", "g_hs_code"), "unit": cp.COMPARATORS["unit"]("unit", "g_unit")}
    fields = [F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("ours"), F.col(f"g_{n}").cast("string").alias("theirs"), status_of(n, results[n]).alias("status"), results[n]["score"].cast("double").alias("score")) for n in ITEM_COLUMNS]
    some = F.filter(F.array(*fields), lambda f: ~((f["field"] == "unit") & nz.is_blank(f["ours"])))
    return wide.withColumn("fields", F.when(F.col("p").isNotNull() & F.col("g").isNotNull(), some).otherwise(F.filter(some, lambda f: F.lit(False))))


def compare_items(wide: DataFrame) -> DataFrame:
    """A row for each compared field of items with a partner."""
    return with_item_fields(wide).select("contract_id", "p", "g", "name_score", F.explode("fields").alias("x")).select("contract_id", "p", "g", "name_score", "x.*")


def item_pairs(matches: DataFrame, products: DataFrame, goods_: DataFrame) -> DataFrame:
    """All matches and items left over, with the columns of both sides (those of goods as g_*) and the score of their names."""
    ours = products.select("contract_id", F.col("p").cast("bigint").alias("p"), *ITEM_COLUMNS)
    theirs = goods_.select("contract_id", F.col("g").cast("bigint").alias("g"), *[F.col(c).alias(f"g_{c}") for c in ITEM_COLUMNS])
    both = matches.select("contract_id", "p", "g").join(ours, ["contract_id", "p"], "left").join(theirs, ["contract_id", "g"], "left")
    names = F.array_join(F.transform(nz.split_bilingual("g_name"), nz.norm_text), "\n")
    return both.withColumn("name_score", _name_scores(F.coalesce(nz.norm_text("name"), F.lit("")), names))


def product_issues(wide: DataFrame) -> DataFrame:
    """For each contract the fields of matched items that differ, items without a partner on either side, and their sum; one
    pass over ``item_pairs``."""
    each = with_item_fields(wide).select("contract_id", F.col("g").isNull().alias("no_g"), F.col("p").isNull().alias("no_p"), F.size(F.filter("fields", lambda f: f["status"] == "mismatch")).alias("n"))
    out = each.groupBy("contract_id").agg(F.count_if("no_g").alias("unmatched_pdf"), F.count_if("no_p").alias("unmatched_api"), F.sum("n").alias("differing"))
    return out.withColumn("product_issues", F.col("differing") + F.col("unmatched_pdf") + F.col("unmatched_api"))


def product_totals(products: DataFrame, goods_: DataFrame) -> DataFrame:
    """Sums of the amounts on both sides, missing amounts as nothing; missing only where a side has no items at all."""
    def summed(items: DataFrame, name: str) -> DataFrame:
        return items.groupBy("contract_id").agg(F.coalesce(F.round(F.sum("amount"), 2).cast("double"), F.lit(0.0)).alias(name))

    both = summed(products, "pdf_sum").join(summed(goods_, "api_sum"), "contract_id", "full_outer")
    status = F.when(F.col("pdf_sum").isNull() | F.col("api_sum").isNull(), "missing").when(cp.numbers_equal("pdf_sum", "api_sum"), "match").otherwise("mismatch")
    return both.withColumn("status", status).fillna(0.0, ["pdf_sum", "api_sum"])


def result_records(fields: DataFrame, wide: DataFrame, totals: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """One record a contract: orientation, fields (by name), rows (items with their goods and compared fields), unmatched_api,
    totals, and confidence (counts of the comparison and, where given, the validation's summary)."""
    item = lambda prefix: F.struct(*[F.col(prefix + c).alias(c) for c in ITEM_COLUMNS])
    entry = F.struct("ours", "theirs", "api_field", "status", "score")
    by_field = fields.groupBy("contract_id").agg(
        F.first("orientation").alias("orientation"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("field"), entry.alias("entry"))))).alias("fields"),
        F.count_if(F.col("status") == "match").alias("matched"),
        F.count_if(F.col("status") == "mismatch").alias("mismatched"),
        F.count(F.lit(1)).alias("total_compared"),
    )
    detailed = with_item_fields(wide)
    row = F.struct("p", "g", item("").alias("pdf"), F.when(F.col("g").isNotNull(), item("g_")).alias("api"), "fields")
    items = detailed.groupBy("contract_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), row))).alias("rows"),
        F.array_sort(F.collect_list(F.when(F.col("p").isNull(), F.struct("g", item("g_").alias("api"))))).alias("unmatched_api"),
        (F.sum(F.size(F.filter("fields", lambda f: f["status"] == "mismatch"))) + F.count_if(F.col("g").isNull() | F.col("p").isNull())).alias("product_issues"),
    )
    sums = totals.select("contract_id", F.struct("pdf_sum", "api_sum", "status").alias("totals"))
    out = by_field.join(items, "contract_id", "left").join(sums, "contract_id", "left")
    counts_ = [F.col(c) for c in ("matched", "mismatched", "total_compared")] + [F.coalesce("product_issues", F.lit(0)).alias("product_issues")]
    if summaries is not None:
        out = out.join(summaries.select("contract_id", F.struct(*[c for c in summaries.columns if c != "contract_id"]).alias("validation")), "contract_id", "left")
        counts_.append(F.col("validation"))
    return out.select("contract_id", "orientation", "fields", "rows", "unmatched_api", "totals", F.struct(*counts_).alias("confidence"))


def drop_total_rows(products: DataFrame, place: Sequence[str] = ("p",)) -> DataFrame:
    """contract_id, p, name, quantity, price, amount, total_amount: rows that are totals go; the first amount of one fills a
    missing total. ``place`` names the columns that give the order; rows without a contract fill nothing."""
    is_total = F.coalesce(nz.strip("name"), F.lit("")).rlike(fixed.TOTAL_ROW) & (F.col("quantity").isNull() | F.col("price").isNull())
    amounts = F.when(is_total & F.col("amount").isNotNull() & F.col("contract_id").isNotNull(), F.struct(*place))
    first = F.min_by("amount", amounts).over(Window.partitionBy("contract_id"))
    return products.withColumn("total_amount", F.coalesce("total_amount", first)).filter(~is_total)


def _merge_languages(rows: pd.DataFrame) -> pd.DataFrame:
    """One contract's products in order; a row that repeats an earlier one in the other script only extends its name."""
    def numbers(name) -> frozenset:
        return frozenset(re.findall(r"\d+", name or ""))

    def cyrillic(name) -> bool:
        letters = [c for c in name or "" if c.isalpha()]
        return bool(letters) and sum("Ѐ" <= c <= "ӿ" for c in letters) / len(letters) >= 0.5

    def same(x, y) -> bool:
        return x == y or (pd.isna(x) and pd.isna(y))

    kept: list[dict] = []
    for row in rows.sort_values("p").to_dict("records"):
        empty = all(pd.isna(row[c]) for c in ("quantity", "price", "amount"))
        for other in kept:
            agree = empty or ((row["hs_code"] or "") == (other["hs_code"] or "") and all(same(row[c], other[c]) for c in ("quantity", "price", "amount")))
            if agree and numbers(row["name"]) == numbers(other["name"]) and cyrillic(row["name"]) != cyrillic(other["name"]):
                if row["name"] and other["name"] and row["name"] not in other["name"]:
                    other["name"] = f"{other['name']} / {row['name']}"
                break
        else:
            kept.append(row)
    return pd.DataFrame(kept, columns=rows.columns)


def merge_bilingual(products: DataFrame) -> DataFrame:
    return products.groupBy("contract_id").applyInPandas(_merge_languages, products.schema)


# --- repair of parties ---------------------------------------------------------------------------------------------


def reassign_inn(meta: DataFrame) -> DataFrame:
    """A nine-digit number of a foreign party is the other's: it is taken away, and given to the other if that has none."""
    def domestic_inn(p: str) -> Column:
        return F.coalesce(F.regexp_replace(F.col(f"{p}.inn"), " ", "").rlike("^[0-9]{9}$"), F.lit(False))

    def foreign(p: str) -> Column:
        return ~nz.is_blank(F.col(f"{p}.country")) & ~F.coalesce(cp.country_matches(F.col(f"{p}.country"), F.lit(fixed.DOMESTIC)), F.lit(False))

    for party, other in (("seller", "buyer"), ("buyer", "seller")):
        wrong = foreign(party) & domestic_inn(party)
        given = F.when(wrong & nz.is_blank(F.col(f"{other}.inn")) & ~foreign(other), F.col(f"{party}.inn")).otherwise(F.col(f"{other}.inn"))
        meta = meta.withColumns({other: F.col(other).withField("inn", given), party: F.when(wrong, F.col(party).withField("inn", F.lit(None).cast("string"))).otherwise(F.col(party))})
    return meta


def inherit_parties(meta: DataFrame) -> DataFrame:
    """Receiver from the buyer, supplier and manufacturer from the seller: all of it, or only the number of the same company."""
    for third, party in (("receiver", "buyer"), ("supplier", "seller"), ("manufacturer", "seller")):
        bare = nz.is_blank(F.col(f"{third}.inn")) & nz.is_blank(F.col(f"{third}.name"))
        same = nz.is_blank(F.col(f"{third}.inn")) & cp.same_company(F.col(f"{third}.name"), F.col(f"{party}.name"))
        whole = F.col(third).withField("name", F.col(f"{party}.name")).withField("country", F.col(f"{party}.country")).withField("inn", F.col(f"{party}.inn"))
        meta = meta.withColumn(third, F.when(bare, whole).when(same, F.col(third).withField("inn", F.col(f"{party}.inn"))).otherwise(F.col(third)))
    return meta


# --- validation ----------------------------------------------------------------------------------------------------


def validate_fields(rows: DataFrame) -> DataFrame:
    """contract_id, path, value, required, format (or null), in_text (or null), wrong (optional: the name of a failed sum, or
    null) -> confidence and issues. A value that was not found is neutral, required or not; the form is judged without white
    space; a failed sum lowers the confidence to low."""
    formats = reduce(lambda x, k: x.when(F.col("format") == k, cp.format_ok("value", k)), cp.FORMATS, F.when(F.col("format").isNull(), F.lit(True)))
    none, absent = F.col("value").isNull(), F.col("in_text") == F.lit(False)
    wrong = F.col("wrong") if "wrong" in rows.columns else F.lit(None).cast("string")
    confidence = F.when(none, "na").when(wrong.isNotNull(), "low").when(~formats, "failed").when(absent, "low").otherwise("high")
    issues = F.when(none, F.array(F.lit("missing"))).otherwise(F.array_compact(F.array(F.when(~formats, "format"), F.when(absent, "not_in_text"), wrong)))
    return rows.withColumns({"confidence": confidence, "issues": issues})


def overall_confidence(rows: DataFrame, by: str = "contract_id") -> DataFrame:
    """Counts of confidences and the overall one. Required fields that were not found are neutral ones, counted again on their own."""
    found = rows.groupBy(by).agg(
        *[F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "low", "failed", "na")],
        F.count_if((F.col("confidence") == "na") & F.col("required")).alias("critical_missing"),
    )
    n = F.greatest(F.col("high") + F.col("low") + F.col("failed") + F.col("critical_missing"), F.lit(1))
    bad = F.col("failed") + F.col("critical_missing")
    return found.withColumn("overall", F.when((bad == 0) & (F.col("low") / n <= 0.1), "high").when(bad / n <= 0.2, "low").otherwise("failed"))


def _checked(path, value: Column, required: bool = False, form: str | None = None, skip: bool = False, number: bool = False, wrong: Column | None = None) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(
        nz.col(path if isinstance(path, Column) else F.lit(path)).alias("path"),
        value.cast("string").alias("value"),
        (value.cast("double") if number else F.lit(None).cast("double")).alias("number"),
        F.lit(required).alias("required"),
        (nothing if form is None else F.lit(form)).alias("format"),
        F.lit(skip).alias("skip"),
        (nothing if wrong is None else wrong).alias("wrong"),
    )


def arithmetic(extracted: DataFrame) -> DataFrame:
    """extracted (contract_id, meta, products) with row_wrong (for each product whether quantity times price is not its
    amount), rows_ok, line_sum (missing amounts as nothing) and total_ok (null without products or totals)."""
    lines = F.when(F.col("products.products").isNotNull(), F.col("products.products")).otherwise(F.array().cast(extracted.select("products.products").schema[0].dataType))
    totals = F.array_compact(F.array(F.col("products.total_amount"), F.col("meta.total_amount")))
    out = extracted.withColumn("lines", lines).withColumns(
        {
            "row_wrong": F.transform("lines", lambda x: F.coalesce(~cp.close(x["quantity"] * x["price"], x["amount"]), F.lit(False))),
            "line_sum": F.aggregate("lines", F.lit(0.0), lambda a, x: a + F.coalesce(x["amount"].cast("double"), F.lit(0.0))),
            "totals": totals,
        }
    )
    near = F.exists("totals", lambda t: cp.close(F.col("line_sum"), t))
    return out.withColumns({"rows_ok": ~F.exists("row_wrong", lambda x: x), "total_ok": F.when((F.size("lines") > 0) & (F.size("totals") > 0), near)})


def validate_contracts(extracted: DataFrame, text_col: str = "plain_text") -> DataFrame:
    """extracted: contract_id, meta, products and the recognised text -> a row for each field of each contract: path, value,
    confidence, issues, required. Parties that are missing are one field; banks, receivers and terms that are missing are none."""
    m = F.col("meta")

    def party(role: str) -> Column:
        x, bank = m[role], m[role]["bank"]
        own = [_checked(f"{role}.name", x["name"], True), _checked(f"{role}.country", x["country"]), _checked(f"{role}.address", x["address"]), _checked(f"{role}.inn", x["inn"], form="inn"), _checked(f"{role}.director", x["director"])]
        account = [_checked(f"{role}.bank.name", bank["name"]), *[_checked(f"{role}.bank.{k}", bank[k], form=k) for k in ("account", "mfo", "swift")]]
        return F.when(x.isNull(), F.array(_checked(role, F.lit(None).cast("string"), True))).when(bank.isNull(), F.array(*own)).otherwise(F.array(*own, *account))

    def some(value: Column, *entries: Column) -> Column:
        return F.when(value.isNotNull(), F.array(*entries)).otherwise(F.filter(F.array(*entries), lambda _: F.lit(False)))

    total = F.when(~F.col("total_ok"), "total")
    head = F.array(_checked("contract_number", m["contract_number"], True), _checked("contract_date", m["contract_date"], True, skip=True), _checked("currency", m["currency"], True), _checked("total_amount", m["total_amount"], True, number=True, wrong=total), _checked("payment_terms", m["payment_terms"], skip=True))
    receiver = some(m["receiver"], *[_checked(f"receiver.{k}", m["receiver"][k]) for k in ("name", "country", "address", "inn")])
    delivery = some(m["delivery"], _checked("delivery.incoterms", m["delivery"]["incoterms"], skip=True), _checked("delivery.place", m["delivery"]["place"]))

    def product(x: Column, i: Column) -> Column:
        at = lambda name: F.concat(F.lit("products["), i.cast("string"), F.lit(f"].{name}"))
        numbers = [_checked(at(n), x[n], True, number=True, wrong=F.when(F.get("row_wrong", i), "arithmetic") if n == "amount" else None) for n in ("quantity", "price", "amount")]
        return F.array(_checked(at("name"), x["name"], True), *numbers)

    # Whatever shows without a measure of likeness is settled within the contract's row; only the rest takes the text along.
    text = F.coalesce(F.col(text_col), F.lit(""))
    checked = arithmetic(extracted).withColumns({"hay": nz.squeeze(text), "digits": cp.only_digits(text)})
    entries = F.concat(head, party("seller"), party("buyer"), receiver, delivery, F.flatten(F.transform("lines", product)))
    hay, digits = F.col("hay"), F.col("digits")

    def seen(x: Column) -> Column:
        return F.when(x["skip"], True).when(x["number"].isNotNull(), cp.number_in_digits(x["number"], digits)).otherwise(cp.surely_in_text(x["value"], hay, digits))

    each = checked.select("contract_id", "hay", F.explode(F.transform(entries, lambda x: F.struct(x.alias("x"), seen(x).alias("seen")))).alias("e"))
    rows = each.select("contract_id", "e.x.*", "e.seen", F.when(F.col("e.seen").isNull(), F.col("hay")).alias("text"))
    near = cp.nearly_in_text(F.when(F.col("seen").isNull(), F.col("value")), "text")
    rows = rows.withColumn("in_text", F.when(~F.col("skip"), F.coalesce("seen", near)))
    return validate_fields(rows).select("contract_id", "path", "value", "confidence", "issues", "required")


def check_arithmetic(items: DataFrame, totals: DataFrame, key: str = "contract_id") -> DataFrame:
    """quantity * price against amount in each row, and the sum of amounts against the totals (either may agree)."""
    ok = cp.close(F.col("quantity") * F.col("price"), "amount")
    per = items.groupBy(key).agg(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("line_sum"), F.coalesce(F.bool_and(ok), F.lit(True)).alias("rows_ok"), F.count_if(~ok).alias("bad_rows"))
    near = F.exists(F.array_compact(F.col("totals")), lambda t: cp.close(F.col("line_sum"), t))
    return per.join(totals, key).withColumn("total_ok", near).drop("totals")
