"""Normalisation and extraction as column expressions, evaluated in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: Letters of the Latin blocks with marks, and the letters without them, from their canonical decomposition.
_MARKED = [chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFKD", chr(c))) > 1 and len(unicodedata.normalize("NFKD", chr(c))[0].encode()) == 1]
_PLAIN = [unicodedata.normalize("NFKD", c)[0] for c in _MARKED if len("".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))) == 1]
_MARKED = [c for c in _MARKED if len("".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))) == 1]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, function: Callable[[Column], Column]) -> Column:
    """``function`` of a value that is worked out once, however often the function names it."""
    return F.get(F.transform(F.array(value), lambda x: function(x)), F.lit(0))


def strip(c) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def is_blank(c) -> Column:
    return col(c).isNull() | (strip(c) == "")


def zfill(c, n: int) -> Column:
    """Zeros on the left up to n characters; longer texts stay (lpad would cut them)."""
    return F.lpad(col(c), F.greatest(F.length(col(c)), F.lit(n)), F.lit("0"))


def digit_runs(c, n: int) -> Column:
    """Runs of exactly n digits, in order."""
    return F.filter(F.regexp_extract_all(col(c), F.lit(r"[0-9]+"), F.lit(0)), lambda x: F.length(x) == n)


def swift_codes(c) -> Column:
    """Bank codes: 6 capital letters, 2 or 5 capitals or digits, as a whole word."""
    words = F.split(col(c), r"[^\p{L}\p{N}_]+")
    return F.filter(words, lambda w: w.rlike("^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$"))


def distinct_in_order(c) -> Column:
    return F.array_distinct(col(c))


def by_context(lines: Column, found, keywords: list[str]) -> Column:
    """Candidates of the lines that hold a keyword; of all lines when those have none. ``found``: line -> array."""
    each = F.transform(lines, lambda line: F.struct(found(line).alias("hits"), reduce(lambda a, b: a | b, [F.contains(F.lower(line), F.lit(k)) for k in keywords]).alias("near")))
    near = F.flatten(F.transform(F.filter(each, lambda x: x["near"]), lambda x: x["hits"]))
    return distinct_in_order(F.when(F.size(near) > 0, near).otherwise(F.flatten(F.transform(each, lambda x: x["hits"]))))


def lines_of(c) -> Column:
    return F.split(col(c), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]")


def normalize_amount(c) -> Column:
    """A number from a text: the last of "." and "," is the decimal sign if one or two characters follow it, else all of
    them separate thousands. Texts that are no plain number give null."""
    s = F.regexp_replace(strip(c), r"[  ]", "")
    plain = F.replace(F.regexp_replace(s, r"[.,](?![^.,]{1,2}\z)", ""), F.lit(","), F.lit("."))
    return F.regexp_extract(plain, r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$", 0).try_cast("double")


DATE = r"\b(\d{1,2})[./\-](\d{1,2})[./\-](\d{4})\b|\b(\d{4})[./\-](\d{1,2})[./\-](\d{1,2})\b"
WORD_DATE = r"(?iu)\b(\d{1,2})\s*[-«»\"']*\s*(" + "|".join(fixed.MONTHS) + r")\w*\s+(\d{4})"


def _iso(y: Column, m: Column, d: Column) -> Column:
    text = F.concat_ws("-", zfill(y, 4), zfill(m.cast("string"), 2), zfill(d, 2))
    return F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd")


def normalize_date(c) -> Column:
    """ISO date of the first numeric date (an impossible one gives null), else of the first one with a month's name."""
    c = col(c)
    first = F.regexp_extract(c, DATE, 0)
    part = [F.regexp_extract(c, DATE, k) for k in range(7)]
    month = F.create_map(*[F.lit(x) for kv in fixed.MONTHS.items() for x in kv])
    word = F.lower(F.regexp_extract(c, WORD_DATE, 2))
    numeric = F.when(part[1] != "", _iso(part[3], part[2], part[1])).otherwise(_iso(part[4], part[5], part[6]))
    worded = F.when(word != "", _iso(F.regexp_extract(c, WORD_DATE, 3), F.try_element_at(month, word), F.regexp_extract(c, WORD_DATE, 1)))
    return F.when(first != "", numeric).otherwise(worded)


_TERMS = "|".join(fixed.CURRENT_TERMS + list(fixed.OLD_TERMS))


def current_term(c) -> Column:
    old = F.create_map(*[F.lit(x) for kv in fixed.OLD_TERMS.items() for x in kv])
    return F.coalesce(F.try_element_at(old, col(c)), col(c))


def normalize_term(c) -> Column:
    """The first trade term of a text, old ones as the present ones."""
    term = F.regexp_extract(F.upper(col(c)), rf"\b({_TERMS})\b", 1)
    return F.when(term != "", current_term(term))


def contract_numbers(c) -> Column:
    found = F.transform(F.regexp_extract_all(col(c), F.lit(fixed.CONTRACT_NUMBER), F.lit(1)), lambda x: F.struct(x.alias("raw"), strip(F.regexp_replace(x, r"\.+$", "")).alias("cut")))
    kept = F.filter(found, lambda x: ~F.lower(x["raw"]).rlike("^(от|dan)") & x["raw"].rlike(r"(?U)\d"))
    return distinct_in_order(F.transform(kept, lambda x: x["cut"]))


def dates_in(c) -> Column:
    numeric = F.transform(F.regexp_extract_all(col(c), F.lit(DATE), F.lit(0)), normalize_date)
    worded = F.transform(F.regexp_extract_all(F.lower(col(c)), F.lit(WORD_DATE), F.lit(0)), normalize_date)
    return distinct_in_order(F.filter(F.concat(numeric, worded), lambda x: x.isNotNull()))


def extract_candidates(c) -> Column:
    """All deterministic candidates of a text, as a struct of arrays in order of appearance."""
    c = F.coalesce(col(c), F.lit(""))
    no_accounts = F.regexp_replace(c, r"(?<!\d)\d{20}(?!\d)", " ")
    terms = F.regexp_extract_all(F.upper(c), F.lit(rf"\b({_TERMS})\b"), F.lit(1))
    return F.struct(
        by_context(lines_of(no_accounts), lambda x: digit_runs(x, 9), fixed.KEYWORDS["inn"]).alias("inn"),
        by_context(lines_of(no_accounts), lambda x: digit_runs(x, 5), fixed.KEYWORDS["mfo"]).alias("mfo"),
        distinct_in_order(digit_runs(c, 20)).alias("accounts"),
        by_context(lines_of(c), swift_codes, fixed.KEYWORDS["swift"]).alias("swift"),
        dates_in(c).alias("dates"),
        contract_numbers(c).alias("contract_numbers"),
        distinct_in_order(F.transform(terms, current_term)).alias("incoterms"),
    )


def amounts_in(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(fixed.AMOUNT), F.lit(0))


def translit(c) -> Column:
    """Lower-case Cyrillic letters in Latin script."""
    many = {k: v for k, v in fixed.CYRILLIC_TO_LATIN.items() if len(v) > 1}
    one = {k: v for k, v in fixed.CYRILLIC_TO_LATIN.items() if len(v) == 1}
    none = "".join(k for k, v in fixed.CYRILLIC_TO_LATIN.items() if not v)
    out = F.translate(col(c), "".join(one) + none, "".join(one.values()))
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), many.items(), out)


def lookalikes(c) -> Column:
    return F.translate(col(c), "".join(fixed.LOOKALIKES), "".join(fixed.LOOKALIKES.values()))


def plain_letters(c) -> Column:
    """Latin letters without their marks; combining marks are dropped."""
    return F.regexp_replace(F.translate(col(c), "".join(_MARKED), "".join(_PLAIN)), r"\p{M}", "")


def _folded(c) -> Column:
    x = F.translate(translit(F.lower(col(c))), "".join(_MARKED) + "ıx", "".join(_PLAIN) + "ih")
    return F.regexp_replace(x, r"[\p{M}’'`ʻʼ´]", "")


def _fold_word(w: str) -> str:
    s = "".join(fixed.CYRILLIC_TO_LATIN.get(ch, ch) for ch in w.lower())
    s = "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch)).replace("ı", "i").replace("x", "h")
    return "".join(ch for ch in s if ch.isascii() and ch.isalnum())


#: Folded place names and what stands for each.
PLACE_NAMES = {_fold_word(name): _fold_word(names[0]) for names in fixed.PLACES for name in names}


def norm_tokens(c) -> Column:
    words = F.filter(F.split(_folded(c), "[^0-9a-z]+"), lambda w: ~w.isin("", *fixed.LEGAL_FORMS))
    places = F.create_map(*[F.lit(x) for kv in PLACE_NAMES.items() for x in kv])
    return F.transform(words, lambda w: F.when(w.isin(*PLACE_NAMES), F.try_element_at(places, w)).otherwise(w))


def norm_text(c) -> Column:
    """Names for comparison: Latin, lower case, no marks, no legal forms, places by one name."""
    return F.array_join(norm_tokens(c), " ")


def digit_tokens(normalised) -> Column:
    """Of a normalised name the distinct numbers, with letters beside them."""
    return F.array_distinct(F.regexp_extract_all(col(normalised), F.lit(r"[a-z]*[0-9]+[a-z]*"), F.lit(0)))


def key_tokens(c) -> Column:
    return digit_tokens(norm_text(c))


def split_bilingual(c) -> Column:
    """The whole name, and its parts between slashes when there are several."""
    parts = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), "/"), strip), lambda x: x != "")
    whole = F.array(F.coalesce(col(c), F.lit("")))
    return F.when(F.size(parts) > 1, F.concat(whole, parts)).otherwise(whole)


def squeeze(c) -> Column:
    """One space for each run of white space, none at the ends, lower case."""
    return F.lower(strip(F.regexp_replace(col(c), r"(?U)\s+", " ")))


def mark_low_confidence(text, confidence, cut: float = 0.70) -> Column:
    return F.when(col(confidence) < cut, F.format_string("%s⟨%.2f⟩", col(text), col(confidence))).otherwise(col(text))


def markdown_cell(c) -> Column:
    return F.replace(F.replace(col(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def markdown_table(header: Column, rows: Column) -> Column:
    """A header (array of texts, blank ones named by place) and rows as a Markdown table as wide as the widest row."""
    width = F.greatest(F.size(header), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)))

    def padded(r: Column) -> Column:
        return F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(cells, markdown_cell), " | "), F.lit(" |"))

    names = F.transform(padded(header), lambda x, i: F.when(x == "", F.concat(F.lit("col"), (i + 1).cast("string"))).otherwise(x))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit("---"), width), "|"), F.lit("|"))
    return F.array_join(F.concat(F.array(line(names), rule), F.transform(rows, lambda r: line(padded(r)))), "\n")


def cyrillic_share(c) -> Column:
    letters = F.regexp_count(F.coalesce(col(c), F.lit("")), F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(col(c), F.lit(r"[Ѐ-ӿ&&\p{L}]")) / letters).otherwise(0.0)


def truncate(c, limit: int = 55_000, notice: str = "\n[...]") -> Column:
    return F.when(F.length(col(c)) > limit, F.concat(F.left(col(c), F.lit(limit)), F.lit(notice))).otherwise(col(c))


def unit_key(c) -> Column:
    return F.regexp_replace(F.replace(translit(F.lower(strip(c))), F.lit(" "), F.lit("")), r"\.+$", "")


#: The names of each unit's code as unit keys.
UNIT_KEYS = {
    code: list(dict.fromkeys("".join(fixed.CYRILLIC_TO_LATIN.get(ch, ch) for ch in name.strip().lower()).replace(" ", "").rstrip(".") for name in names))
    for code, names in fixed.UNITS.items()
}


def clean_query(rewritten, original) -> Column:
    """The first line of a rewritten question without quotes; blank or over 300 characters: the original."""
    first = F.regexp_replace(strip(F.element_at(F.split(strip(rewritten), "\n"), 1)), "^[\"'«»“” ]+|[\"'«»“” ]+$", "")
    return F.when((first == "") | (F.length(first) > 300) | first.isNull(), col(original)).otherwise(first)


def link_ids(c) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col(c), F.lit(r"/docs/(-?\d+)"), F.lit(1))))


def document_id(line) -> Column:
    """The identifier in a line of a document list; blank lines and comments have none."""
    s = strip(line)
    linked = F.regexp_extract(s, r"/(?:docs|acts)/(-?\d+)", 1)
    return F.when((s == "") | s.startswith("#"), None).when(linked != "", linked).when(s.rlike(r"^-?\d+$"), s)


def content_hash(c) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def iso_timestamp(c) -> Column:
    """ISO 8601 with a T; fractions of a second only where there are any, as six digits."""
    c = col(c)
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.date_format(c, "SSSSSS") == "000000", "").otherwise(F.date_format(c, ".SSSSSS")))


def uuid5(namespace_hex: str, name) -> Column:
    """Version 5 identifier of a name."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(col(name), "utf-8"))), 1, 32)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.substring(variant, -1, 1), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def source_url(base: str, document, anchor) -> Column:
    return F.concat(F.lit(f"{base}/docs/"), col(document), F.coalesce(F.concat(F.lit("#"), col(anchor)), F.lit("")))


def split_units(c, limit: int = 1200) -> Column:
    """Paragraphs; those over the limit in sentences; sentences over the limit cut hard."""
    def cut(s: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.length(s) - 1) / limit))
        return F.when(F.length(s) <= limit, F.array(s)).otherwise(F.transform(starts, lambda k: F.substring(s, (k * limit + 1).cast("int"), F.lit(limit))))

    def sentences(p: Column) -> Column:
        parts = F.filter(F.transform(F.split(p, r"(?<=[.!?;:])\s+"), strip), lambda x: x != "")
        return F.when(F.length(p) <= limit, F.array(p)).otherwise(F.flatten(F.transform(parts, cut)))

    paragraphs = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), "\n"), strip), lambda x: x != "")
    return F.flatten(F.transform(paragraphs, sentences))


def valid_uuid(c) -> Column:
    """A UUID in its usual form (braces, a urn prefix and missing dashes are allowed), else null."""
    hexed = F.regexp_replace(F.regexp_replace(F.lower(col(c)), "urn:|uuid:", ""), "[{}-]", "")
    dashed = F.regexp_replace(hexed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(hexed.rlike("^[0-9a-f]{32}$"), dashed)


def resolve_session(header, cookie) -> Column:
    """(user_id, is_new): a valid header, else a valid cookie, else a new identifier."""
    known = F.coalesce(valid_uuid(header), valid_uuid(cookie))
    return F.struct(F.coalesce(known, F.expr("uuid()")).alias("user_id"), known.isNull().alias("is_new"))
