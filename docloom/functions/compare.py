"""Comparators: two columns to a struct (status, score). Status is match, mismatch or unknown_code."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed, fuzzy
from . import normalize as nz
from .normalize import col

FUZZY, ADDRESS, PARTIAL, LENGTHS, COUNTRY = 0.85, 0.6, 82, 0.6, 90


def _of(ok: Column, score: Column | None = None) -> Column:
    ok = F.coalesce(ok, F.lit(False))
    if score is not None:
        return F.struct(F.when(ok, "match").otherwise("mismatch").alias("status"), score.alias("score"))
    return nz.let(ok, lambda x: F.struct(F.when(x, "match").otherwise("mismatch").alias("status"), x.cast("double").alias("score")))


def numbers_equal(a, b) -> Column:
    a, b = col(a), col(b)
    return F.coalesce(F.abs(a - b) <= F.greatest(F.abs(b) * 0.005, F.lit(0.05)), F.lit(False))


def close(a, b) -> Column:
    """Within one percent of the larger, or 0.05."""
    a, b = col(a), col(b)
    return F.abs(a - b) <= F.greatest(0.01 * F.greatest(F.abs(a), F.abs(b)), F.lit(0.05))


def compare_amounts(a, b) -> Column:
    """Numbers as they are."""
    return _of(nz.let(F.struct(col(a).alias("a"), col(b).alias("b")), lambda x: numbers_equal(x["a"], x["b"])))


def compare_number(a, b) -> Column:
    """Texts read as amounts."""
    return compare_amounts(*[nz.normalize_amount(col(c).cast("string")) for c in (a, b)])


def compare_date(a, b) -> Column:
    return _of(F.coalesce(nz.normalize_date(a), nz.strip(a)) == F.coalesce(nz.normalize_date(b), nz.strip(b)))


def compare_id(a, b) -> Column:
    """Equal without signs and spaces, with Cyrillic letters read by their looks or by their sound."""
    def bare(c) -> Column:
        return F.regexp_replace(nz.strip(c), r"(?U)[\s\-–—№#]", "")

    def looks(c) -> Column:
        return F.upper(nz.lookalikes(bare(c)))

    def sounds(c) -> Column:
        return F.upper(nz.translit(F.lower(bare(c))))

    return _of((looks(a) == looks(b)) | (sounds(a) == sounds(b)))


@lru_cache(fuzzy.REMEMBERED)
def text_score(x: str, y: str) -> float:
    """For normalised texts: the best of the token ratios and the ratio without spaces, 0 to 1."""
    best = max(fuzzy.token_sort_ratio(x, y), fuzzy.token_set_ratio(x, y))
    return max(best, fuzzy.ratio(x.replace(" ", ""), y.replace(" ", ""))) / 100


@F.pandas_udf(T.DoubleType())
def _text_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else text_score(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def compare_text(a, b) -> Column:
    score = _text_score(nz.norm_text(a), nz.norm_text(b))
    return _of(score >= FUZZY, F.bround(score, 3))


def same_company(a, b) -> Column:
    return ~nz.is_blank(a) & ~nz.is_blank(b) & (_text_score(nz.norm_text(a), nz.norm_text(b)) >= FUZZY)


_ADJECTIVE = re.compile(rf"(.{{4,}}?)(?:{'|'.join(fixed.ADJECTIVE_ENDINGS)})")
_BEGUN: dict[str, set[str]] = {}
for _name, _place in nz.PLACE_NAMES.items():
    for _n in range(4, len(_name) + 1):
        _BEGUN.setdefault(_name[:_n], set()).add(_place)
#: Beginnings of at least four letters that all stand for one place, and that place.
_ONLY = {begun: next(iter(places)) for begun, places in _BEGUN.items() if len(places) == 1}
_VOWELS = str.maketrans("", "", "aeiou")


@lru_cache(fuzzy.REMEMBERED)
def toponym_root(token: str) -> str:
    """A place name without an adjective's ending, by the name that stands for it."""
    stem = m[1] if (m := _ADJECTIVE.fullmatch(token)) else token
    return (nz.PLACE_NAMES.get(stem) or _ONLY.get(stem, stem)).replace("q", "k")


def roots_match(a: str, b: str) -> bool:
    """Nearly one in the other when neither is much longer; else the same four or more consonants in the same order."""
    short, long = sorted((a, b), key=len)
    alike = bool(short) and len(short) >= LENGTHS * len(long) and fuzzy.partial_ratio(short, long) >= PARTIAL
    bare = {w.translate(_VOWELS) for w in (a, b)}
    return alike or bool(short) and len(bare) == 1 and len(min(bare)) >= 4


def address_score(x: str, y: str) -> tuple[bool, float]:
    """How much of the second address's names the first one holds; without names, as texts."""
    ours, theirs = ([t for t in s.split() if len(t) >= 4 and t not in fixed.ADDRESS_WORDS] for s in (x, y))
    if not ours or not theirs:
        score = text_score(x, y)
        return score >= FUZZY, score
    roots = [toponym_root(t) for t in ours]
    score = sum(any(roots_match(toponym_root(t), r) for r in roots) for t in theirs) / len(theirs)
    return score >= ADDRESS, score


@F.pandas_udf(T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("score", T.DoubleType())]))
def _address(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([address_score(x or "", y or "") for x, y in zip(a, b, strict=True)], columns=["ok", "score"])


def compare_address(a, b) -> Column:
    found = _address(nz.norm_text(a), nz.norm_text(b))
    return _of(found["ok"], F.bround(found["score"], 3))


def compare_contains(a, b) -> Column:
    x, y = (F.upper(F.regexp_replace(col(c), r"(?U)\s", "")) for c in (a, b))
    return _of((x != "") & y.contains(x))


def _code(ok: Column) -> Column:
    """Codes without an entry are unknown, not different."""
    return nz.let(ok, lambda x: F.struct(F.when(x.isNull(), "unknown_code").when(x, "match").otherwise("mismatch").alias("status"), F.coalesce(x.cast("double"), F.lit(0.0)).alias("score")))


def same_number(a, b) -> Column:
    x, y = nz.strip(a), nz.strip(b)
    both = x.rlike("^[0-9]+$") & y.rlike("^[0-9]+$")
    return F.coalesce(both & (F.regexp_replace(x, "^0+(?=.)", "") == F.regexp_replace(y, "^0+(?=.)", "")), F.lit(False))


def _lookup(values: dict, key: Column) -> Column:
    items = [F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*items), key)


def currency_matches(a, code) -> Column:
    alpha = _lookup(fixed.CURRENCIES, nz.strip(code))
    v = nz.strip(F.regexp_replace(nz.translit(F.lower(nz.strip(a))), "[^a-z0-9$€£]+", " "))
    words = F.coalesce(_lookup(fixed.CURRENCY_WORDS, alpha), F.array(F.lower(alpha)))
    near = (v != "") & ((v == F.lower(alpha)) | F.exists(words, lambda w: F.contains(v, w) | F.contains(w, v)))
    return F.when(same_number(a, code), True).when(alpha.isNotNull(), near)


@F.pandas_udf(T.BooleanType())
def _names_country(a: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([None if n is None else any(v == x.lower() or fuzzy.partial_ratio(v, x.lower()) >= COUNTRY for x in n) for v, n in zip(a, names, strict=True)], dtype="object")


def country_matches(a, code) -> Column:
    names = _lookup(fixed.COUNTRIES, nz.zfill(nz.strip(code), 3))
    return F.when(same_number(a, code), True).otherwise(_names_country(F.coalesce(F.lower(nz.strip(a)), F.lit("")), names))


def unit_matches(a, code) -> Column:
    names = _lookup(nz.UNIT_KEYS, nz.zfill(nz.strip(code), 3))
    parts = F.transform(F.filter(F.split(col(a), "[/,;]"), lambda p: nz.strip(p) != ""), nz.unit_key)
    return F.when(same_number(a, code), True).when(names.isNotNull(), F.arrays_overlap(parts, names))


def term_matches(a, code) -> Column:
    term = _lookup(fixed.TRADE_TERMS, nz.zfill(nz.strip(code), 2))
    return F.when(same_number(a, code), True).when(term.isNotNull(), nz.current_term(term) == nz.current_term(F.upper(nz.strip(a))))


def contract_type_matches(orientation, code) -> Column:
    side = _lookup(fixed.CONTRACT_TYPES, nz.zfill(F.coalesce(nz.strip(code), F.lit("")), 2))
    return F.when(side.isNotNull(), F.lower(nz.strip(orientation)) == side)


#: Kind of a field to its comparator.
COMPARATORS = {
    "number": compare_number,
    "date": compare_date,
    "id": compare_id,
    "text": compare_text,
    "address": compare_address,
    "contains": compare_contains,
    "currency": lambda a, b: _code(currency_matches(a, b)),
    "country": lambda a, b: _code(country_matches(a, b)),
    "unit": lambda a, b: _code(unit_matches(a, b)),
    "incoterms": lambda a, b: _code(term_matches(a, b)),
    "contract_type": lambda a, b: _code(contract_type_matches(a, b)),
}


#: Kinds whose comparators need Python; the others stay in the JVM.
PYTHON_KINDS = ("text", "address", "country")


def compare_value(ours, theirs, kind, kinds=tuple(COMPARATORS)) -> Column:
    """With the rule for blanks: nothing on their side is missing_api (or missing_pdf if we have nothing too); nothing on
    ours alone is a mismatch. ``kind`` is a name, or a column of names out of ``kinds`` (then each kind's comparator sees its
    rows only, and no comparator of another kind is in the plan)."""
    a, b = col(ours), col(theirs)
    none = F.lit(0.0)
    if isinstance(kind, str):
        compared = COMPARATORS[kind](a, b)
    else:
        cases = [(kind == k, COMPARATORS[k](F.when(kind == k, a), F.when(kind == k, b))) for k in kinds]
        compared = reduce(lambda x, case: x.when(*case), cases[1:], F.when(*cases[0]))
    return (
        F.when(nz.is_blank(b.cast("string")), F.struct(F.when(nz.is_blank(a.cast("string")), "missing_pdf").otherwise("missing_api").alias("status"), none.alias("score")))
        .when(nz.is_blank(a.cast("string")), F.struct(F.lit("mismatch").alias("status"), none.alias("score")))
        .otherwise(compared)
    )


def compare_bank(swift, account, theirs) -> Column:
    """The bank code and every number of eight digits and more must be in their text; nothing of ours is missing_pdf. A code
    without letters or digits is something of ours that cannot be found."""
    def bare(c) -> Column:
        return F.regexp_replace(F.upper(F.coalesce(col(c), F.lit(""))), "[^A-Z0-9]", "")

    numbers = F.regexp_extract_all(F.coalesce(col(account), F.lit("")), F.lit(r"\d{8,}"), F.lit(0))
    accounts = F.when(F.size(numbers) > 0, numbers).otherwise(F.array(bare(account)))
    wanted = F.array_remove(F.concat(F.array(bare(swift)), accounts), "")
    share = F.coalesce(F.try_divide(F.size(F.filter(wanted, lambda x: F.contains(bare(theirs), x))), F.size(wanted)), F.lit(0.0))
    return (
        F.when(nz.is_blank(swift) & nz.is_blank(account), F.struct(F.lit("missing_pdf").alias("status"), F.lit(0.0).alias("score")))
        .when(nz.is_blank(theirs), F.struct(F.lit("missing_api").alias("status"), F.lit(0.0).alias("score")))
        .otherwise(_of(share >= 1, F.bround(share, 3)))
    )


def bank_display(swift, account) -> Column:
    """Our code and account as one text, null when there is neither."""
    named = [F.when(~nz.is_blank(c), F.concat(F.lit(f"{label}: "), nz.strip(c))) for label, c in (("SWIFT", swift), ("hisob", account))]
    shown = F.concat_ws("; ", *named)
    return F.when(shown != "", shown)


FORMATS = {"inn": "^[0-9]{9}$", "mfo": "^[0-9]{5}$", "account": "^[0-9]{20}$", "swift": "^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$"}


def format_ok(c, kind: str) -> Column:
    return F.regexp_replace(col(c), r"(?U)\s+", "").rlike(FORMATS[kind])


def only_digits(text) -> Column:
    return F.regexp_replace(col(text), r"\D", "")


def surely_in_text(value, squeezed: Column, digits: Column) -> Column:
    """Whether a value is in a text (given squeezed, and its digits) as far as that shows without a measure of likeness; else null."""
    v = nz.squeeze(value)
    return F.when(v.isNull() | (v == ""), True).when(squeezed.contains(v), True).when(v.rlike("^[0-9]+$"), digits.contains(v))


def nearly_in_text(value, squeezed) -> Column:
    return fuzzy.partial_of(nz.squeeze(value), col(squeezed)) >= FUZZY * 100


def in_text(value, text) -> Column:
    """Whether a text value is in a recognised text: as it is, as digits, or nearly."""
    squeezed = nz.squeeze(text)
    known = surely_in_text(value, squeezed, only_digits(text))
    return F.coalesce(known, nearly_in_text(F.when(known.isNull(), col(value)), F.when(known.isNull(), squeezed)))  # the others are not looked at


def number_in_digits(value, digits: Column) -> Column:
    wanted = only_digits(F.regexp_replace(F.regexp_replace(F.format_string("%.2f", col(value).cast("double")), "0+$", ""), r"\.$", ""))
    return F.when(col(value).isNull(), True).otherwise((wanted != "") & digits.contains(wanted))


def number_in_text(value, text) -> Column:
    return number_in_digits(value, only_digits(text))
