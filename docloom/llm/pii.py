"""Operator 7: personal data by a linear-chain CRF over word-shape features, beside the base patterns.

The CRF is trained on ``LABELLED``, a small table of labelled lines, and decoded by Viterbi in numpy batches. Its
sequences are the runs of tokens that lie at most ``REACH`` tokens from one with a digit or an at sign, or from an address
with the word "at" in brackets: elsewhere the label is O by construction, as every kind holds such a token. Whole texts are read. Spans that the CRF finds and that
touch no base span are added under their own kinds; base spans always stay.

Distribution: the model is a few thousand numbers, trained on the driver from the table in this module; the scan is one
map over Arrow batches, without a shuffle.

Defined cases: null and empty texts have no spans; repeated rows are scanned each; an empty table gives an empty result;
very long texts are one piece each. Columns are carried in a struct and cannot clash.
"""

from __future__ import annotations

import bisect
import itertools
import re
import zlib
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .arrow_texts import map_texts
from .common import table

#: Fixed by the query contract.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Labels of the CRF; those after O are kinds of added spans.
LABELS = ("O", "contact_email", "contact_phone", "national_id", "bank_account")
#: The labelled table: tokens as token/label, with the label's first letter (O, E, P, N, B).
LABELLED = """
call me at/O (217)/P 555-7713/P today/O
tel:/O (415)/P 555-0199/P or/O mail/O
phone/O 415-555-0132/P ext/O 12/O
ring 212-555-0147/P after/O six/O
the office number is/O (303)/P 555-0186/P ./O
fax/O 646-555-0101/P ,/O room/O 14/O
cell 917-555-0170/P please/O
write to/O jane/E (at)/E mail/E dot/E com/E soon/O
contact bob.smith/E [at]/E example.org/E now/O
mail me:/O info/E (at)/E shop.net/E thanks/O
reach a.b/E [at]/E uni.edu/E for/O help/O
jane/E (at)/E mail/E dot/E com/E
bob.smith/E [at]/E example.org/E
ask/O ann/E (/E at/E )/E post/E dot/E org/E please/O
kim/E [/E at/E ]/E web.net/E
mail/O sales/E (at)/E firm/E dot/E co/E dot/E uk/E today/O
lee/E (/E at/E )/E home/E dot/E com/E
his ssn is/O 123-45-6789/N and/O
ssn:/O 987-65-4321/N on/O file/O
number 078-05-1120/N was/O used/O
social security 219-09-9999/N ./O
id 457-55-5462/N ,/O born/O 1982/O
iban DE89370400440532013000/B paid/O
account GB29NWBK60161331926819/B at/O the/O bank/O
transfer to/O FR1420041010050500013M02606/B by/O friday/O
iban:/O ES9121000418450200051332/B ./O
in 1987/O there/O were/O 250/O people/O
the/O order/O 473696257/O was/O sent/O on/O 12.05.2020/O
page/O 12/O of/O 240/O ,/O line/O 7/O
costs/O 19.99/O or/O 1,250.00/O euros/O
version/O 2.4.1/O released/O 2021-03-04/O
about/O 3/O to/O 5/O days/O
see/O section/O 4.2/O and/O 4.3/O
item/O 9807915762804490/O in/O stock/O
from/O 10:30/O to/O 11:45/O on/O monday/O
room/O 101/O ,/O floor/O 3/O ,/O building/O 12/O
between/O 1914/O and/O 1918/O the/O war/O
code/O A1B2C3/O or/O X99/O works/O
sku/O 55-1234/O and/O 12-34567/O left/O
thousand/O and/O 25%/O more/O than/O 2019/O
ratio/O 3/4/O with/O 0.75/O error/O
meeting/O @/O noon/O in/O hall/O 2/O
user/O @handle/O wrote/O 14/O posts/O
token/O 04dbebab91ab85687d33eeaaf9ac699e1188f962/O here/O
part/O no./O 0012-4432-1/O and/O 7781/O
score/O was/O 3-2/O after/O 90/O minutes/O
zip/O 94105-1234/O city/O 20/O
seen/O 97.51.17.173/O in/O the/O log/O
in/O 2020-2021/O and/O 1999-2000/O
mail/O someone@example.com/O or/O call/O +1/O
"""
REACH = 3
WIDTH = 1 << 12
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: The middle and the end of a written-out address.
AT, REST = r"[(\[]\s*at\s*[)\]]", r"\s*[\w.-]+(\s+dot\s+\w+)*"
#: A span of the CRF must also look like one, so that a few labelled lines cannot mark clean documents.
CHECKS = {
    1: re.compile(rf"[\w.+-]+\s*{AT}{REST}", re.I),
    2: re.compile(r"(\+[0-9]{1,3}[\s.-]?)?(\([0-9]{3}\)\s*|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}"),
    3: re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    4: re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}"),
}
#: Every span of ``CHECKS`` holds one of these; after the word "at" the rest of the address belongs to it.
MARK = re.compile(rf"[0-9@]|{AT}(?:{REST})?", re.I)


def _small(digits: str) -> bool:
    """At most 255, however many digits."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def touching(spans: Iterable[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a span overlaps one of ``spans``: of those that begin before its end, the last end counts."""
    ordered = sorted(spans)
    starts, reach = [a for a, _ in ordered], list(itertools.accumulate((b for _, b in ordered), max))
    return lambda start, stop: (k := bisect.bisect_left(starts, stop)) > 0 and reach[k - 1] > start


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(twice) + sum(int(c) for c in digits[-1::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) by kind, then start."""
    found = []
    if "@" in text:
        found += [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    if DIGIT.search(text):
        found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(_small(p) for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, m.start(), m.end()))
        if "+" in text:
            found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return found


@lru_cache(1 << 16)
def shape(token: str) -> str:
    """Runs of upper, lower and digit characters as X, x and d with their length up to 4; others as they are."""
    kinds = ["X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c for c in token[:40]]
    out, k = [], 0
    while k < len(kinds):
        n = k
        while n < len(kinds) and kinds[n] == kinds[k]:
            n += 1
        out.append(kinds[k] + (str(min(n - k, 4)) if kinds[k] in "Xxd" else ""))
        k = n
    return "".join(out)


@lru_cache(1 << 16)
def _own(token: str) -> tuple[str, ...]:
    s = shape(token)
    return s, re.sub(r"[0-9]", "", s), f"n{min(len(token), 20)}", "w" + token.lower()[:8], f"d{sum(c.isdigit() for c in token)}"


def features(tokens: list[str]) -> np.ndarray:
    """Indices of the active features of each token of a sequence."""
    own = [_own(t) for t in tokens]
    rows = []
    for k, mine in enumerate(own):
        before = own[k - 1] if k else ("^",) * 4
        after = own[k + 1] if k + 1 < len(own) else ("$",) * 4
        names = [*(f"0{x}" for x in mine), f"-{before[0]}", f"-{before[3]}", f"+{after[0]}", f"+{after[3]}", "bias"]
        rows.append([zlib.crc32(x.encode("utf-8", "surrogatepass")) % WIDTH for x in names])
    return np.array(rows, np.int64).reshape(len(tokens), -1)


def labelled() -> list[tuple[list[str], list[int]]]:
    out = []
    for line in LABELLED.strip().splitlines():
        parts = [p.rsplit("/", 1) if re.search(r"/[OEPNB]$", p) else (p, "O") for p in line.split()]
        out.append(([t for t, _ in parts], ["OEPNB".index(x) for _, x in parts]))
    return out


def trained(rows: list[tuple[list[str], list[int]]] | None = None, rounds: int = 120, decay: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights and transitions, by gradient ascent of the conditional likelihood."""
    rows = rows or labelled()
    lengths = np.array([len(t) for t, _ in rows])
    active, gold = np.concatenate([features(t) for t, _ in rows]), np.concatenate([y for _, y in rows])
    k, starts = len(LABELS), np.cumsum(lengths) - lengths
    inner = np.setdiff1d(np.arange(len(gold)), starts)
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (gold[inner - 1], gold[inner]), 1)

    def gradient(theta: np.ndarray) -> np.ndarray:
        weights, trans = theta[:-k], theta[-k:]
        share, pairs, _ = crf.marginals(weights[active].sum(axis=1), trans, lengths)
        share[np.arange(len(gold)), gold] -= 1
        g = decay * theta * len(rows)
        np.add.at(g, active, share[:, None, :])
        g[-k:] += pairs - gold_pairs
        return g

    theta = crf.train(gradient, (WIDTH + k, k), rounds)
    return theta[:-k], theta[-k:]


def _reach(text: str, at: int) -> int:
    """The end of the last token that lies more than REACH tokens before the one at a position."""
    for _ in range(REACH + 1):
        while at > 0 and not text[at - 1].isspace():
            at -= 1
        while at > 0 and text[at - 1].isspace():
            at -= 1
    return at


def sequences(text: str) -> list[tuple[list[str], list[int]]]:
    """Tokens and their starts, in runs near a token with a digit or an at sign or near an address with "at" in brackets."""
    marks = [m.span() for m in MARK.finditer(text)]
    out: list[tuple[list[str], list[int]]] = []
    k = 0
    while k < len(marks):
        at = marks[k][0]
        left = _reach(text, at)
        tokens, starts, since, held = [], [], 0, 0
        for m in TOKEN.finditer(text, left):
            tokens.append(m[0])
            starts.append(m.start())
            stop = m.end()
            while k < len(marks) and marks[k][0] < stop:
                held = marks[k][1]
                k, since = k + 1, -1
            since = 0 if m.start() < held else since + 1
            # Runs that would share tokens are one run, so that none is cut before its mark.
            if stop > at and since >= REACH and not (k < len(marks) and _reach(text, marks[k][0]) < stop):
                break
        out.append((tokens, starts))
    return out


_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())]))


def tagger(weights: np.ndarray, trans: np.ndarray):
    """Work for ``map_texts``: the base spans of a piece of texts, and those of the CRF, decoded together."""

    def work(texts: pa.Array) -> list[pa.Array]:
        found: list[list[tuple[int, int, int]]] = []
        owners, parts = [], []
        values = texts.to_pylist()
        touches, reach = [], [0] * len(values)  # whether a span touches a base one; where the last added one ends
        for row, text in enumerate(values):
            found.append(base_spans(text) if text else [])
            touches.append(touching((a, b) for _, a, b in found[row]))
            for tokens, starts in sequences(text) if text else []:
                owners.append(row)
                parts.append((tokens, starts))
        if parts:
            lengths = np.array([len(t) for t, _ in parts])
            labels = crf.viterbi(weights[np.concatenate([features(t) for t, _ in parts])].sum(axis=1), trans, lengths)
            ends = np.cumsum(lengths)
            for label, a, b in crf.runs(labels, lengths):
                if label:
                    k = int(np.searchsorted(ends, a, "right"))
                    tokens, starts = parts[k]
                    first = int(ends[k] - lengths[k])
                    start, stop = starts[a - first], starts[b - 1 - first] + len(tokens[b - 1 - first])
                    row = owners[k]
                    for m in CHECKS[label].finditer(values[row], start, stop):
                        if label == 1:  # whole, also where the chain leaves it before its last part
                            m = CHECKS[label].match(values[row], m.start())
                        if m.start() >= reach[row] and not touches[row](m.start(), m.end()):
                            found[row].append((len(KINDS) + label - 1, m.start(), m.end()))
                            reach[row] = m.end()
        return [pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in sorted(spans)] for spans in found], _SPAN)]

    return work


def find_personal_data(docs: DataFrame, *, text_col: str = "text", carry: list[str] | None = None, rows=None) -> DataFrame:
    """A row per document: doc, found (array of kind, start, stop by kind and start; kinds from len(KINDS) on are the CRF's)."""
    return map_texts(docs, text_col, carry or docs.columns, "found array<struct<kind: int, start: bigint, stop: bigint>>", tagger(*trained(rows)))


def query(spark, sf_dir: str) -> DataFrame:
    from .secrets import counts_by_kind, joined_spans

    found = find_personal_data(table(spark, sf_dir, "documents"), carry=["doc_id"])
    base = F.filter("found", lambda s: s["kind"] < len(KINDS))
    return found.select("doc.doc_id", *counts_by_kind("found", KINDS), F.sha2(joined_spans(base, KINDS).cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("found"), (*KINDS, *LABELS[1:])).alias("spans"))
