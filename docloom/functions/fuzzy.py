"""Similarity of texts by longest common subsequences, 0 to 100; pandas UDFs, as Spark has no such functions."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs of texts whose similarity a Python worker remembers: names, countries and units repeat over many contracts.
REMEMBERED = 1 << 14


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors over the shorter text."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & where.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """0 if either has no token; 100 if one side's tokens hold the other's; else the best of the three pairings."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = x & y
    if both and (both == x or both == y):
        return 100.0
    sect, left, right = " ".join(sorted(both)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    one, two = f"{sect} {left}".strip(), f"{sect} {right}".strip()
    best = ratio(one, two)
    if sect:
        best = max(best, ratio(sect, one), ratio(sect, two))
    return best


@lru_cache(REMEMBERED)
def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with any window of the longer one, short windows at both ends too."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    best = _best_window(short, long, 0.0)
    return _best_window(long, short, best) if len(short) == len(long) else best


def _best_window(short: str, long: str, best: float) -> float:
    """The best ratio of ``short`` with windows of ``long``, or ``best`` if none is better. A window slides along with the
    number of letters it has in common with ``short``, which bounds its ratio; only windows that may win are compared."""
    n, wanted, held, common = len(short), Counter(short), Counter(), 0
    for stop in range(1, len(long) + n):
        start = max(stop - n, 0)
        if stop <= len(long):
            c = long[stop - 1]
            held[c] += 1
            common += held[c] <= wanted[c]
        if start:
            c = long[start - 1]
            common -= held[c] <= wanted[c]
            held[c] -= 1
        end = min(stop, len(long))
        if 200.0 * common / (n + end - start) > best:
            best = max(best, ratio(short, long[start:end]))
    return best


def _udf(function):
    @F.pandas_udf(T.DoubleType())
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return apply


ratio_of = _udf(ratio)
token_sort_of = _udf(token_sort_ratio)
token_set_of = _udf(token_set_ratio)
partial_of = _udf(partial_ratio)
