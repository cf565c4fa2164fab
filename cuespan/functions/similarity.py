"""Sequence similarity and edit scripts: the two text measures that Spark has
no expression for. Both are small Arrow helpers; callers block by time or key
first, so they only ever see pairs that survived a join."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


SHORT = 200  # from this length on the second text's frequent letters count as junk


def _common(a: str, b: str) -> int:
    """Letters in the matching blocks of a pair whose second text is short: the
    longest block, earliest in ``a``, then in ``b``, and so on left and right of it.
    """
    if len(a) == len(b):
        places = [(x, y) for x, y in zip(a, b) if x != y]
        # replaced letters that the other text lacks cut both texts into the same
        # pieces; the longest piece, and the first of those, always meets itself
        if not any(x in b or y in a for x, y in places):
            return len(a) - len(places)
    letters, total, open_ = set(b), 0, [(0, len(a), 0, len(b))]
    while open_:
        a_from, a_to, b_from, b_to = open_.pop()
        size, i = 0, a_from
        while i + size < a_to:
            j = b.find(a[i:i + size + 1], b_from, b_to)
            if j >= 0:
                size += 1
                while i + size < a_to and j + size < b_to and a[i + size] == b[j + size]:
                    size += 1
                at, to = i, j
            elif a[i + size] in letters:
                i += 1
            else:  # no block holds that letter
                i += size + 1
        if size:
            total += size
            if at > a_from and to > b_from:
                open_.append((a_from, at, b_from, to))
            if at + size < a_to and to + size < b_to:
                open_.append((at + size, a_to, to + size, b_to))
    return total


def ratio(x: str, y: str) -> float:
    """``SequenceMatcher(None, x, y).ratio()``, to the last bit."""
    if x == y:
        return 1.0
    if len(y) >= SHORT:
        return SequenceMatcher(None, x, y).ratio()
    return 2.0 * _common(x, y) / (len(x) + len(y))


def alike(x: str, y: str, limit: float) -> bool:
    """``ratio >= limit`` with two exact upper bounds tried before the ratio."""
    total = len(x) + len(y)
    if x == y or not total:
        return True
    if 2.0 * min(len(x), len(y)) / total < limit:
        return False
    shared = sum(min(x.count(c), y.count(c)) for c in set(x))
    if 2.0 * shared / total < limit:
        return False
    return ratio(x, y) >= limit


@F.pandas_udf(T.IntegerType())
def consensus(places: pd.Series, texts: pd.Series) -> pd.Series:
    """Which of several texts is most like all of them, itself included; ties go
    to the longer, then to the earlier place. The order of a ratio's two texts
    matters; ratios are added by place. Null stays null."""
    def pick(at, rows) -> int:
        at, rows = [int(p) for p in at], list(rows)
        known: dict[tuple[str, str], float] = {}

        def total(x: str) -> float:
            for y in rows:
                if (x, y) not in known:
                    known[x, y] = ratio(x, y)
            out = 0.0  # sum() would round otherwise
            for _, r in sorted((p, known[x, y]) for p, y in zip(at, rows)):
                out += r
            return out

        return max(range(len(rows)), key=lambda i: (total(rows[i]), len(rows[i]), -at[i]))

    return pd.Series([None if t is None else pick(p, t) for p, t in zip(places, texts)], dtype="Int32")


def similar(a: Column, b: Column, limit: float) -> Column:
    @F.pandas_udf(T.BooleanType())
    def test(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([
            False if p is None or q is None else alike(p, q, limit) for p, q in zip(x, y)], dtype="bool")

    return test(a, b)


def substitutions(truth: str, read: str) -> list[tuple[str, str]]:
    """Replaced character pairs of one shortest edit script.

    Ties go to the diagonal, then to a deletion, then to an insertion. Shared
    ends never change the replaced pairs of that trace and are cut off first.
    """
    if truth == read:
        return []
    a = np.frombuffer(truth.encode("utf-32-le"), np.uint32)
    b = np.frombuffer(read.encode("utf-32-le"), np.uint32)
    tail = 0
    while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    rows = np.empty((len(a) + 1, len(b) + 1), np.int32)
    steps = np.arange(len(b) + 1, dtype=np.int32)
    rows[0] = steps
    for i in range(1, len(a) + 1):
        best = np.empty(len(b) + 1, np.int32)
        best[0] = i
        np.minimum(rows[i - 1, 1:] + 1, rows[i - 1, :-1] + (b != a[i - 1]), out=best[1:])
        # an insertion chain costs one per step: prefix minimum of value - position
        rows[i] = np.minimum.accumulate(best - steps) + steps
    pairs = []
    i, j = len(a), len(b)
    while i and j:
        differs = a[i - 1] != b[j - 1]
        if rows[i, j] == rows[i - 1, j - 1] + differs:
            if differs:
                pairs.append((chr(a[i - 1]), chr(b[j - 1])))
            i, j = i - 1, j - 1
        elif rows[i, j] == rows[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
    pairs.reverse()
    return pairs


_PAIRS = T.ArrayType(T.StructType([T.StructField("gt", T.StringType()), T.StructField("ocr", T.StringType())]))


@F.pandas_udf(_PAIRS)
def edit_substitutions(truth: pd.Series, read: pd.Series) -> pd.Series:
    known = {pair: [] if None in pair else [{"gt": g, "ocr": o} for g, o in substitutions(*pair)] for pair in set(zip(truth, read))}
    return pd.Series([known[pair] for pair in zip(truth, read)])
