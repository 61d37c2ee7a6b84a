"""Similarity of two strings and the few text steps that need Python.

All run as Arrow-batched functions over columns of one row each: Spark decides the
partitions, nothing is gathered per key.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import deque

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens import vocab

# Ship these helpers inside the task, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of `a`."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    rows = full
    for ch in b:
        hit = rows & where.get(ch, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return len(a) - rows.bit_count()


def at_least(a: str, b: str, percent: int) -> bool:
    """Whether 100 * 2 * LCS / (len a + len b) reaches `percent`; exact in integers."""
    total = len(a) + len(b)
    if total == 0 or a == b:
        return True
    if 200 * min(len(a), len(b)) < percent * total:
        return False
    return 200 * common_length(a, b) >= percent * total


@F.pandas_udf(T.DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    def score(a, b):
        if a is None or b is None:
            return None
        total = len(a) + len(b)
        return 100.0 if total == 0 else 200.0 * common_length(a, b) / total

    return pd.Series([score(a, b) for a, b in zip(left, right)], dtype="float64")


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def _shared_start(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def near_common_length(a: str, b: str) -> int:
    """`common_length` of strings that share most of their ends."""
    start = _shared_start(a, b)
    a, b = a[start:], b[start:]
    end = _shared_start(a[::-1], b[::-1])
    return start + end + common_length(a[: len(a) - end], b[: len(b) - end])


def _resembles(key: str, by_size: dict, percent: int) -> bool:
    """Whether `key` reaches `percent` with a string of `by_size` (length -> strings).

    Of one more piece of the key than letters may be added and left out, one at least stands
    unbroken in a string that reaches `percent`; only those strings are compared.
    """
    size = len(key)
    least, most = -(-size * percent // (200 - percent)), size * (200 - percent) // percent
    sizes = range(least, most + 1) if most - least < len(by_size) else sorted(n for n in by_size if least <= n <= most)
    pieces = None
    for n in sizes:
        rivals = by_size.get(n)
        if not rivals:
            continue
        if pieces is None:
            count = (100 - percent) * (size + most) // 100 + 1
            cuts = [size * i // count for i in range(count + 1)]
            pieces = [key[i:j] for i, j in zip(cuts, cuts[1:])]
        for rival in rivals:
            if any(piece in rival for piece in pieces) and 200 * near_common_length(key, rival) >= percent * (size + n):
                return True
    return False


def _novel(keys, known, percent: int, window: int, least: int, learn: bool) -> list[bool]:
    near = deque(known[max(0, len(known) - window):] if window else known)
    by_size: dict[int, deque] = {}  # the strings of `near` by length, oldest first
    for key in near:
        by_size.setdefault(len(key), deque()).append(key)
    equal, flags = set(known), []
    for key in keys:
        flags.append(not key or key not in equal and not (len(key) > least and _resembles(key, by_size, percent)))
        if learn and key and flags[-1]:
            equal.add(key)
            near.append(key)
            by_size.setdefault(len(key), deque()).append(key)
            if window and len(near) > window:
                by_size[len(near.popleft())].popleft()
    return flags


def novel_lines(percent: int, window: int, least: int = 0, learn: bool = True):
    """Column function: ordered lines, each after its key and a line break, and known keys -> the lines whose keys are unlike those before them.

    Keys that equal a known one are not novel, nor are keys longer than `least` that
    resemble one of the last `window` known ones; with `learn` novel keys become known.
    Lines with empty keys stay. Lines come back whole, so that what builds them is evaluated once.
    """

    def kept(keyed, known) -> list[str]:
        keys, lines = zip(*(x.split("\n", 1) for x in keyed)) if len(keyed) else ((), ())
        flags = _novel(keys, () if known is None else list(known), percent, window, least, learn)
        return [line for line, flag in zip(lines, flags) if flag]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pick(lines: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else kept(x, o) for x, o in zip(lines, known)], dtype=object)

    return pick


def _pieces(text: str, size: int, overlap: int, separators) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that fits."""
    if len(text) <= size:
        return [text]
    mark, *finer = next((i_s for i_s in _tails(separators) if i_s[0] == "" or i_s[0] in text))
    if mark:
        *heads, last = text.split(mark)
        units = [head + mark for head in heads] + [last]
    else:
        units = list(text)
    out, run, length = [], deque(), 0
    for unit in units:
        if len(unit) > size and finer:
            if run:
                out.append("".join(run))
                run, length = deque(), 0
            out.extend(_pieces(unit, size, overlap, finer))
            continue
        if length + len(unit) > size and run:
            out.append("".join(run))
            while run and (length > overlap or length + len(unit) > size):
                length -= len(run.popleft())
        run.append(unit)
        length += len(unit)
    if run:
        out.append("".join(run))
    return [piece for piece in (p.strip() for p in out) if piece]


def _tails(separators):
    for i in range(len(separators)):
        yield list(separators[i:])


def split_pieces(size: int = vocab.SPLIT_SIZE, overlap: int = vocab.SPLIT_OVERLAP, separators=vocab.SPLIT_SEPARATORS):
    """Column function: text -> array of overlapping pieces."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _pieces(t.strip(), size, overlap, separators) if t.strip() else [])

    return cut


def _support(values: list[str], percent: int) -> list[int]:
    keys = [v.strip().lower() for v in values]
    counts: dict[str, int] = {}
    for key in keys:
        counts[key] = counts.get(key, 0) + 1
    distinct = list(counts)
    totals = {
        a: sum(n for b, n in counts.items() if at_least(a, b, percent)) for a in distinct
    }
    return [totals[key] for key in keys]


def support_counts(percent: int = 92):
    """Column function: array of candidates -> how many candidates resemble each."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def count(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else _support(list(v), percent))

    return count


def _first_distinct(signatures, percent: int, agree=None) -> list[bool]:
    kept: dict[tuple, set[str]] = {}  # by length: only lengths within the band can reach `percent`
    flags = []
    for key, same in zip(signatures, [None] * len(signatures) if agree is None else agree):
        size = len(key)
        band = range(-(-size * percent // (200 - percent)), size * (200 - percent) // percent + 1)
        fresh = bool(key) and not any(
            key in kept.get((same, n), ()) or any(at_least(key, other, percent) for other in kept.get((same, n), ())) for n in band
        )
        if fresh:
            kept.setdefault((same, size), set()).add(key)
        flags.append(fresh)
    return flags


def first_distinct(percent: int = 96):
    """Column function: ordered signatures, and what look-alikes must agree in (or null) -> whether each differs from all kept before it."""

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def mark(values: pd.Series, agree: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else _first_distinct(v, percent, a) for v, a in zip(values, agree)], dtype=object)

    return mark
