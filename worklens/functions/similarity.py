"""Similarity functions on columns, 0 to 100."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from worklens.config import DEFAULT, Config


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, on one integer whose bits stand for places in ``a``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def token_set_similarity(a: str, b: str) -> float:
    """How alike two texts are as sets of words: the best of comparing what they share with each side, and
    both sides' remaining words with each other (in order of the alphabet)."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = " ".join(sorted(left & right))
    x, y = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if shared and not (x and y):
        return 100.0
    n, gap = len(shared), bool(shared)
    with_x, with_y = n + gap + len(x), n + gap + len(y)
    apart = len(x) + len(y) - 2 * common_subsequence(x, y)
    best = 100.0 - 100.0 * apart / (with_x + with_y)
    if shared:
        best = max(best, 100.0 - 100.0 * (gap + len(x)) / (n + with_x), 100.0 - 100.0 * (gap + len(y)) / (n + with_y))
    return best


@F.pandas_udf(DoubleType())
def _token_set(a: pd.Series, b: pd.Series) -> pd.Series:
    memo: dict = {(None, None): 0.0}
    out = []
    for pair in zip(a, b):
        if pair not in memo:
            memo[pair] = token_set_similarity(*pair)
        out.append(memo[pair])
    return pd.Series(out, dtype="float64")


def token_set(a: Column, b: Column) -> Column:
    """Token-set similarity; 0 where a side is missing. Equal and empty texts are decided without Python, which gets
    nulls in their place."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    open_ = (F.trim(a) != "") & (F.trim(b) != "") & (a != b)
    return F.when(open_, _token_set(F.when(open_, a), F.when(open_, b))).when((a == b) & (F.trim(a) != ""), 100.0).otherwise(0.0)


def amount(a: Column, b: Column) -> Column:
    """The smaller amount as a percentage of the larger; 0 unless both are positive and finite."""
    fine = (a > 0) & (b > 0) & (a < float("inf")) & (b < float("inf"))
    return F.when(fine, 100.0 * F.least(a, b) / F.greatest(a, b)).otherwise(0.0)


def micros(time: Column) -> Column:
    """Microseconds of a time."""
    return F.unix_micros(time.cast("timestamp"))


def days_of(start: Column, end: Column) -> Column:
    """Whole days between two times in microseconds, rounded down."""
    return F.floor((end - start) / 86_400_000_000).cast("bigint")


def days_between(start: Column, end: Column) -> Column:
    """Whole days from start to end, rounded down."""
    return days_of(micros(start), micros(end))


def timeline(days: Column, config: Config = DEFAULT) -> Column:
    """How plausible a duration is; 45 where it is unknown."""
    w = config.date_window
    return F.when(days.isNull(), 45.0).when(days.between(0, w), F.greatest(F.lit(20.0), 100.0 - 45.0 * days / w)).when(days.between(config.early_days, -1), 10.0).otherwise(0.0)


def in_window(days: Column, config: Config = DEFAULT) -> Column:
    """Whether a duration is acceptable; unknown ones are."""
    return days.isNull() | days.between(config.early_days, config.date_window)


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens as a percentage of the smaller set; 0 if a set is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, 100.0 * F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def share(part: Column, whole: Column) -> Column:
    """Percentage, null unless the whole is positive."""
    return F.when(whole > 0, part / whole * 100)
