"""String and vector similarities: built-in expressions where there are any, Arrow UDFs elsewhere."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.session import ship_active


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def indel_ratio(a: str | None, b: str | None) -> float | None:
    """100 * 2 * LCS / (len a + len b); two empty texts are alike; null where either is null."""
    if a is None or b is None:
        return None
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * common_subsequence(a, b) / total


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """``indel_ratio`` of two columns."""
    ship_active()
    return _ratio(a, b)


def sorted_tokens(x: Column) -> Column:
    """The words of ``x`` in alphabetical order."""
    return F.array_join(F.array_sort(F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(sorted_tokens(a), sorted_tokens(b))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared elements over the smaller set; 0 where either is null or empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.coalesce(F.when(least > 0, F.size(F.array_intersect(a, b)) / least), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null where a vector is null or zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))
