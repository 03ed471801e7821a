"""Jaro and Jaro-Winkler similarity, which Spark has no function for, as Arrow-batched pandas functions."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from mapweave.functions.text import normalize


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = list(b)
    taken: list[int] = []
    left: list[str] = []
    for i, c in enumerate(a):
        lo = max(0, i - reach)
        try:
            j = free.index(c, lo, max(lo, min(len(b), i + reach + 1)))
        except ValueError:
            continue
        free[j] = ""  # equal to no character
        taken.append(j)
        left.append(c)
    if not left:
        return 0.0
    moved = sum(x != b[j] for x, j in zip(left, sorted(taken)))
    m = len(left)
    return (m / len(a) + m / len(b) + (m - moved / 2) / m) / 3


def _jaro_winkler(a: str, b: str, weight: float) -> float:
    base, same = _jaro(a, b), 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return base + same * weight * (1 - base)


@F.pandas_udf(DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_jaro(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def _winkler(a: pd.Series, b: pd.Series, weight: pd.Series) -> pd.Series:
    return pd.Series([_jaro_winkler(x or "", y or "", w) for x, y, w in zip(a, b, weight)], dtype="float64")


def jaro_winkler(a: Column, b: Column, weight: float = 0.1) -> Column:
    return _winkler(a, b, F.lit(weight))


def jaro_winkler_match(a: Column, b: Column, threshold: float = 0.85, weight: float = 0.1) -> Column:
    """On normalised texts; raw empty texts match nothing."""
    some = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return some & (jaro_winkler(normalize(a), normalize(b), weight) >= threshold)
