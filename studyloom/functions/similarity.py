"""Sequence similarity: the one scalar that Spark has no built-in for."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def at_least(a: str, b: str, least: float) -> bool:
    """Whether the ratio of a to b reaches `least`; upper bounds decide most pairs first."""
    if a == b:
        return True
    if not a and not b:
        return True
    if 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
        return False
    m = difflib.SequenceMatcher(None, a, b)
    return m.quick_ratio() >= least and m.ratio() >= least


def ratio(a: Column, b: Column) -> Column:
    """difflib's ratio, which depends on the order of its arguments."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    return F.pandas_udf(run, "double")(a, b)
