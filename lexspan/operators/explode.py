"""Explode an array column that was costly to make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_once(df: DataFrame, array_col: str, pos: str, value: str) -> DataFrame:
    """`posexplode` of `array_col`; empty and null arrays give no rows.

    For a plain explode of a column the optimizer adds a test for empty arrays and
    pushes it down to the scan, where the array (and a model behind it) would be
    computed a second time. The outer form has no such test.
    """
    keep = [c for c in df.columns if c != array_col]
    rows = df.select(*keep, F.posexplode_outer(array_col).alias(pos, value))
    return rows.where(F.col(pos).isNotNull())
