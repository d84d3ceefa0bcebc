"""Joins for keys that may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int, how: str = "left") -> DataFrame:
    """Join on `keys`, which are unique in `right`; `left` has a column `_salt` from 0 to `salts` - 1."""
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(spread, [*keys, "_salt"], how)
