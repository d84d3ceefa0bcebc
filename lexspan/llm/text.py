"""Native expressions over whole texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space between words, as a Java pattern and as characters.
SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def places(size: Column, width: int) -> Column:
    """The 0-based first places of all windows of `width` in an array of `size`."""
    return F.when(size >= width, F.sequence(F.lit(0), size - width)).otherwise(F.array().cast("array<int>"))


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that meet a condition on columns that were costly to compute.

    A plain filter is pushed below the columns it reads, which then are computed again, and within
    lambda functions once for every element. It is not pushed past a row number.
    """
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    return numbered.filter(condition & (F.col("_row") >= 0)).drop("_row")
