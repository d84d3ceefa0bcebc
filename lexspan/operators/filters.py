"""Filters and projections over documents."""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions.text import is_blank
from lexspan.schema import AUDIT_COLUMNS, TEXT_EN, TEXT_FR, TEXTS


def has_text(text: Column, mode: str = "blank") -> Column:
    """Keep test: `blank` wants a non-whitespace character, `empty` any character,
    `null` any value."""
    # Never null, so that it can be negated, and simple enough for the scan to use.
    if mode == "blank":
        return text.isNotNull() & ~is_blank(text)
    if mode == "empty":
        return text.isNotNull() & (text != "")
    if mode == "null":
        return text.isNotNull()
    raise ValueError(f"mode must be blank, empty or null, not {mode!r}")


def drop_empty_text(df: DataFrame, text_col: str = TEXT_EN, mode: str = "blank") -> DataFrame:
    return df.where(has_text(F.col(text_col), mode))


def skipped_audit(df: DataFrame, *keys: str, text_col: str = TEXT_EN) -> DataFrame:
    """The rows that `drop_empty_text` drops, by their identifying columns."""
    return df.where(~has_text(F.col(text_col))).select(*keys, *AUDIT_COLUMNS)


def project_metadata(df: DataFrame, nested: bool = False) -> DataFrame:
    """Every column but the two texts, flat or as one struct."""
    flat = df.drop(*TEXTS)
    return flat.select(F.struct(*flat.columns).alias("metadata")) if nested else flat


def filter_datasets(df: DataFrame, included: Iterable[str], column: str = "dataset") -> DataFrame:
    return df.where(F.col(column).isin(*included))


def filter_min_year(
    df: DataFrame, min_year: int = 2000, column: str = "document_date_en"
) -> DataFrame:
    """Documents of `min_year` or later, as a range the scan can push down."""
    return df.where(F.col(column) >= F.lit(datetime.date(min_year, 1, 1)))


def unpivot_languages(df: DataFrame, en_only: bool = True) -> DataFrame:
    """One row per non-empty body with `chunk_language` and `text`.

    `en_only` skips documents without an English body; the French body of a document
    that has both is kept.
    """
    if en_only:
        df = drop_empty_text(df)
    bodies = F.filter(
        F.array(
            F.struct(F.lit("en").alias("chunk_language"), F.col(TEXT_EN).alias("text")),
            F.struct(F.lit("fr").alias("chunk_language"), F.col(TEXT_FR).alias("text")),
        ),
        lambda body: F.length(body["text"]) > 0,
    )
    keep = [c for c in df.columns if c not in TEXTS]
    return df.select(*keep, F.inline(bodies))


def text_prefixes(text: Column, step: int = 50, count: int = 5) -> Column:
    """The first `step`, `2 * step`, ... code points of a text, as an array."""
    return F.transform(
        F.sequence(F.lit(1), F.lit(count)), lambda i: F.substring(text, F.lit(1), i * step)
    )
