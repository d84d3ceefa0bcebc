"""Parse documents: header metadata, numbered paragraphs, and an error table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.functions.headers import header_body, header_metadata
from lexspan.functions.paragraphs import (
    NO_MARKERS,
    first_marker,
    paragraph_markers,
    paragraph_split,
    paragraph_style,
    style_of_marker,
)
from lexspan.operators.filters import drop_empty_text
from lexspan.schema import TEXT_EN


def markers(df: DataFrame, keys: list[str], text_col: str = TEXT_EN) -> DataFrame:
    found = paragraph_markers(F.col(text_col))
    return df.select(*keys, F.posexplode(found).alias("pos", "marker"))


def styled(
    df: DataFrame, text_col: str = TEXT_EN, prefer_bracketed: bool = False
) -> DataFrame:
    """Add `style` to every non-empty document.

    With `prefer_bracketed` the header block is left out of the text first.
    """
    texts = drop_empty_text(df, text_col, "empty")
    if prefer_bracketed:
        bodies = texts.withColumn(text_col, header_body(F.col(text_col)))
        return bodies.withColumn("style", paragraph_style(F.col(text_col), True))
    # The marker has a column of its own so that it is searched for once.
    marked = texts.withColumn("_marker", first_marker(F.col(text_col)))
    return marked.withColumn("style", style_of_marker(F.col("_marker"))).drop("_marker")


def paragraph_errors(df: DataFrame, text_col: str = TEXT_EN) -> DataFrame:
    """Non-empty documents without any marker."""
    return (
        styled(df, text_col)
        .where(F.col("style").isNull())
        .select("citation_en", "citation_fr", "url_en", F.lit(NO_MARKERS).alias("error_message"))
    )


def paragraphs(
    df: DataFrame, keys: list[str], text_col: str = TEXT_EN, prefer_bracketed: bool = False
) -> DataFrame:
    """Numbered paragraphs of every document that has a style.

    `pos` counts pieces from zero; the piece before the first marker has a null `number`.
    """
    pieces = paragraph_split(F.col(text_col), F.col("style"))
    cut = styled(df, text_col, prefer_bracketed).select(
        *keys, "style", F.posexplode(pieces).alias("pos", "piece")
    )
    return cut.select(*keys, "style", "pos", "piece.number", "piece.body")


def header_entries(df: DataFrame, keys: list[str], text_col: str = TEXT_EN) -> DataFrame:
    """One row per header label, in order."""
    return df.select(
        *keys, F.posexplode(header_metadata(F.col(text_col))).alias("pos", "entry")
    ).select(*keys, "pos", "entry.label", "entry.value")
