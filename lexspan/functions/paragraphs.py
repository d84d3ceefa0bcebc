"""Numbered-paragraph markers of court decisions.

A marker is whitespace, then `[12]` or `12`, then one blank. Matches do not overlap
and are found from left to right.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspan.functions.text import SPACE

# The two marker patterns; group 1 of each is the paragraph number.
BRACKETED_MARKER = rf"{SPACE}\[(\p{{Nd}}+)\][ ]"
SPACE_MARKER = rf"{SPACE}(\p{{Nd}}+)[ ]"
ANY_MARKER = rf"{SPACE}\[\p{{Nd}}+\][ ]|{SPACE}\p{{Nd}}+[ ]"

BRACKETED = "BRACKETED"
SPACED = "SPACE"
NO_MARKERS = "No paragraph markers found"


def paragraph_markers(text: Column) -> Column:
    """Every marker of either kind, as matched."""
    return F.regexp_extract_all(text, F.lit(ANY_MARKER), F.lit(0))


def first_marker(text: Column) -> Column:
    """The first marker of either kind; empty when there is none."""
    return F.regexp_extract(text, f"({ANY_MARKER})", 1)


def style_of_marker(marker: Column) -> Column:
    return F.when(marker.contains("["), F.lit(BRACKETED)).when(marker != "", F.lit(SPACED))


def paragraph_style(text: Column, prefer_bracketed: bool = False) -> Column:
    """The style of the first marker; null when there is none.

    With `prefer_bracketed` one bracketed marker anywhere decides, so that years and
    other bare numbers in a header do not.
    """
    if prefer_bracketed:
        return F.when(F.rlike(text, F.lit(BRACKETED_MARKER)), F.lit(BRACKETED)).when(
            F.rlike(text, F.lit(SPACE_MARKER)), F.lit(SPACED)
        )
    return style_of_marker(first_marker(text))


def _cut(text: Column, marker: str) -> Column:
    ahead = marker.replace("(", "(?:", 1)
    # The marker is consumed and the body is not, as in a left-to-right search; the
    # first alternative is the text before the first marker.
    piece = rf"(?s)(?:\A(?!{ahead})|{ahead}).*?(?={ahead}|\z)"
    pieces = F.regexp_extract_all(text, F.lit(piece), F.lit(0))

    def entry(p: Column) -> Column:
        return F.struct(
            F.when(F.rlike(p, F.lit(rf"\A{marker}")), F.regexp_extract(p, rf"\A{marker}", 1)).alias(
                "number"
            ),
            F.regexp_replace(p, rf"\A{ahead}", "").alias("body"),
        )

    return F.transform(pieces, entry)


def paragraph_split(text: Column, style: Column) -> Column:
    """Array of `{number, body}`; the text before the first marker has a null number."""
    return F.when(style == BRACKETED, _cut(text, BRACKETED_MARKER)).when(
        style == SPACED, _cut(text, SPACE_MARKER)
    )
