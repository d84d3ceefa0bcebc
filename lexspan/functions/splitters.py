"""Splitters: a text column in, an array-of-strings column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspan.functions.text import NON_SPACE, SPACE

# Words whose final full stop does not end a sentence.
ABBREVIATIONS = (
    "Mr", "Mrs", "Ms", "Dr", "Prof", "Hon", "Rev", "St", "Jr", "Sr",
    "Inc", "Ltd", "Co", "Corp", "Bros", "No", "Nos", "Art", "Sec", "Vol",
    "v", "vs", "s", "ss", "c", "p", "pp", "para", "paras", "cf", "etc",
    "e.g", "i.e", "al", "Jan", "Feb", "Mar", "Apr", "Jun", "Jul", "Aug",
    "Sept", "Sep", "Oct", "Nov", "Dec",
)

# Fixed value: marks that may stand between the closing stop and the blank.
CLOSERS = r"""["'”’»)\]}]"""


def whitespace_split(text: Column) -> Column:
    """Runs of non-whitespace that are followed by whitespace (a last word is not)."""
    return F.regexp_extract_all(text, F.lit(f"({NON_SPACE}+){SPACE}"), F.lit(1))


def sentence_split(text: Column, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """Sentences by rule: `.`, `!` or `?`, closing marks, then whitespace.

    A full stop after a listed abbreviation or a single capital letter does not end
    a sentence. Whitespace between sentences is dropped.
    """
    words = "|".join(a.replace(".", r"\.") for a in abbreviations)
    kept = rf"(?<!(?:^|[^\p{{L}}\p{{N}}.])(?:{words}|\p{{Lu}})\.)"
    stop = rf"(?<=[!?])|(?<=\.){kept}|(?<=[.!?]{CLOSERS}{{1,4}})"
    # Most characters fail the first test, and most blanks the second.
    boundary = rf"(?={SPACE})(?:(?:\A|(?<=[.!?]|{CLOSERS})(?:{stop})){SPACE}+|{SPACE}++\z)"
    return F.array_remove(F.split(text, boundary), "")
