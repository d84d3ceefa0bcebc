"""Scalar text functions as native columns."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode whitespace class, as a regex character-class body.
WHITESPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
NON_SPACE = f"[^{WHITESPACE}]"
# The same class with its ASCII part first and the category looked up only beyond it,
# which is faster to match.
SPACE = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85[\x80-\u3000&&\p{Z}]]"


def tokens(text: Column) -> Column:
    """The whitespace-separated words of a text, in order."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def word_count(text: Column) -> Column:
    return F.array_size(tokens(text))


def char_count(text: Column) -> Column:
    """Length in code points."""
    return F.length(text)


def slice_text(text: Column, start: int, stop: int) -> Column:
    """Code points `start` (inclusive) to `stop` (exclusive), both from zero."""
    if start < 0 or stop < start:
        raise ValueError("need 0 <= start <= stop")
    return F.substring(text, start + 1, stop - start)


def is_blank(text: Column) -> Column:
    """True for a text without any non-whitespace character; null stays null."""
    return ~F.rlike(text, F.lit(NON_SPACE))


def trim_text(text: Column) -> Column:
    """Remove surrounding whitespace of any Unicode kind."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def document_key(dataset: Column, document: Column, chunk: Column) -> Column:
    return F.format_string("%s_doc-%d_chunk-%d", dataset, document, chunk)


def sample_key(seed: int, *keys: Column) -> Column:
    """A repeatable pseudo-random sort key for each row."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def render_template(template: str, **values: Column) -> Column:
    """Fill `{name}` placeholders with columns.

    The template is cut apart here, before any document is seen, so braces inside a
    document are never read as placeholders.
    """
    parts: list[Column] = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is not None:
            parts.append(values[field].cast("string"))
    return F.concat(*parts)


def parse_json_list(reply: Column) -> Column:
    """A JSON list of strings as an array; null when the reply is anything else."""
    return F.when(F.rlike(reply, F.lit(rf"^{SPACE}*\[")), F.from_json(reply, "array<string>"))
