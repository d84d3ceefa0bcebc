"""Subject metadata in the header block of a decision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspan.functions.text import trim_text

# Labels that stand alone on a header line, with values below them.
LABELS = (
    "Collection",
    "Court (s) Database",
    "Date",
    "Decision date",
    "Neutral citation",
    "Report",
    "Report citation",
    "Case number",
    "Docket numbers",
    "File numbers",
    "File number(s)",
    "Reference number",
    "Judges",
    "Judges and Taxing Officers",
    "Decision-maker(s)",
    "Decision-makers",
    "Member",
    "Division",
    "Decision",
    "Decision type",
    "Decision status",
    "Related decisions",
    "Grounds",
    "Subject",
    "Subjects",
    "On appeal from",
    "Notes",
)

# English labels of the bilingual form header.
FORM_LABELS = (
    "Private Proceeding / Huis clos",
    "Claimant(s)",
    "Appellant(s)",
    "Person who is the subject of the appeal",
    "Appeal Considered/Heard at",
    "Appeal considered / heard at",
    "Date(s) of Hearing",
    "Place of Hearing",
    "Date of Decision",
    "Date of decision",
    "Panel",
    "Claimant's Counsel",
    "Appellant's Counsel",
    "Counsel for the person who is the subject of the appeal",
    "Tribunal Officer",
    "Designated Representative",
    "Designated Representative(s)",
    "Designated representative",
    "Minister's Counsel",
    "Counsel for the Minister",
)

# Fixed value: the line that ends a label/value header.
END_OF_HEADER = "Decision Content"

LABELLED = "LABEL_LINES"
INLINE = "INLINE"
FORM = "FORM"

# One `Label: value` line.
_INLINE_LINE = r"(?m)^([\p{L}][\p{L}()'’ ]{0,60}): (\S.*)$"
# The start of the first numbered paragraph of a body.
_FIRST_PARAGRAPH = "\n[1] "


def header_layout(text: Column) -> Column:
    """Which of the three header layouts a text opens with; null when none."""
    head = _head(text)
    return (
        F.when(_end_of_header(text) > 0, F.lit(LABELLED))
        .when(F.rlike(head, F.lit(_INLINE_LINE)), F.lit(INLINE))
        .when(F.rlike(head, F.lit(_label_line(FORM_LABELS))), F.lit(FORM))
    )


def _end_of_header(text: Column) -> Column:
    """Where the line that ends a label-line header starts, or zero."""
    line = F.lit(f"\n{END_OF_HEADER}")
    inside = F.instr(text, F.concat(line, F.lit("\n")))
    at_end = F.length(text) - F.length(line) + 1
    return F.when(inside > 0, inside).when(F.endswith(text, line), at_end).otherwise(0)


def _head(text: Column) -> Column:
    """The text before paragraph `[1]`; empty when there is no such paragraph."""
    return F.substring(text, F.lit(1), F.instr(text, F.lit(_FIRST_PARAGRAPH)) - 1)


def _label_line(labels: tuple[str, ...]) -> str:
    escaped = "|".join(label.replace("(", r"\(").replace(")", r"\)") for label in labels)
    return rf"(?m)^({escaped})$"


def _labelled_entries(block: Column, labels: tuple[str, ...]) -> Column:
    """`{label, value}` for each known label line and the lines below it."""
    line = _label_line(labels)
    pieces = F.split(block, line.replace("(?m)", "(?m)(?=", 1) + ")")

    def entry(piece: Column) -> Column:
        label = F.substring_index(piece, "\n", 1)
        value = F.substring(piece, F.length(label) + 1, F.length(piece))
        return F.struct(label.alias("label"), trim_text(value).alias("value"))

    labelled = F.filter(pieces, lambda p: F.rlike(p, F.lit(line.replace("^", r"\A", 1))))
    return F.transform(labelled, entry)


def header_metadata(text: Column) -> Column:
    """Array of `{label, value}` in header order.

    In the label-line layout the first line is the title and is returned under
    `Title`. Texts without a known header give an empty array.
    """
    layout = header_layout(text)
    block = F.substring(text, F.lit(1), _end_of_header(text) - 1)
    title = F.array(
        F.struct(F.lit("Title").alias("label"), F.substring_index(block, "\n", 1).alias("value"))
    )
    head = _head(text)
    inline = F.transform(
        F.regexp_extract_all(head, F.lit(_INLINE_LINE), F.lit(0)),
        lambda line: F.struct(
            F.regexp_extract(line, _INLINE_LINE, 1).alias("label"),
            F.regexp_extract(line, _INLINE_LINE, 2).alias("value"),
        ),
    )
    none = F.array().cast("array<struct<label:string,value:string>>")
    return (
        F.when(layout == LABELLED, F.concat(title, _labelled_entries(block, LABELS)))
        .when(layout == INLINE, inline)
        .when(layout == FORM, _labelled_entries(head, FORM_LABELS))
        .otherwise(none)
    )


def header_body(text: Column) -> Column:
    """The text after the header block; the whole text when there is none."""
    after = _end_of_header(text) + len(END_OF_HEADER) + 2
    first = F.instr(text, F.lit(_FIRST_PARAGRAPH)) + 1
    layout = header_layout(text)
    start = F.when(layout == LABELLED, after).when(layout.isNotNull(), first).otherwise(1)
    return F.substring(text, start, F.length(text))
