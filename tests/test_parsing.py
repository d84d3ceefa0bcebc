import re

from pyspark.sql import functions as F

from lexspan.functions import headers, paragraphs
from lexspan.plans import parsing

MARKER = re.compile(r"(\s\[\d+\][ ])|(\s\d+[ ])")

LABELLED = """Roe v. Smith Inc.
Collection
Decisions of the Court
Date
2025-04-09
Neutral citation
2025 COURT 271
Grounds
National or Ethnic Origin
Race
Decision Content
CITATION: Roe v. Smith Inc., 2025 COURT 271
[1] It appears that 3 persons did not read.
[2] It was up to them.
"""
INLINE = """2023 XY 36

Citation: 2023 XY 36
Panel: A. Person
Associated Number(s): T-1, T-2

DECISION

[1] MEMBER: So I have considered it.

[2] The claim: is rejected."""
FORM = """
File No. / N° de dossier :
MB3-1
Private Proceeding / Huis clos
Panel
Tribunal
Me D. Person
Date of Decision
September 19, 2013
[1] The Division received a notice.
[2] The claim was referred."""

TEXTS = [
    LABELLED,
    INLINE,
    FORM,
    "",
    "no markers",
    "[1] at the very start [2] next",
    " 1 2 3 4 x",
    "a [1] b 7 c [2] d",
    "a 7 c [2] d",
    "tab\t[12] x 5 y",
    "end [3]",
]


def test_markers_are_those_of_a_left_to_right_search(one):
    want = [[m.group() for m in MARKER.finditer(t)] for t in TEXTS]
    assert one(paragraphs.paragraph_markers(F.col("x")), TEXTS) == want


def test_style_is_that_of_the_first_marker(one):
    def style(text):
        first = MARKER.search(text)
        return None if first is None else "BRACKETED" if first.group(1) else "SPACE"

    assert one(paragraphs.paragraph_style(F.col("x")), TEXTS) == [style(t) for t in TEXTS]
    preferred = one(paragraphs.paragraph_style(F.col("x"), prefer_bracketed=True), TEXTS)
    assert preferred[0] == preferred[8] == "BRACKETED" and preferred[6] == "SPACE"


def test_pieces_rebuild_the_text(one):
    for style, pattern in (("BRACKETED", r"\s\[(\d+)\][ ]"), ("SPACE", r"\s(\d+)[ ]")):
        got = one(paragraphs.paragraph_split(F.col("x"), F.lit(style)), TEXTS)
        for text, pieces in zip(TEXTS, got):
            cut = re.split(pattern, text)
            want = [(None, cut[0])] + list(zip(cut[1::2], cut[2::2]))
            # A text that opens with a marker has no piece before it.
            want = want[1:] if cut[0] == "" and len(cut) > 1 else want
            assert [(p.number, p.body) for p in pieces] == want


def test_split_of_a_very_long_text(one):
    text = "start" + "".join(f"\n[{i}] paragraph 7 of the text. " * 3 for i in range(60_000))
    [pieces] = one(paragraphs.paragraph_split(F.col("x"), F.lit("BRACKETED")), [text])
    assert len(pieces) == 180_001


def test_layouts_and_entries(one):
    assert one(headers.header_layout(F.col("x")), TEXTS[:5]) == ["LABEL_LINES", "INLINE", "FORM", None, None]
    got = one(headers.header_metadata(F.col("x")), TEXTS[:5])
    assert [tuple(e) for e in got[0]] == [
        ("Title", "Roe v. Smith Inc."),
        ("Collection", "Decisions of the Court"),
        ("Date", "2025-04-09"),
        ("Neutral citation", "2025 COURT 271"),
        ("Grounds", "National or Ethnic Origin\nRace"),
    ]
    assert [tuple(e) for e in got[1]] == [
        ("Citation", "2023 XY 36"),
        ("Panel", "A. Person"),
        ("Associated Number(s)", "T-1, T-2"),
    ]
    assert [tuple(e) for e in got[2]] == [
        ("Private Proceeding / Huis clos", ""),
        ("Panel", "Tribunal\nMe D. Person"),
        ("Date of Decision", "September 19, 2013"),
    ]
    assert got[3] == [] and got[4] == []


def test_bodies(one):
    got = one(headers.header_body(F.col("x")), TEXTS[:5])
    assert got[0].startswith("CITATION: Roe")
    assert got[1].startswith("[1] MEMBER") and got[2].startswith("[1] The Division")
    assert got[3] == "" and got[4] == "no markers"


def table(spark):
    rows = [(i, t, f"c{i}", None, f"u{i}") for i, t in enumerate(TEXTS + [None])]
    return spark.createDataFrame(
        rows, "k int, unofficial_text_en string, citation_en string, citation_fr string, url_en string"
    )


def test_errors_are_texts_without_markers(spark):
    got = parsing.paragraph_errors(table(spark)).collect()
    assert sorted(tuple(r) for r in got) == [
        ("c10", None, "u10", "No paragraph markers found"),
        ("c4", None, "u4", "No paragraph markers found"),
    ]


def test_preferring_brackets_skips_the_header(spark):
    rows = parsing.paragraphs(table(spark), ["k"], prefer_bracketed=True).where("k = 0").orderBy("pos")
    assert [(r.number, r.body[:12]) for r in rows.collect()] == [
        (None, "CITATION: Ro"),
        ("1", "It appears t"),
        ("2", "It was up to"),
    ]
