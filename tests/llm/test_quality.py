"""Quality rules against a plain recount, and the ratio against its formula."""

import math
import re
from collections import Counter

import pytest

from lexspan.llm.quality import Quality, judge, op2_quality_rules

DOCS = "doc_id long, text string, llr string, n_words string"


def recount(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered.update(range(i, i + 5))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered), failed,
    )


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]

TEXTS = [
    None, "", " \n\t ", "one", "a a a a a a", "a b c d e a b c d e f", "x y\nx y\n\nx y\n", "#*$%&|<>\n#",
    "\x0b1\x0c2\r3 4\x1c5\x856\xa07", "\U0001f600\U0001f600 é́ z", "tie tie", "tie tie",
    "p q r s t u v w x y z p q r s t u v w x y", " ".join(f"w{i % 997}" for i in range(30000)),
    " ".join(f"u{i}" for i in range(20000)), "a b c d e" * 3, "\n".join(["same line here"] * 50),
]


def test_edges(spark):
    docs = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, "no id at all " * 9, "x", "y")]
    trusted = spark.createDataFrame([(14,), (14,), (None,), (999,)], "doc_id long")
    rows = judge(spark.createDataFrame(docs, DOCS).repartition(3), trusted).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r[f] for f in FIELDS) == recount(r.text), r.text
        assert not (r.base_failed and r.kept)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    ids = spark.createDataFrame([], "doc_id long")
    assert judge(none, ids).count() == 0
    rows = judge(spark.createDataFrame([(1, "w " * 3 + " ".join("abcdefghijk"), "", "")], DOCS), ids).collect()
    assert rows[0].llr == 0.0 and rows[0].kept


def test_ratio_is_that_of_the_counts(spark):
    """Without collisions, buckets are words and pairs."""
    texts = {1: "good text reads well", 2: "bad $$$ $$$", 3: "good bad text"}
    docs = spark.createDataFrame([(i, t, "", "") for i, t in texts.items()], DOCS)
    how = Quality(buckets=1 << 18)
    got = {r.doc_id: r.llr for r in judge(docs, spark.createDataFrame([(1,)], "doc_id long"), how).collect()}
    grams = {i: (w := t.split()) + list(zip(w, w[1:], strict=False)) for i, t in texts.items()}
    raw, own = Counter(g for x in grams.values() for g in x), Counter(grams[1])
    extra = how.smoothing * how.buckets
    for i, x in grams.items():
        want = sum(
            math.log((own[g] + 1) / (sum(own.values()) + extra)) - math.log((raw[g] + 1) / (sum(raw.values()) + extra))
            for g in x
        )
        assert got[i] == pytest.approx(want / len(x), abs=1e-6)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[f] for f in FIELDS) == recount(texts[r.doc_id])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    judged = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels and not r.base_failed]
    good, bad = [k for k, q in judged if q], [k for k, q in judged if not q]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.3 * len(bad)
