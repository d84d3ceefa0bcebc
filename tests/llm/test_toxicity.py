"""Toxicity: held-out recall and false alarms; edges."""

import zlib

import numpy as np

from lexspan.llm.toxicity import Toxicity, learn, op8_toxicity, score_toxicity, windows

DOCS = "doc_id long, text string, score string, predicted string"


def corpus(n=300):
    rng = np.random.default_rng(9)
    plain = [f"{a}{b}" for a in ("ba", "co", "du", "fe", "gi", "lo") for b in ("ran", "sel", "tir", "mon", "puk")]
    bad = ["nitwit", "dunderhead", "blockhead"]
    rows = []
    for i in range(n):
        words = list(rng.choice(plain, 60))
        if i % 3 == 0:
            for w in rng.choice(bad, 3):
                words.insert(int(rng.integers(60)), str(w))
        rows.append((" ".join(words), int(i % 3 == 0)))
    return rows


def test_windows_hold_all_words():
    text = b"Some words, and More.\n\nwords \xc3\xa9!" * 20
    assert b"".join(windows(text, 40)).split() == b"some words and more words \xc3\xa9".split() * 0 + [
        w for w in text.lower().replace(b",", b" ").replace(b".", b" ").replace(b"!", b" ").split()
    ]
    assert windows(None, 40) == windows(b" .\n", 40) == []


def test_edges(spark):
    rows = corpus()
    model = learn(spark.createDataFrame(rows[:240], "text string, toxic int"))
    texts = [None, "", " ..", rows[-3][0], rows[-1][0], "tie " + rows[-3][0], "tie " + rows[-3][0], rows[-1][0] * 300, "é\U0001f600\x00"]
    asked = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)] + [(None, "x", "", "")], DOCS)
    got = {r.doc_id: r for r in score_toxicity(asked, model).collect()}
    assert len(got) == len(texts) + 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert got[0].score == got[1].score == got[2].score < 0.3
    assert got[3].predicted == got[5].predicted == 1 and got[4].predicted == got[7].predicted == 0
    unseen = spark.createDataFrame([(i, t, "", "") for i, (t, _) in enumerate(rows[240:])], DOCS)
    right = [r.predicted == rows[240 + r.doc_id][1] for r in score_toxicity(unseen, model).collect()]
    assert np.mean(right) > 0.95


def test_nothing_to_learn(spark):
    model = learn(spark.createDataFrame([], "text string, toxic int"))
    asked = spark.createDataFrame([(1, "some text", "", "")], DOCS)
    assert score_toxicity(asked, model).collect()[0].predicted == 0
    assert score_toxicity(spark.createDataFrame([], DOCS), model).count() == 0
    one = learn(spark.createDataFrame([("some text", 1), (None, 0)], "text string, toxic int"), Toxicity())
    assert 0 <= score_toxicity(asked, one).collect()[0].score <= 1


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op8_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    unseen = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    toxic, clean = [p for t, p in unseen if t], [p for t, p in unseen if not t]
    # About a tenth of the labelled texts here hold no insult; 1,500 labels would find more of the rest.
    assert np.mean(toxic) > 0.65 and np.mean(clean) < 0.05
