"""Language identification: held-out accuracy, and what is never looked at."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from lexspan.llm.langid import LanguageModel, _training_rows, family_of, identify, learn, op6_language_id, train_svm

DOCS = "doc_id long, text string, lang string, lang_pred string, h string"

WORDS = {
    "en": "the quick brown fox jumps over lazy dogs while they were thinking about shiny things",
    "de": "der schnelle braune fuchs springt über faule hunde während sie noch nachdenken müssen",
    "fr": "le rapide renard brun saute par dessus les chiens paresseux pendant qu'ils pensent",
    "es": "el rápido zorro marrón salta sobre los perros perezosos mientras ellos están pensando",
    "ru": "быстрая коричневая лиса прыгает через ленивых собак пока они думают о вещах",
}


def corpus(n=40):
    rng = np.random.default_rng(4)
    docs = []
    for i in range(n * len(WORDS)):
        lang = list(WORDS)[i % len(WORDS)]
        docs.append((i, " ".join(rng.choice(WORDS[lang].split(), 8)), lang, "x", "y"))
    return docs


def test_machine_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5)).astype(np.float32)
    y = np.where(x @ np.array([1, -2, 0.5, 0, 0]) > 0, 1.0, -1.0)
    w, bias = train_svm(x, y, LanguageModel(epochs=30))
    assert np.mean(np.sign(x @ w + bias) == y) > 0.97


def test_families():
    assert family_of("en") == family_of("de-AT") == "germanic" and family_of("fr") == family_of("es")
    assert family_of("xx") != family_of("yy")


def test_edges(spark):
    docs = spark.createDataFrame([*corpus(), (900, "abc def", None, "", ""), (901, None, "en", "", "")], DOCS)
    machines = learn(docs)
    assert {m["level"] for m in machines} == {"language", "family", "pair"}
    assert [(m["a"], m["b"]) for m in machines if m["level"] == "pair"] == [("de", "en"), ("es", "fr")]
    texts = [None, "", " ", "123 + 4 = 127 !?", "½ ² Ⅷ", "the dogs were thinking " * 20000, "die hunde springen über", "tie the fox", "tie the fox", "лиса"]
    asked = spark.createDataFrame([(i, t, "zz", "", "") for i, t in enumerate(texts)] + [(None, "le rapide renard", None, "", "")], DOCS)
    got = sorted(map(tuple, identify(asked, machines).collect()), key=repr)
    by = {d: (lang, s) for d, lang, s in got}
    assert len(got) == len(texts) + 1 and all(0 <= s <= 1 for _, _, s in got)
    assert all(by[i] == ("und", 0.0) for i in range(5))
    assert [by[i][0] for i in range(5, 10)] == ["en", "de", "en", "en", "ru"] and by[None][0] == "fr"


def test_held_out_rows_are_not_learnt(spark):
    rows = corpus(20)
    spoilt = [(d, t, "zz" if zlib.crc32(str(d).encode()) % 4 == 2 else lang, a, b) for d, t, lang, a, b in rows]
    assert learn(spark.createDataFrame(rows, DOCS)) == learn(spark.createDataFrame(spoilt, DOCS))


def test_sample_is_that_of_the_smallest_hashes(spark):
    how = LanguageModel(sample=20)
    # One language holds most rows, another fewer than the sample; texts are of any length.
    rows = [(i, f"text number {i} " * (1 + 400 * (i % 50 == 0)), "en" if i % 40 else "de", "", "") for i in range(4000)]
    rows += [(9000 + i, "das sind wenige", "nl", "", "") for i in range(7)]
    rows += [(None, "dieselbe Zeile", "de", "", "")] * 3000
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = _training_rows(docs, how).select("lang", "h").collect()
    hashed = docs.select("doc_id", "lang", F.xxhash64("doc_id", "text").alias("h")).collect()
    for lang in ("en", "de", "nl"):
        own = sorted({r.h for r in hashed if r.lang == lang and (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 != 2)})
        assert sorted(r.h for r in got if r.lang == lang) == own[: how.sample]


def test_very_long_text_in_the_sample(spark):
    rows = [(1, "the dogs were thinking " * 100_000, "en", "", ""), (2, "die hunde springen", "de", "", "")]
    rows += [(10 + i, *r[1:]) for i, r in enumerate(corpus(4))]
    machines = learn(spark.createDataFrame(rows, DOCS))
    asked = spark.createDataFrame([(5, "the dogs were thinking", "", "", "")], DOCS)
    assert identify(asked, machines).collect()[0].lang_pred == "en"


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], DOCS)
    assert learn(none) == []
    asked = spark.createDataFrame([(1, "some text", "en", "", "")], DOCS)
    assert identify(asked, []).collect()[0].lang_pred == "und"
    one = learn(spark.createDataFrame([(i, "some text", "en", "", "") for i in range(9)], DOCS))
    assert identify(asked, one).collect()[0].lang_pred == "en" and identify(none, one).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_language_id(spark, sf).collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in unseen]) > 0.97
