import pytest
from pyspark.sql import functions as F

from lexspan.functions import splitters
from lexspan.functions import text as tx
from lexspan.functions import vectors as vx

ODD = ["", " ", " ", "\u0085a", "a\u001cb", " x　y\n", "one two", "  lead", "tail \t", None]


def test_words_follow_unicode_whitespace(one):
    assert one(tx.word_count(F.col("x")), ODD) == [None if s is None else len(s.split()) for s in ODD]
    assert one(tx.tokens(F.col("x")), ODD) == [None if s is None else s.split() for s in ODD]


def test_blank_and_trim(one):
    assert one(tx.is_blank(F.col("x")), ODD) == [None if s is None else not s.strip() for s in ODD]
    assert one(tx.trim_text(F.col("x")), ODD) == [None if s is None else s.strip() for s in ODD]


def test_lengths_and_slices_count_code_points(one):
    texts = ["", "a", "😀b😀c", "éte", "abcdefgh"]
    assert one(tx.char_count(F.col("x")), texts) == [len(t) for t in texts]
    assert one(tx.slice_text(F.col("x"), 1, 3), texts) == [t[1:3] for t in texts]


def test_template_ignores_braces_in_documents(one):
    prompt = tx.render_template("{{q}} {document_text}: {num_queries}", document_text=F.col("x"), num_queries=F.lit(5))
    assert one(prompt, ["has {num_queries} and }{"]) == ["{q} has {num_queries} and }{: 5"]


def test_json_list(one):
    replies = ['["a","b"]', "[]", ' ["c"]', '["a"', "text", '{"a":1}', None, ""]
    expected = [["a", "b"], [], ["c"], None, None, None, None, None]
    assert one(tx.parse_json_list(F.col("x")), replies) == expected


def test_whitespace_split_drops_an_unfinished_word(one):
    texts = ["one two", "one two ", " a\n\nb c", "word", "", "  "]
    expected = [["one"], ["one", "two"], ["a", "b"], [], [], []]
    assert one(splitters.whitespace_split(F.col("x")), texts) == expected


def test_sentence_split(one):
    texts = [
        "It rained all day. Nobody left the house! Would it stop by night? Perhaps, they thought.",
        "Mr. Smith v. J. K. Jones was heard. No. 5 applies, cf. e.g. the Act.",
        'He said "Stop." Then (as noted.) he left.',
        "no closing mark",
        "One.Two. \n\n Three?!  Four…",
        "   ",
        "",
        None,
    ]
    expected = [
        [
            "It rained all day.",
            "Nobody left the house!",
            "Would it stop by night?",
            "Perhaps, they thought.",
        ],
        ["Mr. Smith v. J. K. Jones was heard.", "No. 5 applies, cf. e.g. the Act."],
        ['He said "Stop."', "Then (as noted.)", "he left."],
        ["no closing mark"],
        ["One.Two.", "Three?!", "Four…"],
        [],
        [],
        None,
    ]
    assert one(splitters.sentence_split(F.col("x")), texts) == expected


def test_sentences_keep_every_word(one):
    text = "A b c. D e! F (g.) h? I. J k"
    [parts] = one(splitters.sentence_split(F.col("x")), [text])
    assert " ".join(parts).split() == text.split()


def test_vector_functions(one):
    def pair(fn, a, b):
        column = fn(F.col("x"), F.array(*[F.lit(v) for v in b]))
        return one(column, [a], "array<double>")[0]

    assert pair(vx.cosine, [1.0, 0.0], [1.0, 1.0]) == pytest.approx(0.5**0.5)
    assert pair(vx.cosine, [0.0, 0.0], [1.0, 1.0]) == 0.0
    assert pair(vx.l2_squared, [1.0, 2.0], [3.0, 5.0]) == 13.0
    assert pair(vx.l2_squared, [1.0, 2.0], [3.0]) is None
    assert one(vx.dummy_vector(3), [""]) == [[1.0, 1.0, 1.0]]


def test_whitespace_class_is_that_of_python(spark):
    # Every character of the basic plane except surrogates, between two letters.
    codes = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c, f"a{chr(c)}b") for c in codes], "c int, x string")
    got = rows.select("c", tx.word_count(F.col("x")).alias("n"), tx.is_blank(F.substring(F.col("x"), 2, 1)).alias("b")).collect()
    spaces = {c for c in codes if chr(c).isspace()}
    assert {r.c for r in got if r.n == 2} == spaces
    assert {r.c for r in got if r.b} == spaces
