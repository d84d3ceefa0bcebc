import gc
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexspan.functions.splitters import sentence_split
from lexspan.operators.chunking import NaiveChunker, TopicChunker, chunk
from lexspan.operators.models import DummyModel, HashModel
from lexspan.operators.similarity import _adjacent, adjacent_similarity

ALPHABET = "ab é😀\n. "


def random_texts(n, longest, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(longest))) for _ in range(n)]


def chunks_of(spark, texts, chunker):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    found = {i: [] for i in range(len(texts))}
    for r in chunk(rows, chunker).orderBy("doc_id", "chunk_idx").collect():
        assert r.chunk_idx == len(found[r.doc_id])
        found[r.doc_id].append(r.unofficial_text)
    return [found[i] for i in range(len(texts))]


@pytest.mark.parametrize("size,overlap", [(10, 2), (10, 0), (10, 7), (3, 2), (512, 64)])
def test_naive_chunks(spark, size, overlap):
    step = size - overlap
    edges = ["x" * n for n in (0, 1, step - 1, step, step + 1, size, size + 1)]
    texts = edges + random_texts(30, 60) + [None]
    expected = [[t[i : i + size] for i in range(0, len(t or ""), step)] for t in [t or "" for t in texts]]
    got = chunks_of(spark, texts, NaiveChunker(size, overlap))
    assert got == expected
    assert [len(c) for c in got] == [math.ceil(len(t or "") / step) for t in texts]


def test_naive_chunks_of_a_very_long_text(spark):
    [got] = chunks_of(spark, ["ab c. " * 400_000], NaiveChunker())
    assert len(got) == math.ceil(2_400_000 / 448)
    assert "".join(c[:448] for c in got) == "ab c. " * 400_000


def test_overlap_must_leave_a_step():
    with pytest.raises(ValueError):
        NaiveChunker(10, 10)


def test_metadata_must_not_hide_chunk_columns(spark):
    rows = spark.createDataFrame([("a", 1)], "text string, chunk_idx int")
    with pytest.raises(ValueError):
        chunk(rows, NaiveChunker())


def test_metadata_travels(spark):
    rows = spark.createDataFrame([("abcdef", "m", 7)], "text string, name string, year int")
    got = chunk(rows, NaiveChunker(4, 1)).collect()
    assert [(r.name, r.year, r.chunk_idx, r.unofficial_text) for r in got] == [
        ("m", 7, 0, "abcd"),
        ("m", 7, 1, "def"),
    ]


def cosines(vectors):
    n = np.sqrt((vectors * vectors).sum(axis=1))
    after = np.roll(vectors, -1, axis=0)
    m = np.roll(n, -1)
    return (vectors * after).sum(axis=1) / np.maximum(n * m, 1e-8)


def greedy(sentences, sims, threshold, most):
    chunks, current, size = [], [], 0
    for i, sentence in enumerate(sentences):
        current.append(sentence)
        size += len(sentence)
        if i == len(sentences) - 1 or sims[i] < threshold or size >= most:
            chunks.append(" ".join(current))
            current, size = [], 0
    return chunks


@pytest.mark.parametrize("threshold,most", [(0.6, 1024), (0.3, 40), (-1.0, 25), (2.0, 1024)])
def test_topic_chunks(spark, threshold, most):
    rng = random.Random(3)
    words = ["court", "appeal", "tax", "claim", "the", "of"]
    texts = [
        " ".join(
            " ".join(rng.choices(words, k=rng.randrange(1, 6))) + "." for _ in range(rng.randrange(1, 40))
        )
        for _ in range(25)
    ] + ["", "  \n", None, "one sentence", "a. b"]
    model = HashModel(16)
    predict = model.make_predict_fn()
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    split = [r[0] for r in rows.select(sentence_split(F.col("x"))).collect()]
    expected = []
    for sentences in split:
        sims = cosines(predict(np.array(sentences)).astype(float)) if sentences else []
        expected.append(greedy(sentences, sims, threshold, most) if sentences else [])
    got = chunks_of(spark, texts, TopicChunker(model, threshold, most))
    assert got == expected
    assert [" ".join(c) for c in got] == [" ".join(s or []) for s in split]


def test_similarities_across_blocks(spark):
    # More sentences than one block holds, in one text and over many.
    texts = [" ".join(f"w{i % 7} w{i % 3}." for i in range(n)) for n in (5000, 1, 2, 0, 3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    model = HashModel(8)
    predict = model.make_predict_fn()
    for wrap in (True, False):
        got = adjacent_similarity(rows, model, wrap=wrap).orderBy("doc_id", "pos").collect()
        for doc, text in enumerate(texts):
            sentences = [s + "." for s in text.split(".")[:-1]]
            sentences = [s.strip() for s in sentences]
            want = cosines(predict(np.array(sentences)).astype(float)) if sentences else np.zeros(0)
            mine = [r.similarity for r in got if r.doc_id == doc]
            np.testing.assert_allclose(mine, want if wrap else want[:-1], rtol=1e-12)


def test_one_sentence_is_like_itself(spark):
    rows = spark.createDataFrame([("only one",)], "text string")
    assert [r.similarity for r in adjacent_similarity(rows, HashModel()).collect()] == [pytest.approx(1.0)]
    assert adjacent_similarity(rows, HashModel(), wrap=False).count() == 0


def test_topic_chunks_do_not_shuffle_or_repeat_the_model(spark):
    rows = spark.createDataFrame([("a. b.",)], "text string")
    plan = chunk(rows, TopicChunker(DummyModel(4)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("ArrowEvalPython") == 1


def test_workers_do_not_hold_more_as_texts_grow():
    predict = HashModel(16).make_predict_fn()
    lists = pa.array([[f"sentence {i} of a long text that goes on." for i in range(300_000)]])
    tracemalloc.start()
    try:
        for n in range(10):
            predict(np.array([" ".join(f"{n}-{i:0>36}" for i in range(60_000))], dtype=object))
        gc.collect()
        kept, _ = tracemalloc.get_traced_memory()
        tracemalloc.reset_peak()
        sims = _adjacent(lists, lambda texts: np.ones((len(texts), 4)), 32, True)
        _, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(sims[0]) == 300_000 and sims[0][0].as_py() == sims[0][-1].as_py() == pytest.approx(1)
    # 600,000 words would take 75 MB, all sentences as Python strings 27 MB.
    assert kept < 50e6 and peak - kept < 15e6
