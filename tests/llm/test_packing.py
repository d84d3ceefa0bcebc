"""Packing: every id in exactly one place, windows gapless and within capacity."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexspan.llm.packing import Packing, karmarkar_karp, op10_packing, pack_documents, share_out

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, ids string, offset int"


def check(docs, pieces, capacity=2048):
    """Compare pieces (as dicts) with the ids of plain calls of the tokenizer."""
    tokenizer = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for doc_id, text in docs:
        want[doc_id].append(tuple([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]))
    windows = defaultdict(list)
    got = defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
        got[p["doc_id"]].append(p)
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    assert set(want) == set(got)
    for doc_id, texts in want.items():
        assert sum(map(len, texts)) == sum(p["length"] for p in got[doc_id])
        if len(texts) == 1:
            at = 0
            for p in sorted(got[doc_id], key=lambda p: p["start"]):
                part = np.array(texts[0][p["start"] : p["start"] + p["length"]], dtype="<u4").tobytes()
                assert p["start"] == at and p["doc_tokens"] == len(texts[0])
                assert bytes(p["ids"]) == part if "ids" in p else p["ids_crc32"] == zlib.crc32(part)
                at += p["length"]
            assert at == len(texts[0])
    return windows


def test_differencing_balances():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 257, 800)
    bins = karmarkar_karp(sizes, 50)
    sums = np.bincount(bins, weights=sizes, minlength=50)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() < 12
    few = np.array([8, 7, 6, 5, 4])
    assert sorted(np.bincount(karmarkar_karp(few, 2), weights=few)) == [14, 16]
    assert len(karmarkar_karp(np.array([], dtype=np.int64), 3)) == 0


def test_windows_rise_when_the_capacity_is_exceeded():
    bins, k = share_out(np.array([6, 6, 6, 2]), 10)
    assert k == 3 and np.bincount(bins, weights=[6, 6, 6, 2]).max() <= 10


@pytest.mark.parametrize("how", [Packing(), Packing(capacity=16, windows=3, longest_piece=5)])
def test_edges(spark, how):
    texts = [
        None, "", " \n", "word", "Word. WORD, word", "don't it's 'S <|endoftext|> a<|startoftext|>b", "x" * 9000,
        "é H̱  nb sp   İ ΣΣ", "1234 5.6,7 ...,, a.b,c.", "tie", "tie", "\x1c\x85 z" * 40,
        "many words " * 4000, "\U0001f600 ok \x00 nul",
    ]
    docs = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS).repartition(3)
    check(docs, [r.asDict() for r in pack_documents(frame, PATH, how).collect()], how.capacity)


def test_repeated_and_null_ids(spark):
    docs = [(1, "one two"), (1, "one two"), (None, "no id"), (None, None)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS).coalesce(1)
    check(docs, [r.asDict() for r in pack_documents(frame, PATH).collect()])


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_query_against_plain_calls(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    windows = check(docs, [r.asDict() for r in op10_packing(spark, sf).collect()])
    used = sum(length for spans in windows.values() for _, length in spans)
    assert used > 0.98 * 2048 * len(windows)
