"""Byte-level BPE against the tiktoken library, and the exact round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lexspan.llm.bpe import (
    Bpe,
    Encoder,
    PairTree,
    Vocabulary,
    decode_ids,
    encode_texts,
    merge_together,
    op12_byte_bpe,
    read_ranks,
    shared_vocabulary,
)

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
HOW = Bpe(public_tokenizers.PATTERN)
EDGES = [
    "", " ", "a", "aa", " a", "don't we'll I'M x's", "12 345 6", "é́ \U0001f600 z\U0001f468‍\U0001f469", "  two  \n\n three \t",
    "x\x1c\x1dy\x85z\xa0  q", "\x00\x01", "<|endoftext|> <|startoftext|>", "end  ", "ab" * 5000, "\n" * 4001, "日本語テキスト " * 50,
    "a" * 300 + "!" * 300 + " " * 300 + "7" * 300,
]


@pytest.fixture(scope="module")
def words():
    return Vocabulary(read_ranks(PATH))


@pytest.fixture(scope="module")
def library(words):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words.ranks, special_tokens={})


def ids(made):
    return np.frombuffer(made, dtype="<i4").tolist()


def noise(rng, n):
    letters = "aaaeiou tn\n's9é漢\U0001f600 .,;\t"
    return "".join(rng.choice(letters) for _ in range(n))


def test_edges(words, library):
    assert [ids(m) for m in Encoder(words, HOW).encode(EDGES)] == [library.encode_ordinary(t) for t in EDGES]


def test_rows_and_single_trees_agree(words, library):
    rng = random.Random(4)
    raws = [bytes(rng.choice(b"abcde \xc3\xa9tion") for _ in range(rng.randrange(2, 65))) for _ in range(400)]
    raws += [b"aa", b"a" * 64, b"ab" * 32]
    singles = [PairTree(r, words).merge_all() for r in raws]
    assert [ids(m) for m in merge_together(raws, words)] == singles
    assert all(library.decode_bytes(s) == r for s, r in zip(singles, raws, strict=True))


def test_small_windows_and_caches_change_nothing(words, library):
    rng = random.Random(9)
    texts = [noise(rng, rng.randrange(1, 400)) for _ in range(60)] + EDGES
    want = [library.encode_ordinary(t) for t in texts]
    for how in (Bpe(HOW.pattern, window=16, together=7, cached=20, short=4), Bpe(HOW.pattern, window=9, together=1)):
        assert [ids(m) for m in Encoder(words, how).encode(texts)] == want


def test_equal_pairs_merge_from_the_left():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aaa": 257}
    assert PairTree(b"aaaaa", Vocabulary(ranks)).merge_all() == [256, 257]


DOCS = "doc_id long, text string, ids string, decoded string"


def test_round_trip(spark, words, library):
    texts = [None, *EDGES, *EDGES[:3], "w" * 300_000]
    rows = [(i // 2 if i % 5 else None, t, "x", "y") for i, t in enumerate(texts)]
    shared = shared_vocabulary(spark, PATH)
    got = decode_ids(encode_texts(spark.createDataFrame(rows, DOCS).repartition(3), shared, HOW), shared).collect()
    want = [(d, library.encode_ordinary(t or ""), (t or "").encode()) for d, t, _, _ in rows]
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got), key=repr) == sorted(want, key=repr)


def test_null_ids_and_unknown_ids(spark):
    shared = shared_vocabulary(spark, PATH)
    frame = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in decode_ids(frame, shared).collect()}
    assert got == {1: None, 2: b""}
    with pytest.raises(Exception, match="KeyError"):
        decode_ids(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), shared).collect()


def test_empty_table(spark):
    shared = shared_vocabulary(spark, PATH)
    assert encode_texts(spark.createDataFrame([], DOCS), shared, HOW).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.01"
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        own = library.encode_ordinary(r.text or "")
        digest = hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()
        want.append((r.doc_id, len(own), digest, hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, op12_byte_bpe(spark, sf).collect())) == sorted(want)
