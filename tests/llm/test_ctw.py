"""Context-tree weighting against a direct recursion; the word model against a recount."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexspan.llm import ctw
from lexspan.llm.ctw import TREE, ContextTree, Level, _log_kt, build_model, fold_grams, gather_levels, op3_lm_scoring, score_texts

DOCS = "doc_id long, text string, word string, score string"


def is_held_out(d, folds=10, fold=0):
    return d is not None and zlib.crc32(str(d).encode()) % folds == fold


def word_scores(docs):
    tokens = [[*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b""] for _, t in docs]
    counts = Counter(w for (d, _), x in zip(docs, tokens, strict=True) if not is_held_out(d) for w in x)
    n, v = sum(counts.values()), len(counts)
    out = {}
    for (d, _), x in zip(docs, tokens, strict=True):
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)
        out[d] = (is_held_out(d), len(x), sum(counts[w] > 0 for w in x), n, base)
    return out


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)


def brute_scores(training, texts, depth, share):
    """The weighting of every bit node by plain recursion over contexts."""
    counts = {}
    for t in training:
        raw = b"\xff" * depth + (t or "").encode().lower() + b"\xff"
        for i in range(depth, len(raw)):
            for d in range(depth + 1):
                counts.setdefault(raw[i - d : i], Counter())[raw[i]] += 1
    total = sum(counts.get(b"", Counter()).values())
    kept = {c for c, n in counts.items() if not c or sum(n.values()) * share >= total} if total else set()
    children = {}
    for c in kept:
        if c:
            children.setdefault(c[1:], []).append(c)

    def bits(n, prefix, size):
        ones = zeros = 0
        for byte, k in n.items():
            if byte >> (8 - size) == prefix:
                if byte >> (7 - size) & 1:
                    ones += k
                else:
                    zeros += k
        return zeros, ones

    memo = {}

    def rest(c):
        left = Counter(counts.get(c, {}))
        for x in children.get(c, ()):
            left.subtract(counts[x])
        return left

    def weighted(c, prefix, size):
        key = c, prefix, size
        if key not in memo:
            own = kt(*bits(counts.get(c, {}), prefix, size))
            if c in children:
                product = sum(weighted(x, prefix, size) for x in children[c]) + kt(*bits(rest(c), prefix, size))
                both = np.logaddexp(own, product) - math.log(2)
                memo[key] = both, math.exp(own - math.log(2) - both)
            else:
                memo[key] = own, 1.0
        return memo[key][0]

    def one(c, history, prefix, size):
        weighted(c, prefix, size)
        z, o = bits(counts.get(c, {}), prefix, size)
        own, w = (o + 0.5) / (z + o + 1), memo[c, prefix, size][1]
        if w == 1.0 and c not in children:
            return own
        longer = history[len(history) - len(c) - 1 :]
        if len(c) < depth and longer in kept:
            return w * own + (1 - w) * one(longer, history, prefix, size)
        z, o = bits(rest(c), prefix, size)
        return w * own + (1 - w) * (o + 0.5) / (z + o + 1)

    out = []
    for t in texts:
        raw = b"\xff" * depth + (t or "").encode().lower() + b"\xff"
        score = 0.0
        for i in range(depth, len(raw)):
            for size in range(8):
                p = one(b"", raw[i - depth : i], raw[i] >> (8 - size), size)
                score += math.log10(p if raw[i] >> (7 - size) & 1 else 1 - p)
        out.append(score)
    return out


def test_log_of_kt():
    a, b = np.meshgrid(np.arange(0, 3000, 37.0), np.arange(0, 900, 11.0))
    want = np.vectorize(kt)(a, b)
    assert np.allclose(_log_kt(a, b), want, rtol=1e-11, atol=1e-9)


def test_probabilities_add_up():
    rng = np.random.default_rng(1)
    levels = [{}, {}, {}]
    for _ in range(400):
        a, b, c = rng.integers(97, 102, 3).tolist()
        for d, key in ((0, b""), (1, bytes([b])), (2, bytes([a, b]))):
            levels[d].setdefault(key, Counter())[c] += 1
    model = build_model([Level({k: (list(n), list(n.values())) for k, n in x.items()}) for x in levels])
    assert np.allclose((10.0 ** model.log10.astype(float)).sum(axis=1), 1, atol=1e-4)


TEXTS = [
    None, "", " ", "the cat sat on the mat", "The cat sat on the hat.", "é\U0001f600 x\x00y", "tie", "tie",
    "abracadabra " * 30, "zzz", "the mat sat on the cat " * 8, "un deux trois", "a" * 300, "q",
]


@pytest.mark.parametrize("contexts", [8, 1 << 14])
def test_edges(spark, contexts):
    docs = list(enumerate(TEXTS))
    how = ContextTree(depth=3, contexts=contexts, frequent=20)
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS).repartition(3)
    rows = {r.doc_id: r for r in score_texts(frame, how).collect()}
    want = word_scores(docs)
    assert len(rows) == len(docs)
    training = [t for d, t in docs if not is_held_out(d)]
    assert len(training) < len(docs)
    for (d, _), score in zip(docs, brute_scores(training, TEXTS, 3, contexts), strict=True):
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[d][:4]
        assert r.base_score == pytest.approx(want[d][4], rel=1e-9)
        assert r.score == pytest.approx(score, rel=2e-4, abs=1e-3)


@pytest.mark.parametrize(("depth", "most", "known"), [(3, 1 << 19, 1 << 21), (3, 7, 40), (5, 50, 0), (1, 3, 9), (7, 40, 60)])
def test_whole_tree(spark, monkeypatch, depth, most, known):
    # However rare, no context is pooled: neither by the share asked of a cut tree, nor by chunks and lookups.
    whole = fold_grams
    monkeypatch.setattr(ctw, "fold_grams", lambda how: whole(how, most))
    docs = list(enumerate(TEXTS))
    how = ContextTree(depth=depth, contexts=8, whole=True, known=known)
    rows = {r.doc_id: r for r in score_texts(spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS).repartition(3), how).collect()}
    want = word_scores(docs)
    training = [t for d, t in docs if not is_held_out(d)]
    for (d, _), score in zip(docs, brute_scores(training, TEXTS, depth, 1 << 40), strict=True):
        assert (rows[d].n_tokens, rows[d].n_known) == want[d][1:3]
        assert rows[d].base_score == pytest.approx(want[d][4], rel=1e-9)
        assert rows[d].score == pytest.approx(score, rel=1e-5, abs=1e-5)


def test_query_takes_the_whole_tree():
    assert TREE.whole


def test_empty_and_untrained(spark):
    assert score_texts(spark.createDataFrame([], DOCS)).count() == 0
    out = next(d for d in range(99) if is_held_out(d))
    r = score_texts(spark.createDataFrame([(out, "ab", "", ""), (out, "ab", "", "")], DOCS)).collect()
    assert len(r) == 2 and r[0].score == pytest.approx(24 * math.log10(0.5), rel=1e-6) and r[0].train_tokens == 0


def test_empty_and_untrained_whole_tree(spark):
    assert score_texts(spark.createDataFrame([], DOCS), TREE).count() == 0
    out = next(d for d in range(99) if is_held_out(d))
    r = score_texts(spark.createDataFrame([(out, "ab", "", ""), (out, "ab", "", "")], DOCS), TREE).collect()
    assert len(r) == 2 and r[0].score == pytest.approx(24 * math.log10(0.5), rel=1e-6) and r[0].train_tokens == 0


@pytest.mark.parametrize("times", [1, 100, 10_000])
def test_tree_grows_with_the_corpus(spark, times):
    # A fixed share would ask for 7,629,394 in the largest of these corpora, and pool all but one.
    counts = {bytes([97, 97 + i % 26, 97 + i // 26]): 100 + 20 * i for i in range(600)}
    most = 100_000_000 * times - sum(counts.values())
    rows = [(int.from_bytes(c, "big"), n) for c, n in {**counts, b"zzz": most}.items()]
    how = ContextTree(depth=2)
    levels = gather_levels(spark.createDataFrame(rows, "gram long, n long"), how)
    every = Counter()
    for c, n in {**counts, b"zzz": most}.items():
        every[c[:2]] += n
    least = 100_000_000 * math.sqrt(times) / how.contexts
    assert sorted(levels[2].names) == sorted(c for c, n in every.items() if n >= least)
    assert len(levels[2]) == 27


@pytest.mark.parametrize("total", [10**5, 10**7, 10**8, 10**9, 10**11])
def test_query_has_one_rule_for_every_size(spark, total):
    # Contexts just below and just above one power of the size, whatever the size.
    asked = total**0.8 / 7168
    counts = {bytes([97, 97, 97, 97, 97, 97 + i]): max(1, round(asked * (0.8 + 0.1 * i))) for i in range(8)}
    rows = [(int.from_bytes(bytes([98 + i]) + c[1:], "big"), n) for i, (c, n) in enumerate(counts.items())]
    rows.append((int.from_bytes(b"zzzzzz", "big"), total - sum(counts.values())))
    names = set(gather_levels(spark.createDataFrame(rows, "gram long, n long"), TREE)[5].names)
    assert names == {b"zzzzz"} | {bytes([98 + i]) + b"aaaa" for i, n in enumerate(counts.values()) if n >= asked}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, rows = word_scores(docs), op3_lm_scoring(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9)
    unseen = [r for r in rows if r.held_out]
    # Bytes without a word list do as well as words on this little text (better on more of it).
    assert sum(r.score for r in unseen) > 1.01 * sum(r.base_score for r in unseen)
    assert 1 < np.median([r.bits_per_byte for r in unseen]) < 3
