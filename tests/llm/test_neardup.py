"""Near-duplicates against all pairs of full sets."""

import random
import re
from itertools import combinations

import numpy as np

from lexspan.llm.neardup import NearDup, near_duplicates, op4_near_duplicates

DOCS = "doc_id long, text string, id string, fp string"


def shingles(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(docs, how):
    sets = [shingles(t, how.shingle) for _, t in docs]
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, set()).add(i)
    pairs = {p for members in where.values() if len(members) > 1 for p in combinations(sorted(members), 2)}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= how.percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(docs[i][0]), find(docs[j][0])))
            parent[b] = a
    return sorted((d, len(s), find(d), find(d) == d) for (d, _), s in zip(docs, sets, strict=True))


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def test_band_rule():
    assert (NearDup(3, 85).rows, NearDup(3, 85).bands) == (7, 36)
    for how in (NearDup(), NearDup(3, 85), NearDup(5, 50)):
        assert (1 - (how.percent / 100) ** how.rows) ** how.bands <= how.miss


def test_edges(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(220)]
    texts = [None, "", " \n", "one", "ONE", "one two", "One\x0bTWO", "a b c", "tie", "tie", "é́ \U0001f600 z", "é́ \U0001f600 Z"]
    texts += [" ".join(changed(rng, base, k)) for k in (0, 1, 2, 3, 4, 5, 6, 8, 10, 14, 20, 40)]
    chain = base
    for _ in range(12):  # neighbours are linked, the ends are not
        chain = changed(rng, chain, 3)
        texts.append(" ".join(chain))
    texts += [" ".join(f"u{i}" for i in range(20000)), "z " + " ".join(f"u{i}" for i in range(20000))]
    shared = [f"s{i}" for i in range(100)]  # a passage in common is no link
    texts += [" ".join([*shared, *(f"v{k}_{i}" for i in range(60))]) for k in range(30)]
    docs = [(1000 - i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS).repartition(5)
    for how in (NearDup(3, 85), NearDup()):
        assert sorted(map(tuple, near_duplicates(frame, how).collect())) == brute(docs, how)


def test_small_blocks_find_every_link(spark):
    """A group whose pairs lie around the limit, over many blocks, with no or one round of hubs."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    docs = [(rng.randrange(10**6) * 200 + i, " ".join(changed(rng, base, rng.randrange(9)))) for i in range(160)]
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS).repartition(4)
    plain = brute(docs, NearDup(3, 85))
    assert 5 < len({c for _, _, c, _ in plain}) < 150
    for rounds, block, size in ((0, 8, 4000), (1, 512, 1 << 20)):
        how = NearDup(3, 85, hub_rounds=rounds, block=block, block_bytes=size)
        assert sorted(map(tuple, near_duplicates(frame, how).collect())) == plain


def test_repeated_rows_and_null_ids(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (7, "a b c d"), (None, "A b c d"), (None, "alone and without id"), (None, None)]
    got = near_duplicates(spark.createDataFrame([(*r, "", "") for r in rows], DOCS), NearDup(3, 85)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        [(5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (None, 2, 5, False), (None, 2, None, True), (None, 0, None, True)],
        key=repr,
    )


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op4_near_duplicates(spark, sf).collect())) == brute(docs, NearDup(3, 85))


def test_estimates(spark):
    from pyspark.sql import functions as F

    from lexspan.llm.neardup import _SKETCH, estimate, sketch_batches

    rng = random.Random(2)
    pairs = []
    for k in range(60):
        base = [f"w{k}_{i}" for i in range(300)]
        pairs.append((2 * k, " ".join(base)))
        pairs.append((2 * k + 1, " ".join(changed(rng, base, rng.randrange(1, 30)))))
    made = spark.createDataFrame(pairs, "doc_id long, text string").mapInArrow(sketch_batches(NearDup(3, 85)), _SKETCH)
    a, b = made.filter("doc_id % 2 = 0"), made.filter("doc_id % 2 = 1")
    a = a.select((F.col("doc_id") / 2).cast("int").alias("k"), F.col("planes").alias("x"))
    b = b.select(((F.col("doc_id") - 1) / 2).cast("int").alias("k"), F.col("planes").alias("y"))
    off = []
    texts = dict(pairs)
    for r in a.join(b, "k").select("k", estimate(F.col("x"), F.col("y")).alias("e")).collect():
        s, t = shingles(texts[2 * r.k], 3), shingles(texts[2 * r.k + 1], 3)
        off.append(r.e - len(s & t) / len(s | t))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06
