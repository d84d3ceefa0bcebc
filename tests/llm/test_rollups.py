"""Token counts: totals after any batches are those of what is held."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lexspan.llm.rollups import OP5_SQL, TokenCounts, op5_token_counts
from lexspan.session import scratch_path

CHANGES = "doc_id long, seq long, op string, text string, source string, lang string, tokenizer string, n_docs string"


def expected(batches):
    held = {}
    for rows in batches:
        last = {}
        for r in rows:
            d, seq, op, text = r[0], r[1], r[2], r[3] or ""
            if d is None:
                continue
            key = (seq, op == "delete", len(text))
            if d not in last or key > last[d][0]:
                last[d] = key, r
        for d, (_, r) in last.items():
            held.pop(d, None)
            if r[2] != "delete" and r[6] == "words-1":
                held[d] = r
    out = {}
    for r in held.values():
        t = out.setdefault((r[4], r[5], r[6]), [0, 0, 0])
        t[0] += 1
        t[1] += len((r[3] or "").split())
        t[2] += len(r[3] or "")
    return sorted(((*k, *v) for k, v in out.items()), key=repr)


def rows_of(counts):
    return sorted(map(tuple, counts.totals().collect()), key=repr)


def test_random_batches(spark):
    rng = random.Random(3)
    counts = TokenCounts(spark, scratch_path(spark, "counts"))
    batches = []
    for b in range(4):
        rows = []
        for _ in range(120):
            d = rng.choice([None, *range(60)])
            op = rng.choice(["put", "put", "delete"])
            text = rng.choice([None, "", " \n", "a b", "é \U0001f600 z", "w " * rng.randrange(2000)])
            rows.append((d, rng.randrange(10**9), op, text, rng.choice(["s", "t", None]), rng.choice(["en", None]), rng.choice(["words-1", "words-1", "none", None]), "x"))
        rows.append(rows[0])
        batches.append(rows)
        frame = spark.createDataFrame(rows, CHANGES).repartition(3)
        assert counts.apply(b, frame) is True
        assert rows_of(counts) == expected(batches)
        assert counts.apply(b, frame) is False and rows_of(counts) == expected(batches)
    with pytest.raises(ValueError, match="comes after"):
        TokenCounts(spark, counts.path).apply(-1, frame)


def test_a_batch_without_commit_does_not_count(spark):
    path = scratch_path(spark, "counts")
    counts = TokenCounts(spark, path)
    row = [(1, 0, "put", "a b c", "s", "en", "words-1", "")]
    spark.createDataFrame(row, CHANGES).write.parquet(f"{path}/changes/batch=1")  # what a failed try left
    assert rows_of(counts) == []
    assert counts.apply(1, spark.createDataFrame(row, CHANGES)) and rows_of(counts) == [("s", "en", "words-1", 1, 3, 5)]


def test_empty_batch_and_own_counter(spark):
    counts = TokenCounts(spark, scratch_path(spark, "counts"), {"chars-1": lambda t: F.length(t)})
    assert counts.apply(1, spark.createDataFrame([], CHANGES)) and rows_of(counts) == []
    counts.apply(2, spark.createDataFrame([(1, 0, "put", "abc", "s", "en", "chars-1", "")], CHANGES))
    assert rows_of(counts) == [("s", "en", "chars-1", 1, 3, 3)]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    want = con.sql(OP5_SQL)
    got = op5_token_counts(spark, sf)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
