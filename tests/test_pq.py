"""Product quantisation: codes, round trip and search."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.operators import ann, knn, pq


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (25, 16))[rng.integers(0, 25, 1200)] + rng.normal(0, 0.2, (1200, 16))
    rows = [(int(i), v.astype("float32").tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "index_id long, embedding array<float>").repartition(4).cache(), x.astype("float32").astype(float)


def test_codes_round_trip_and_search(spark, vectors):
    frame, x = vectors
    books = pq.train_codebooks(frame, parts=4, entries=64)
    assert books.shape == (4, 64, 4)
    coded = pq.encode(frame, books)
    want = [((x[:, None, 4 * p : 4 * p + 4] - books[p][None]) ** 2).sum(axis=2).argmin(axis=1) for p in range(4)]
    off = 0
    for r in pq.decode(coded, books).collect():
        assert list(r.code) == [w[r.index_id] for w in want]
        assert np.allclose(r.approximate, np.concatenate([books[p][c] for p, c in enumerate(r.code)]))
        off += ((np.array(r.approximate) - x[r.index_id]) ** 2).sum()
    assert off < 0.1 * ((x - x.mean(axis=0)) ** 2).sum()
    asked = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x[::100] + 0.05)], "query_id long, embedding array<double>")
    exact = knn.knn_batch(frame, asked, 5)
    for sent in (1 << 26, 1 << 14):  # one slice, and several
        found = pq.knn_compressed(coded.select("index_id", "code"), frame, asked, books, 5, broadcast_bytes=sent)
        assert ann.recall(found, exact).first().recall >= 0.95
    # Ranked anew from all rows, the search is exact.
    whole = pq.knn_compressed(coded.select("index_id", "code"), frame, asked, books, 5, rerank=240)
    assert ann.recall(whole, exact).first().recall == 1.0


def test_few_rows_and_wrong_parts(spark, vectors):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "index_id long, embedding array<float>")
    books = pq.train_codebooks(one, parts=2, entries=4)
    assert [list(r.code) for r in pq.encode(one, books).collect()] == [[0, 0], [0, 0]]
    with pytest.raises(ValueError, match="equal parts"):
        pq.train_codebooks(vectors[0], parts=5)
    with pytest.raises(ValueError, match="entries"):
        pq.train_codebooks(vectors[0], entries=300)


def test_training_holds_no_vectors_and_is_as_good_as_k_means(spark, vectors, monkeypatch):
    frame, x = vectors

    def error(books):
        return sum(((x[:, None, 4 * p : 4 * p + 4] - b[None]) ** 2).sum(axis=2).min(axis=1).sum() for p, b in enumerate(books))

    before = [
        KMeans(k=16, seed=42 + p, maxIter=10, initSteps=2)
        .fit(frame.select(array_to_vector(F.slice(F.col("embedding").cast("array<double>"), 4 * p + 1, 4)).alias("features")))
        .clusterCenters()
        for p in range(4)
    ]

    def held(*_):
        raise AssertionError("vectors are held in memory")

    monkeypatch.setattr(DataFrame, "persist", held)
    monkeypatch.setattr(DataFrame, "cache", held)
    books = pq.train_codebooks(frame, parts=4, entries=16)
    assert books.shape == (4, 16, 4)
    assert error(books) <= 1.1 * error([np.array(b) for b in before])


def test_one_entry_is_the_mean_and_bad_vectors_are_refused(spark, vectors):
    frame, x = vectors
    assert np.allclose(pq.train_codebooks(frame, parts=2, entries=1)[:, 0].ravel(), x.mean(axis=0))
    bad = spark.createDataFrame([(1, [1.0, 2.0]), (2, [float("nan"), 2.0])], "index_id long, embedding array<double>")
    with pytest.raises(Exception, match="finite"):
        pq.train_codebooks(bad, parts=2, entries=2)
