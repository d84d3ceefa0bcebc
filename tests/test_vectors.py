import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from lexspan.functions.vectors import check_dimension
from lexspan.operators import ann, embedding, knn
from lexspan.operators.models import DummyModel, HashModel

RNG = np.random.default_rng(7)


def frame(spark, matrix, name="index_id", key=int):
    rows = [(key(i), [float(x) for x in v]) for i, v in enumerate(matrix)]
    kind = "long" if key is int else "string"
    return spark.createDataFrame(rows, f"{name} {kind}, embedding array<float>").repartition(5)


def brute(vectors, queries, k, metric="l2", key=int):
    v, q = vectors.astype(np.float32).astype(float), queries.astype(np.float32).astype(float)
    hits = []
    for i, row in enumerate(q):
        if metric == "l2":
            d = ((v - row) ** 2).sum(axis=1)
        else:
            d = 1 - (v * row).sum(axis=1) / np.maximum(
                np.sqrt((v * v).sum(axis=1)) * np.sqrt((row * row).sum()), 1e-8
            )
        best = sorted(range(len(v)), key=lambda j: (d[j], key(j)))[:k]
        hits += [(key(i), r, key(j), round(float(d[j]), 9)) for r, j in enumerate(best)]
    return sorted(hits)


def found(df):
    return sorted((r.query_id, r["rank"], r.index_id, round(r.distance, 9)) for r in df.collect())


VECTORS = RNG.normal(size=(400, 12))
QUERIES = RNG.normal(size=(23, 12))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("broadcast", [knn.BROADCAST_BYTES, 2000])
@pytest.mark.parametrize("key", [int, "v{:04d}".format])
def test_knn_equals_brute_force(spark, monkeypatch, metric, broadcast, key):
    index, asked = frame(spark, VECTORS, key=key), frame(spark, QUERIES, "query_id", key)
    got = knn.knn_batch(index, asked, 6, metric, broadcast_bytes=broadcast)
    assert found(got) == brute(VECTORS, QUERIES, 6, metric, key)


@pytest.mark.parametrize("broadcast", [knn.BROADCAST_BYTES, 2000])
def test_copies_tie_by_id(spark, monkeypatch, broadcast):
    # A third of the table is one vector.
    vectors = RNG.integers(0, 3, size=(300, 4)).astype(float)
    vectors[::3] = [1, 1, 1, 1]
    asked = np.array([[1.0, 1, 1, 1], [0, 0, 0, 0], [2, 1, 0, 1]])
    got = knn.knn_batch(
        frame(spark, vectors), frame(spark, asked, "query_id"), 120, broadcast_bytes=broadcast
    )
    assert found(got) == brute(vectors, asked, 120)


def test_fewer_vectors_than_k(spark):
    got = knn.knn_batch(frame(spark, VECTORS[:3]), frame(spark, QUERIES[:2], "query_id"), 5)
    assert found(got) == brute(VECTORS[:3], QUERIES[:2], 3)


def test_no_queries_or_no_vectors(spark):
    none = frame(spark, VECTORS[:1]).where("false")
    asked = frame(spark, QUERIES[:2], "query_id")
    assert knn.knn_batch(none, asked).count() == 0
    assert knn.knn_batch(frame(spark, VECTORS), asked.where("false")).count() == 0


def test_one_query_with_lookup(spark):
    index = frame(spark, VECTORS).withColumn("name", F.concat(F.lit("n"), "index_id"))
    got = knn.knn_exact(index, list(QUERIES[0]), 4).orderBy("rank").collect()
    want = [h[2] for h in brute(VECTORS, QUERIES[:1].astype(float), 4)]
    assert [r.index_id for r in got] == want
    assert [r.name for r in got] == [f"n{i}" for i in want]
    assert [r.distance for r in got] == sorted(r.distance for r in got)
    hits = knn.knn_batch(index, frame(spark, QUERIES[:2], "query_id"), 4)
    kept = knn.lookup_filter(hits, index)
    assert kept.columns == index.columns
    assert {r.index_id for r in kept.collect()} == {r.index_id for r in hits.collect()}


def test_many_hits_are_looked_up_by_a_join(spark, monkeypatch):
    index = frame(spark, VECTORS).withColumn("name", F.concat(F.lit("n"), "index_id"))
    hits = knn.knn_batch(index, frame(spark, QUERIES, "query_id"), 4).persist()
    few = sorted(map(str, knn.lookup_ranked(hits, index).collect()))
    kept = sorted(map(str, knn.lookup_filter(hits, index).collect()))
    monkeypatch.setattr(knn, "FILTER_IDS", 10)
    assert sorted(map(str, knn.lookup_ranked(hits, index).collect())) == few
    assert sorted(map(str, knn.lookup_filter(hits, index).collect())) == kept
    hits.unpersist()


def test_a_lookup_searches_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    index = frame(spark, VECTORS)
    watched = index.mapInArrow(counted, index.schema)
    hits = knn.knn_batch(watched, frame(spark, QUERIES, "query_id"), 4)
    assert knn.lookup_ranked(hits, index).count() == 4 * len(QUERIES)
    assert seen.value == len(VECTORS)


def test_centres_see_all_vectors_unless_asked_otherwise(spark):
    many = np.concatenate([VECTORS] * 3)
    index = frame(spark, many + np.arange(len(many))[:, None] * 1e-9)
    assert len(ann.train_centres(index, cells=1)) == 1
    assert np.allclose(ann.train_centres(index, cells=1)[0], many.mean(axis=0), atol=1e-6)
    some = ann.train_centres(index, cells=1, one_in=4)
    again = ann.train_centres(index.repartition(7), cells=1, one_in=4)
    assert np.allclose(some, again) and not np.allclose(some[0], many.mean(axis=0), atol=1e-9)
    assert ann.default_cells(10**10) == 10**5


def test_vectors_of_unequal_length_are_refused(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "index_id int, embedding array<float>")
    with pytest.raises(PythonException, match="one length"):
        knn.knn_batch(rows.coalesce(1), frame(spark, QUERIES[:1, :2], "query_id")).collect()
    with pytest.raises(PythonException, match="dimensions"):
        knn.knn_batch(frame(spark, VECTORS), frame(spark, QUERIES[:1, :2], "query_id")).collect()


@pytest.mark.parametrize("broadcast", [knn.BROADCAST_BYTES, 2000])
def test_cells(spark, broadcast):
    # Half of the vectors fall into one cell.
    vectors = np.concatenate([VECTORS[:200], RNG.normal(size=(200, 12)) * 0.05 + 9])
    index, asked = frame(spark, vectors), frame(spark, QUERIES, "query_id")
    centres = ann.train_centres(index, cells=8)
    celled = ann.assign_cells(index, centres).persist()
    everything = ann.knn_approx(celled, asked, centres, 5, nprobe=8, broadcast_bytes=broadcast)
    assert found(everything) == brute(vectors, QUERIES, 5)
    some = ann.knn_approx(celled, asked, centres, 5, nprobe=3, broadcast_bytes=broadcast)
    share = ann.recall(some, everything).first()
    assert share.exact_hits == 5 * len(QUERIES)
    assert 0.5 < share.recall <= 1.0
    celled.unpersist()


def test_hash_model_and_nulls(spark):
    rows = spark.createDataFrame([(0, "a b a"), (1, None), (2, ""), (3, "a b a")], "i int, t string")
    for parts in (1, 4):
        got = embedding.embed(rows.repartition(parts), HashModel(8, batch_size=2), "t").orderBy("i").collect()
        assert got[1].embedding is None
        assert sum(got[2].embedding) == 0 and sum(got[0].embedding) == 3
        assert got[0].embedding == got[3].embedding
    predict = HashModel(8).make_predict_fn()
    np.testing.assert_array_equal(predict(np.array(["a b a"]))[0], got[0].embedding)


def test_calls_are_counted_and_reset(spark):
    rows = spark.range(70).select(F.col("id").cast("string").alias("t")).coalesce(1)
    counter = embedding.CallCounter(spark)
    run = embedding.embed(rows, DummyModel(2), "t", counter=counter)
    assert run.agg(F.count("embedding")).first()[0] == 70
    assert counter.value == 3
    counter.reset()
    assert counter.value == 0
    planned = embedding.planned_calls(rows, 32).first()
    assert (planned.calls, planned.texts) == (3, 70)


def test_spreading_before_the_model_keeps_rows(spark):
    rows = spark.range(50).select("id", F.col("id").cast("string").alias("t")).coalesce(1)
    got = embedding.embed(rows, HashModel(4), "t", spread_by=("id",), partitions=6)
    assert got.rdd.getNumPartitions() == 6
    assert got.select("id", "embedding").distinct().count() == 50


def test_dimension_is_checked(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "i int, embedding array<float>")
    assert [r.i for r in embedding.dimension_errors(rows, 2).collect()] == [1]
    assert embedding.dimension_errors(rows, None, key="i").count() == 1
    assert embedding.dimension_errors(rows.where("i = 0"), None, key="i").count() == 0
    with pytest.raises(Exception, match="should have 2 numbers but has 1"):
        rows.select(check_dimension(F.col("embedding"), 2)).collect()


def test_token_roundtrip_and_shards(one):
    assert one(embedding.token_roundtrip(F.col("x")), ["a b", "a  b", " a"]) == [True, False, False]
    assert one(embedding.shard_of(F.col("i"), 3), ["", "", "", ""]) == [0, 1, 2, 0]


def test_training_reads_parts_of_bounded_size(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) + 20 * (i % 4)).tolist()) for i in range(4000)]
    index = spark.createDataFrame(rows, "index_id int, embedding array<float>").coalesce(2)
    parts = []

    class Watched(ann.KMeans):
        def fit(self, data, *params):
            parts.append(data.rdd.getNumPartitions())
            return super().fit(data, *params)

    monkeypatch.setattr(ann, "KMeans", Watched)
    few = ann.train_centres(index, 4)
    monkeypatch.setattr(ann, "PART_BYTES", 8 * 8 * 500, raising=False)
    many = ann.train_centres(index, 4)
    # As they are where that is little; else no more than 500 vectors a part.
    assert parts == [2, 8]
    want = np.array([[20.0 * c] * 8 for c in range(4)])
    for got in (few, many):
        assert np.allclose(got[np.argsort(got[:, 0])], want, atol=0.3)
    assert ann.train_centres(index.where("index_id < 1"), 1).shape == (1, 8)
