import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.operators.filters import skipped_audit, unpivot_languages
from lexspan.operators.metrics import batch_text_metrics
from lexspan.operators.ordinals import number_documents, running_totals
from lexspan.operators.sampling import sample_documents, sample_per_dataset, top_n_per_group


@pytest.mark.parametrize("layout,parts", [(1, 1), (3, 8), (17, 5)])
def test_totals_equal_one_window(spark, layout, parts):
    rows = spark.range(0, 3000, 1, layout).select(
        F.xxhash64("id").alias("k"), (F.col("id") % 7).alias("n"), F.col("id").alias("kept")
    )
    got = running_totals(rows, ["k"], {"sum": F.col("n"), "place": F.lit(1)}, {"kept": F.col("kept")}, parts)
    before = W.orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    want = rows.select(
        "k",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("sum"),
        (F.row_number().over(W.orderBy("k")) - 1).cast("long").alias("place"),
        "kept",
    )
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_totals_with_a_hot_leading_key(spark):
    rows = spark.range(2000).select(F.lit("same").alias("dataset"), F.col("id"))
    got = running_totals(rows, ["dataset", "id"], {"place": F.lit(1)}, partitions=8)
    assert got.where(F.col("place") != F.col("id")).count() == 0


SCHEMA = (
    "k int, unofficial_text_en string, unofficial_text_fr string, citation_en string, name_en string, "
    "document_date_en timestamp, citation_fr string, name_fr string, document_date_fr timestamp"
)


def corpus(spark):
    bodies = [("a", None), (None, "f"), (" \n", "f"), ("b", "g"), ("", None), ("c", ""), ("d", "h")]
    rows = [(i, en, fr, f"c{i}", None, None, None, None, None) for i, (en, fr) in enumerate(bodies)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_document_numbers_leave_out_skipped_rows(spark):
    got = number_documents(corpus(spark), ["k"]).orderBy("k")
    assert [(r.k, r.doc_idx, r.doc_idx_en, r.doc_idx_fr) for r in got.collect()] == [
        (0, 0, 0, 0),
        (3, 1, 1, 0),
        (5, 2, 2, 1),
        (6, 3, 3, 1),
    ]
    every = number_documents(corpus(spark), ["k"], en_only=False).orderBy("k")
    assert [(r.k, r.doc_idx, r.doc_idx_en, r.doc_idx_fr) for r in every.collect()] == [
        (0, 0, 0, 0),
        (1, 1, 1, 0),
        (2, 2, 1, 1),
        (3, 3, 2, 2),
        (4, 4, 3, 3),
        (5, 5, 3, 3),
        (6, 6, 4, 3),
    ]


def test_skipped_rows_are_audited(spark):
    assert sorted(r.k for r in skipped_audit(corpus(spark), "k").collect()) == [1, 2, 4]


def test_unpivot_labels_each_body_with_its_own_language(spark):
    def bodies(en_only):
        rows = unpivot_languages(corpus(spark), en_only).collect()
        return sorted((r.k, r.chunk_language, r.text) for r in rows)

    kept = [(0, "en", "a"), (3, "en", "b"), (3, "fr", "g"), (5, "en", "c"), (6, "en", "d"), (6, "fr", "h")]
    assert bodies(True) == kept
    assert bodies(False) == sorted(kept + [(1, "fr", "f"), (2, "en", " \n"), (2, "fr", "f")])


def test_batch_metrics(spark):
    got = batch_text_metrics(corpus(spark), ["k"], batch_size=3).orderBy("batch_id").collect()
    assert [tuple(r) for r in got] == [
        (0, 3, 1, 1, 1, 1),
        (1, 3, 3, 3, 3, 3),
        (2, 1, 2, 2, 2, 4),
    ]


def test_samples_do_not_depend_on_layout(spark):
    rows = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("dataset"))
    a = sample_documents(rows.repartition(7), ["k"], 20, 5)
    b = sample_documents(rows.coalesce(1), ["k"], 20, 5)
    assert sorted(r.k for r in a.collect()) == sorted(r.k for r in b.collect())
    per = sample_per_dataset(rows, ["k"], 4).groupBy("dataset").agg(F.sort_array(F.collect_list("sample_idx")))
    assert [r[1] for r in per.collect()] == [[0, 1, 2, 3]] * 3


def test_top_n_of_a_hot_group_is_cut_before_the_shuffle(spark):
    rng = random.Random(0)
    data = [("hot" if i % 3 else f"g{i}", rng.random()) for i in range(3000)]
    rows = spark.createDataFrame(data, "g string, v double")
    top = top_n_per_group(rows, ["g"], [F.col("v")], 5)
    assert top._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
    # Above the threshold a salted pass gives the same rows.
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "3")
    try:
        salted = top_n_per_group(rows, ["g"], [F.col("v")], 5)
        assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, top.collect()))
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
