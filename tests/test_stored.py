"""Numbering in the order of storage, against the order of files and rows read in plain Python."""

import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexspan.operators.chunking import NaiveChunker
from lexspan.operators.models import HashModel
from lexspan.operators.ordinals import number_documents
from lexspan.operators.stored import number_stored_documents, stored_totals
from lexspan.plans.embedding import chunk_dataset
from lexspan.plans.indexing import create_index, numbered_chunks

SCHEMA = "k long, unofficial_text_en string, unofficial_text_fr string"


def written(spark, tmp_path, n=3000, files=5, block=None):
    """Documents in key order over some files; with `block`, files of many row groups."""
    def body(i):
        return [None, "", " \n", "a b", "word " * (i % 300)][i % 5]

    rows = [(i, body(i), [None, "f", ""][i % 3]) for i in range(n)]
    frame = spark.createDataFrame(rows, SCHEMA).repartitionByRange(files, "k").sortWithinPartitions("k")
    writer = frame.write if block is None else frame.write.option("parquet.block.size", block)
    writer.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


@pytest.fixture
def small_splits(spark):
    held = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", held[0])
    spark.conf.set("spark.sql.files.openCostInBytes", held[1])


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("en_only", [True, False])
def test_equals_numbers_by_key(spark, tmp_path, en_only):
    docs = written(spark, tmp_path)
    assert same(number_stored_documents(docs, en_only), number_documents(docs, ["k"], en_only).select(*docs.columns, "doc_idx", "doc_idx_en", "doc_idx_fr"))


def test_files_cut_into_splits(spark, tmp_path, small_splits):
    docs = written(spark, tmp_path, 6000, 2, 2048)
    assert docs.rdd.getNumPartitions() > 2
    got = stored_totals(docs, {"place": F.lit(1), "sum": F.col("k"), "none": F.lit(None)})
    assert got.where("place != k or sum != k * (k - 1) / 2 or none != 0").count() == 0 and got.count() == 6000


def test_files_read_in_other_pieces_are_refused(spark, tmp_path, small_splits):
    docs = written(spark, tmp_path, 6000, 2, 2048)
    got = stored_totals(docs, {"place": F.lit(1)})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    with pytest.raises(PySparkException, match="in other pieces than before"):
        got.select("k", "place").collect()


def test_ties_repeats_and_clashing_names(spark, tmp_path):
    rows = [(1, "a", "x")] * 4 + [(None, None, "y")] * 3 + [(1, "b", None)]
    spark.createDataFrame(rows, "k long, place_before string, row_idx string").coalesce(1).write.parquet(str(tmp_path / "t"))
    got = stored_totals(spark.read.parquet(str(tmp_path / "t")), {"place": F.lit(1)}).orderBy("place").collect()
    assert [(r.k, r.place_before, r.row_idx) for r in got] == rows and [r.place for r in got] == list(range(8))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none"))
    none = spark.read.schema(SCHEMA).parquet(str(tmp_path / "none"))
    assert number_stored_documents(none).count() == 0


def test_plans_in_storage_order(spark, tmp_path):
    docs = written(spark, tmp_path, 400, 3).withColumn("dataset", F.lit("d"))
    assert same(chunk_dataset(docs, None, NaiveChunker(64, 8)), chunk_dataset(docs, ["k"], NaiveChunker(64, 8)))
    by_key, stored = numbered_chunks(docs, ["k"]), numbered_chunks(docs, None)
    assert same(stored.select(*by_key.columns), by_key)
    model = HashModel(8)
    assert same(create_index(docs, None, model), create_index(docs, ["k"], model).select(*create_index(docs, None, model).columns))
    with pytest.raises(ValueError):
        numbered_chunks(docs, None, max_tokens=10)
    with pytest.raises(ValueError):
        create_index(docs, None, model, included_datasets=["d"])


def test_no_exchange_of_texts(spark, tmp_path):
    plan = number_stored_documents(written(spark, tmp_path))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    # What is shuffled are the totals of the runs, by the part of the table they are in.
    moved = re.findall(r"(?<!Broadcast)Exchange (\w+)\((\w+)", physical)
    assert moved and all(m == ("hashpartitioning", "_part") for m in moved if m[0] != "SinglePartition")
    assert "SortMergeJoin" not in physical
