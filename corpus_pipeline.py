"""The training-data pipeline: documents in, packed windows out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's documents. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.decontam import find_leaks
from lexspan.llm.neardup import near_duplicates
from lexspan.llm.packing import pack_documents
from lexspan.llm.quality import judge, trusted_documents
from lexspan.llm.secrets import find_secrets, redacted
from lexspan.llm.text import where_computed
from lexspan.session import pin, scratch_path, scratch_scope

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    judged = judge(docs.select(*COLUMNS), trusted_documents(spark, sf_dir))
    return where_computed(judged, F.col("kept")).select(*COLUMNS)


def _with_row_key(docs: DataFrame) -> DataFrame:
    """The documents with a number `_row` of their own, written once: ids may be null or repeat."""
    return pin(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least id, null ids last.

    Rows are told apart by a key of their own. So rows without an id are compared like any other, rows
    of one id and unlike texts all stay, and documents without words do, too. Only keys are compared in
    the end: the texts of those that go are found by a narrow anti-join.
    """
    keyed = _with_row_key(docs)
    groups = near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text"))
    groups = groups.filter("n_shingles > 0").select(F.col("doc_id").alias("_row"), "component_id")
    named = groups.join(keyed.select("_row", "doc_id"), "_row")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("_row"))
    stays = named.groupBy("component_id").agg(F.min(order)["_row"].alias("_row"))
    gone = groups.join(stays, "_row", "left_anti").select("_row")
    return keyed.join(gone, "_row", "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with its values or others, go, with or without an id."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    keyed = _with_row_key(docs)
    leaks = find_leaks(keyed.select(F.col("_row").alias("doc_id"), "text"), items)
    return keyed.join(leaks.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes a mark; the documents stay. A null text stays null."""
    found = find_secrets(docs.select(*COLUMNS))
    clean = F.when(F.col("text").isNotNull(), redacted(F.coalesce("text", F.lit("")), F.col("secrets")))
    # Not in one select: there, `text` within the lambda would be the new column of that name.
    length = F.when(F.size("secrets") > 0, F.length("_clean").cast("bigint")).otherwise(F.col("n_chars"))
    found = found.withColumn("_clean", clean).withColumn("n_chars", length)
    return found.select("doc_id", F.col("_clean").alias("text"), "lang", "source", "n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokens and their place in windows of 2,048."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

# Near duplicates and tokens are beyond SQL; tests compare the run with a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed windows of `documents`. What a stage wrote on the way is deleted after it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
