"""Corpus and batch profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions.text import word_count
from lexspan.operators.filters import drop_empty_text, has_text
from lexspan.operators.ordinals import running_totals
from lexspan.schema import TEXT_EN, TEXTS


def avg_doc_words(df: DataFrame, text_col: str = TEXT_EN, dataset_col: str = "dataset") -> DataFrame:
    """Mean words per dataset over the documents that have a text."""
    return (
        drop_empty_text(df, text_col, "null")
        .groupBy(dataset_col)
        .agg(F.avg(word_count(F.col(text_col))).alias("avg_words"))
    )


def batch_text_metrics(
    df: DataFrame, order_by: list[str], batch_size: int = 32, en_only: bool = True
) -> DataFrame:
    """Per batch of `batch_size` rows in order: texts, characters, words, and the
    documents processed up to its end.

    Batches are fixed by row position, skipped rows included.
    """
    # Only lengths and counts leave the scan; the texts are not shuffled.
    kept = has_text(F.col(TEXT_EN)) if en_only else F.lit(True)

    def over_bodies(measure) -> Column:
        bodies = [F.coalesce(measure(F.col(t)), F.lit(0)).cast("long") for t in TEXTS]
        return F.when(kept, bodies[0] + bodies[1]).otherwise(0)

    rows = running_totals(
        df,
        order_by,
        {"row_idx": F.lit(1), "doc_idx": kept.cast("int")},
        carry={
            "kept": kept.cast("int"),
            "texts": over_bodies(lambda t: (F.length(t) > 0).cast("int")),
            "chars": over_bodies(F.length),
            "words": over_bodies(word_count),
        },
    )
    return rows.groupBy(F.floor(F.col("row_idx") / batch_size).alias("batch_id")).agg(
        F.count(F.lit(1)).alias("batch_rows"),
        F.sum("texts").alias("texts"),
        F.sum("chars").alias("chars"),
        F.sum("words").alias("words"),
        F.max(F.col("doc_idx") + F.col("kept")).alias("documents_so_far"),
    )


def batch_chunk_counts(chunks: DataFrame, batch_size: int = 32) -> DataFrame:
    """Chunks per batch of documents; `chunks` must carry `doc_idx`."""
    return (
        chunks.groupBy(F.floor(F.col("doc_idx") / batch_size).alias("batch_id"))
        .agg(F.count(F.lit(1)).alias("chunks"))
    )


def observed_text_metrics(df: DataFrame, text_col: str, observation) -> DataFrame:
    """Report rows, characters and words of whatever job runs over `df`, at no extra pass."""
    return df.observe(
        observation,
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.length(text_col)).alias("chars"),
        F.sum(word_count(F.col(text_col))).alias("words"),
    )
