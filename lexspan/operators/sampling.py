"""Repeatable samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.functions.text import sample_key

# Sample sizes and seeds of the exploration and of the validation set.
DOCUMENT_SAMPLE = 25
DOCUMENT_SEED = 423
VALIDATION_SAMPLE = 100
VALIDATION_SEED = 42


def sample_documents(
    df: DataFrame, keys: list[str], n: int = DOCUMENT_SAMPLE, seed: int = DOCUMENT_SEED
) -> DataFrame:
    """`n` rows chosen by a hash of their key: the same rows on any layout."""
    order = sample_key(seed, *[F.col(k) for k in keys])
    return df.orderBy(order, *keys).limit(n)


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first `n` rows of each group, with `rank` from one.

    Spark keeps `n` rows per group and task before the shuffle only up to a threshold;
    above it a first pass does so here, so that a large group never meets in one task.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(256)))
        local = W.partitionBy(*group, "_salt").orderBy(*order)
        df = salted.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= n)
        df = df.drop("_r", "_salt")
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked.where(F.col("rank") <= n)


def sample_per_dataset(
    df: DataFrame,
    keys: list[str],
    n: int = DOCUMENT_SAMPLE,
    seed: int = DOCUMENT_SEED,
    dataset_col: str = "dataset",
) -> DataFrame:
    """`n` documents of each dataset, numbered from zero in `sample_idx`."""
    order = [sample_key(seed, *[F.col(k) for k in keys]), *[F.col(k) for k in keys]]
    ranked = top_n_per_group(df, [dataset_col], order, n)
    return ranked.withColumn("sample_idx", F.col("rank") - 1).drop("rank")
