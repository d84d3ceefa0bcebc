"""Embed texts with a model, in Arrow batches, and check the vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions.text import tokens
from lexspan.operators.arrow import from_matrix
from lexspan.operators.models import EmbeddingModel, once_per_worker


class CallCounter:
    """Counts model calls over all executors.

    Retried and speculative tasks count again, as they do call the model again.
    """

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self.calls: Accumulator[int] = spark.sparkContext.accumulator(0)

    @property
    def value(self) -> int:
        return self.calls.value

    def reset(self) -> None:
        self.calls = self._spark.sparkContext.accumulator(0)


def embed_column(
    text: Column, model: EmbeddingModel, counter: CallCounter | None = None
) -> Column:
    """The vector of each text, null for a null text.

    The model is made once per Python worker and sees at most `batch_size` texts per call.
    """
    get_predict = once_per_worker(model)
    calls = counter.calls if counter else None

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = get_predict()
        for batch in batches:
            present = batch.is_valid().to_numpy(zero_copy_only=False)
            texts = batch.drop_null().to_numpy(zero_copy_only=False)
            matrix = np.empty((len(texts), model.dim), dtype=np.float32)
            for lo in range(0, len(texts), model.batch_size):
                part = slice(lo, lo + model.batch_size)
                matrix[part] = predict(texts[part])
                if calls is not None:
                    calls.add(1)
            yield from_matrix(matrix, pa.float32(), None if present.all() else present)

    return vectors(text)


def embed(
    df: DataFrame,
    model: EmbeddingModel,
    text_col: str,
    into: str = "embedding",
    counter: CallCounter | None = None,
    spread_by: tuple[str, ...] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Add the embedding of `text_col`.

    Documents differ widely in length. When inference is the costly step, name the
    columns that identify a chunk in `spread_by` and a partition count: chunks are then
    dealt out evenly, and the same way on every retry, before the model runs.
    """
    if partitions:
        df = df.repartition(partitions, *spread_by)
    return df.withColumn(into, embed_column(F.col(text_col), model, counter))


def planned_calls(df: DataFrame, batch_size: int) -> DataFrame:
    """How many full or partial batches the rows of `df` make."""
    return df.agg(
        F.ceil(F.count(F.lit(1)) / F.lit(batch_size)).cast("long").alias("calls"),
        F.count(F.lit(1)).alias("texts"),
    )


def dimension_errors(
    df: DataFrame, dim: int | None, vector_col: str = "embedding", key: str | None = None
) -> DataFrame:
    """Rows whose vector has another length; an unset `dim` is that of the row with the smallest `key`."""
    if dim is None:
        if key is None:
            raise ValueError("without a dimension, name the key that orders the rows")
        dim = df.agg(F.min_by(F.array_size(vector_col), key)).first()[0] or 0
    return df.where(F.array_size(vector_col) != dim).withColumn("expected_dim", F.lit(dim))


def token_roundtrip(text: Column) -> Column:
    """Whether joining the tokens with single blanks gives the text back."""
    return F.array_join(tokens(text), " ") == text


def shard_of(ordinal: Column, shards: int) -> Column:
    """The worker that takes the text at `ordinal`: every `shards`-th one."""
    return F.pmod(ordinal, F.lit(shards))
