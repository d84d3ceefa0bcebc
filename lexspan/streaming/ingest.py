"""Ingest documents as a stream: chunk, embed, and save each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lexspan.operators.chunking import Chunker, NaiveChunker, chunk
from lexspan.operators.embedding import embed
from lexspan.operators.models import EmbeddingModel
from lexspan.schema import CHUNK_TEXT


def document_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1, **options: str
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.parquet(path)


def stream_ingest(
    documents: DataFrame,
    model: EmbeddingModel,
    path: str,
    checkpoint: str,
    text_col: str = "text",
    chunker: Chunker | None = None,
    once: bool = True,
) -> StreamingQuery:
    """Chunk and embed a document stream into `path/batch_id=<n>`.

    A batch that is run again after a failure overwrites its own folder, so nothing is
    saved twice. Chunking and embedding run per batch, so any chunker can be used.
    """
    chunker = chunker or NaiveChunker()

    def save(batch: DataFrame, batch_id: int) -> None:
        embedded = embed(chunk(batch, chunker, text_col), model, CHUNK_TEXT)
        embedded.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = documents.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_ingested(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
