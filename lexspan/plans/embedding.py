"""The main job: number, split by language, chunk and embed a table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.operators.chunking import Chunker, NaiveChunker, chunk
from lexspan.operators.embedding import CallCounter, embed
from lexspan.operators.filters import unpivot_languages
from lexspan.operators.models import EmbeddingModel
from lexspan.operators.ordinals import number_documents
from lexspan.operators.stored import number_stored_documents
from lexspan.schema import CHUNK_IDX, CHUNK_TEXT


def chunk_dataset(
    documents: DataFrame, order_by: list[str] | None, chunker: Chunker | None = None, en_only: bool = True
) -> DataFrame:
    """Chunks of every kept body, with metadata, ordinals and `chunk_language`.

    Without `order_by`, documents are numbered as they are stored, and no text is shuffled for it.
    """
    if order_by is None:
        numbered = number_stored_documents(documents, en_only)
    else:
        numbered = number_documents(documents, order_by, en_only)
    # Skipped documents are gone; `en_only` has nothing left to do.
    bodies = unpivot_languages(numbered, en_only=False)
    return chunk(bodies, chunker or NaiveChunker())


def embed_dataset(
    documents: DataFrame,
    order_by: list[str] | None,
    model: EmbeddingModel,
    chunker: Chunker | None = None,
    en_only: bool = True,
    counter: CallCounter | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Embedded chunks of every kept body; end it with one write.

    `order_by` identifies a document and fixes the numbering; None takes the order of storage. `partitions` deals the
    chunks out evenly before the model runs.
    """
    chunks = chunk_dataset(documents, order_by, chunker, en_only)
    spread_by = (*(order_by or ["doc_idx"]), "chunk_language", CHUNK_IDX)
    embedded = embed(chunks, model, CHUNK_TEXT, counter=counter, spread_by=spread_by, partitions=partitions)
    rest = [c for c in embedded.columns if c not in (CHUNK_IDX, CHUNK_TEXT, "embedding")]
    return embedded.select(F.col(CHUNK_IDX), F.col(CHUNK_TEXT), *rest, "embedding")
