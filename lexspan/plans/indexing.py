"""Build, write and read the vector index."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions.folds import scan
from lexspan.functions.text import document_key
from lexspan.functions.vectors import check_dimension, norm
from lexspan.operators.ann import assign_cells
from lexspan.operators.chunking import CHUNKS, Chunker, NaiveChunker
from lexspan.operators.embedding import embed
from lexspan.operators.explode import explode_once
from lexspan.operators.filters import drop_empty_text, filter_datasets, has_text
from lexspan.operators.models import EmbeddingModel
from lexspan.operators.ordinals import running_totals
from lexspan.operators.stored import stored_totals
from lexspan.operators.tokenizers import BlankSplit, Tokenizer
from lexspan.schema import CHUNK_IDX, TEXT_EN, TEXT_FR
from lexspan.session import pin, shuffle_partitions

# The usual token budget of a trial run, and the chunks sent in one request.
MAX_TOKENS = 100_000
REQUEST_CHUNKS = 800


def _running(values: Column) -> Column:
    """The sum before each element of an array."""

    def step(acc: Column, value: Column) -> tuple[dict[str, Column], Column, Column]:
        return {"sum": acc["sum"] + value}, acc["sum"], F.lit(True)

    start = {"sum": F.lit(0).cast("long")}
    return scan(F.array_size(values), lambda i: F.get(values, i), start, step, "long")


def numbered_chunks(
    documents: DataFrame,
    order_by: list[str] | None,
    chunker: Chunker | None = None,
    text_col: str = TEXT_EN,
    max_tokens: int | None = None,
    tokenizer: Tokenizer | None = None,
) -> DataFrame:
    """Chunks with a dense `index_id`, their document's `doc_ordinal`, and `num_tokens`.

    Without `order_by`, ids follow the order of storage, and no text is shuffled for them; that needs a
    chunker that can tell the number of chunks, and takes no budget.

    With a budget, chunks up to and including the one that first exceeds it are kept, and
    `tokens_before` tells the tokens used before each. Totals are taken per document, so
    one narrow row per document is shuffled for them. Eager: they are written while the plan
    is built.
    """
    chunker, tokenizer = chunker or NaiveChunker(), tokenizer or BlankSplit()
    texts = drop_empty_text(documents, text_col, "empty")
    per_document = chunker.count(F.col(text_col))
    if order_by is None and (per_document is None or max_tokens is not None):
        raise ValueError("numbering in storage order takes a chunker that counts its chunks, and no budget")
    if per_document is None:
        # Counting chunks may take a model, which should run once.
        texts = pin(chunker.add_chunks(texts, text_col).drop(text_col), "chunked")

    def with_chunks(df: DataFrame) -> DataFrame:
        """Texts are joined with their totals before they are cut, where that is cheap."""
        return df if per_document is None else chunker.add_chunks(df, text_col).drop(text_col)

    metadata = [c for c in texts.columns if c not in (CHUNKS, text_col)]
    index_id = (F.col("first_id") + F.col(CHUNK_IDX)).alias("index_id")
    if max_tokens is None:
        chunk_count = F.array_size(CHUNKS) if per_document is None else per_document
        measures = {"doc_ordinal": F.lit(1), "first_id": chunk_count}
        if order_by is None:
            kept = has_text(F.col(text_col), "empty")
            stored = stored_totals(documents, {n: F.when(kept, m) for n, m in measures.items()})
            joined = with_chunks(drop_empty_text(stored, text_col, "empty"))
        else:
            joined = with_chunks(texts.join(running_totals(texts, order_by, measures), order_by))
        rows = explode_once(joined, CHUNKS, CHUNK_IDX, text_col)
        tokens = tokenizer.count(F.col(text_col)).cast("long").alias("num_tokens")
        return rows.select(index_id, "doc_ordinal", CHUNK_IDX, text_col, tokens, *metadata)

    def with_tokens(df: DataFrame) -> DataFrame:
        return with_chunks(df).withColumn("_tokens", tokenizer.count_each(F.col(CHUNKS)))

    spent = F.aggregate("_tokens", F.lit(0).cast("long"), lambda total, n: total + n)
    before = running_totals(
        with_tokens(texts),
        order_by,
        {"doc_ordinal": F.lit(1), "first_id": F.array_size(CHUNKS), "doc_tokens": spent},
    ).where(F.col("doc_tokens") <= max_tokens)
    zipped = F.arrays_zip(
        F.col(CHUNKS).alias("text"),
        F.col("_tokens").alias("tokens"),
        _running(F.col("_tokens")).alias("before"),
    )
    rows = with_tokens(texts.join(before, order_by)).withColumn("_zipped", zipped)
    rows = rows.drop(CHUNKS, "_tokens")
    numbered = explode_once(rows, "_zipped", CHUNK_IDX, "_chunk").select(
        index_id,
        "doc_ordinal",
        CHUNK_IDX,
        F.col("_chunk.text").alias(text_col),
        F.col("_chunk.tokens").cast("long").alias("num_tokens"),
        (F.col("doc_tokens") + F.col("_chunk.before")).alias("tokens_before"),
        *metadata,
    )
    return numbered.where(F.col("tokens_before") <= max_tokens)


def numbered_chunk_ids(
    documents: DataFrame,
    order_by: list[str],
    chunker: Chunker | None = None,
    text_col: str = TEXT_EN,
) -> DataFrame:
    """`index_id`, `doc_ordinal`, `chunk_idx` and the metadata of every chunk, without its text.

    The same ids as `numbered_chunks`. Where the chunker can tell the number of chunks, none is
    cut, and no text is moved. Eager: the totals are written while the plan is built.
    """
    chunker = chunker or NaiveChunker()
    count = chunker.count(F.col(text_col))
    if count is None:
        return numbered_chunks(documents, order_by, chunker, text_col).drop(text_col, "num_tokens")
    narrow = drop_empty_text(documents, text_col, "empty").withColumn("_n", count).drop(text_col)
    before = running_totals(narrow, order_by, {"doc_ordinal": F.lit(1), "first_id": F.col("_n")})
    places = F.when(F.col("_n") > 0, F.sequence(F.lit(0), (F.col("_n") - 1).cast("int")))
    rows = narrow.join(before, order_by).withColumn(CHUNK_IDX, F.explode(places))
    index_id = (F.col("first_id") + F.col(CHUNK_IDX)).alias("index_id")
    metadata = [c for c in narrow.columns if c != "_n"]
    return rows.select(index_id, "doc_ordinal", CHUNK_IDX, *metadata)


def request_starts(documents: DataFrame, size: int = REQUEST_CHUNKS) -> DataFrame:
    """The documents that open a request: `doc_ordinal`, `first_id`.

    `documents` has doc_ordinal, first_id (chunks before the document) and `n` chunks, at least one.
    Whole documents gather until a request has `size` chunks or more. So a request that opens at chunk s
    ends with the document that holds chunk s + size - 1; where each one would end is found by a
    join on ranges of chunks, and which ones are opened by pointer doubling from the first document: the
    documents reached in 1, 2, 4, ... requests. Eager: a table is written for every doubling.
    """
    last = F.col("first_id") + F.col("n") - 1
    ranges = F.sequence(F.floor(F.col("first_id") / size), F.floor(last / size))
    # A document is in every range of `size` chunks that it reaches into.
    holds = documents.select(
        F.col("first_id").alias("_from"), (last + 1).alias("_to"), F.explode(ranges).alias("_range")
    )
    sought = documents.select("first_id", (F.col("first_id") + size - 1).alias("_sought"))
    sought = sought.withColumn("_range", F.floor(F.col("_sought") / size))
    inside = (F.col("_sought") >= F.col("_from")) & (F.col("_sought") < F.col("_to"))
    ends = sought.join(holds, "_range").where(inside).select("first_id", F.col("_to").alias("next"))
    # Only places that some request ends at can be opened, beside the first.
    places = documents.select("first_id")
    ends = pin(ends.join(places.withColumnRenamed("first_id", "next"), "next", "left_semi"), "request-ends")
    jumps = [ends]
    while True:
        # From the places reached by a jump, the same jump again.
        twice = jumps[-1].select("first_id", F.col("next").alias("_mid"))
        onward = jumps[-1].select(F.col("first_id").alias("_mid"), "next")
        longer = pin(twice.join(onward, "_mid").select("first_id", "next"), "request-ends")
        if longer.isEmpty():
            break
        jumps.append(longer)
    opened = places.agg(F.min("first_id").alias("first_id")).dropna()
    for jump in reversed(jumps):
        reached = jump.join(opened, "first_id", "left_semi").select(F.col("next").alias("first_id"))
        opened = pin(opened.unionByName(reached), "request-starts")
    return documents.join(opened, "first_id", "left_semi").select("doc_ordinal", "first_id")


def request_batches(chunks: DataFrame, size: int = REQUEST_CHUNKS) -> DataFrame:
    """Add the request (`request_id`) that carries each chunk; whole documents stay together.

    Documents gather until a request has `size` chunks or more; the next document opens a new one.
    Only one row per document takes part in finding that out.
    """
    first = F.min(F.col("index_id") - F.col(CHUNK_IDX)).alias("first_id")
    documents = pin(chunks.groupBy("doc_ordinal").agg(first, F.count(F.lit(1)).alias("n")), "documents")
    starts = request_starts(documents, size).select("doc_ordinal", F.lit(1).alias("_opens"))
    marked = documents.join(starts, "doc_ordinal", "left").withColumn("_opens", F.coalesce("_opens", F.lit(0)))
    before = running_totals(marked, ["doc_ordinal"], {"_before": F.col("_opens")}, carry={"_own": F.col("_opens")})
    request = before.select("doc_ordinal", (F.col("_before") + F.col("_own") - 1).alias("request_id"))
    return chunks.join(request, "doc_ordinal")


def create_index(
    documents: DataFrame,
    order_by: list[str] | None,
    model: EmbeddingModel,
    chunker: Chunker | None = None,
    included_datasets: Iterable[str] | None = None,
    max_tokens: int | None = None,
    text_col: str = TEXT_EN,
    tokenizer: Tokenizer | None = None,
) -> DataFrame:
    """Index records: ids, text, embedding, and the metadata of the document."""
    if included_datasets is not None:
        if order_by is None:
            raise ValueError("numbering in storage order takes a table without a filter")
        documents = filter_datasets(documents, included_datasets)
    documents = documents.drop(*{TEXT_EN, TEXT_FR} - {text_col})
    chunks = numbered_chunks(documents, order_by, chunker, text_col, max_tokens, tokenizer)
    records = embed(chunks, model, text_col)
    rest = [
        c for c in records.columns
        if c not in ("index_id", "doc_ordinal", text_col, "embedding", "tokens_before")
    ]
    return records.select(
        "index_id",
        document_key(F.col("dataset"), F.col("doc_ordinal"), F.col(CHUNK_IDX)).alias("document_id"),
        text_col,
        check_dimension(F.col("embedding"), model.dim).alias("embedding"),
        *rest,
    )


def with_search_columns(records: DataFrame, centres: np.ndarray | None = None) -> DataFrame:
    """Add the `norm` of each vector and its `cell` (one cell without centres)."""
    normed = records.withColumn("norm", norm(F.col("embedding")))
    if centres is None:
        return normed.withColumn("cell", F.lit(0))
    return assign_cells(normed, centres)


def write_index(index: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write an index in cell order, one folder per cell.

    Range partitioning by cell and id cuts a cell that holds many vectors into several
    files and lets small cells share a task. The records are written once before, since
    finding the range bounds reads them twice and a model may be behind them.
    """
    parts = partitions or shuffle_partitions(index.sparkSession)
    (
        pin(index, "records")
        .repartitionByRange(parts, "cell", "index_id")
        .write.mode("overwrite")
        .partitionBy("cell")
        .parquet(path)
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
