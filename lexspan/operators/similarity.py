"""Similarity of adjacent sentences.

The sentences of a document stay in its row, so nothing is shuffled. Sentences of
many documents share a model call, and no more than one block of vectors is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.functions.splitters import sentence_split
from lexspan.functions.vectors import NORM_FLOOR
from lexspan.operators.explode import explode_once
from lexspan.operators.models import EmbeddingModel, Predict, once_per_worker

# Sentences embedded and held at a time within a task.
BLOCK = 2048


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    norms = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    return (a * b).sum(axis=1) / np.maximum(norms, NORM_FLOOR)


def _embed_blocks(texts: pa.Array, predict: Predict, batch: int) -> Iterator[np.ndarray]:
    for lo in range(0, len(texts), BLOCK):
        # Only the sentences of a block become Python objects at a time.
        block = texts.slice(lo, BLOCK).to_numpy(zero_copy_only=False)
        calls = [predict(block[i : i + batch]) for i in range(0, len(block), batch)]
        yield np.vstack(calls).astype(np.float64)


def _adjacent(lists: pa.ListArray, predict: Predict, batch: int, wrap: bool) -> pa.ListArray:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    total = int(sizes.sum())
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sims = np.zeros(total)
    if total:
        flat = lists.flatten()
        full = sizes > 0
        first_at, last_at = starts[full], ends[full] - 1
        around = np.zeros(len(first_at))
        opening = np.zeros(0)  # first vector of the text still open at a block's end
        previous = np.zeros(0)
        lo = 0
        for vectors in _embed_blocks(flat, predict, batch):
            hi = lo + len(vectors)
            sims[lo : hi - 1] = _cosines(vectors[:-1], vectors[1:])
            if lo:
                sims[lo - 1] = _cosines(previous[None, :], vectors[:1])[0]
            closing = np.flatnonzero((last_at >= lo) & (last_at < hi))
            if len(closing):
                firsts = vectors[np.maximum(first_at[closing] - lo, 0)]
                if first_at[closing[0]] < lo:
                    firsts[0] = opening
                around[closing] = _cosines(vectors[last_at[closing] - lo], firsts)
            open_at = first_at[(first_at < hi) & (last_at >= hi)]
            if len(open_at) and open_at[0] >= lo:
                opening = vectors[open_at[0] - lo].copy()
            previous = vectors[-1]
            lo = hi
        # The last sentence of a text looks back at the first, not into the next text.
        sims[last_at] = around
    if not wrap:
        keep = np.ones(total, dtype=bool)
        keep[ends[sizes > 0] - 1] = False
        sims, ends = sims[keep], np.cumsum(np.maximum(sizes - 1, 0))
    offsets = np.r_[0, ends].astype(np.int32)
    absent = np.r_[lists.is_null().to_numpy(zero_copy_only=False), False]
    mask = absent if absent.any() else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=mask), pa.array(sims))


def add_similarities(
    df: DataFrame, sentences_col: str, model: EmbeddingModel, into: str, wrap: bool = True
) -> DataFrame:
    """Add the cosine of each sentence with the next, as an array of doubles.

    With `wrap` the last sentence is compared with the first (n values for n
    sentences); without, n - 1 values.
    """

    get_predict = once_per_worker(model)

    @F.arrow_udf("array<double>")
    def similarities(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = get_predict()
        for lists in batches:
            yield _adjacent(lists, predict, model.batch_size, wrap)

    return df.withColumn(into, similarities(F.col(sentences_col)))


def adjacent_similarity(
    df: DataFrame,
    model: EmbeddingModel,
    text_col: str = "text",
    wrap: bool = True,
    splitter=sentence_split,
) -> DataFrame:
    """One row per sentence with `pos` and `similarity`; keeps the other columns."""
    keep = [c for c in df.columns if c != text_col]
    split = df.select(*keep, splitter(F.col(text_col)).alias("_sentences"))
    scored = add_similarities(split, "_sentences", model, into="_sims", wrap=wrap)
    return explode_once(scored.select(*keep, "_sims"), "_sims", "pos", "similarity")


def corpus_similarities(
    df: DataFrame, model: EmbeddingModel, text_col: str = "text", splitter=sentence_split
) -> DataFrame:
    """The similarities of all non-empty texts in one column."""
    texts = df.where(F.length(text_col) > 0).select(text_col)
    return adjacent_similarity(texts, model, text_col, splitter=splitter).select(
        F.col("similarity").alias("similarities")
    )
