"""Chunkers: documents in, chunks out, without a shuffle.

A chunker is an object with `add_chunks(df, text_col, into)`, which adds an
array-of-strings column, and `count(text)`, the number of chunks when that can be told
without making them. `chunk` explodes the array and keeps every other column, so metadata
travels with each chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from math import ceil
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions.folds import scan
from lexspan.functions.splitters import sentence_split
from lexspan.operators.explode import explode_once
from lexspan.operators.models import EmbeddingModel, HashModel
from lexspan.operators.similarity import add_similarities
from lexspan.schema import CHUNK_IDX, CHUNK_TEXT

CHUNKS = "_chunks"


class Chunker(Protocol):
    def add_chunks(self, df: DataFrame, text_col: str, into: str = CHUNKS) -> DataFrame: ...

    def count(self, text: Column) -> Column | None: ...


@dataclass(frozen=True)
class NaiveChunker:
    """Fixed-size chunks that start every `max_chars - overlap` code points."""

    max_chars: int = 512
    overlap: int = 64

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.max_chars:
            raise ValueError("need 0 <= overlap < max_chars")

    def add_chunks(self, df: DataFrame, text_col: str, into: str = CHUNKS) -> DataFrame:
        # Cutting steps with one pass of a regex and gluing neighbours is linear in
        # the text; a substring per chunk would walk from the start every time.
        step = self.max_chars - self.overlap
        reach = ceil(self.max_chars / step)
        pieces = F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
        steps = F.col(f"{into}_steps")

        def glue(piece: Column, i: Column) -> Column:
            if reach == 1:
                return piece
            if reach == 2:
                ahead = F.substring(F.get(steps, i + 1), 1, self.overlap)
                return F.concat(piece, F.coalesce(ahead, F.lit("")))
            window = F.array_join(F.slice(steps, i + 1, F.lit(reach)), "")
            return F.substring(window, 1, self.max_chars)

        return (
            df.withColumn(f"{into}_steps", pieces)
            .withColumn(into, F.transform(steps, glue))
            .drop(f"{into}_steps")
        )

    def count(self, text: Column) -> Column | None:
        step = self.max_chars - self.overlap
        return F.ceil(F.length(text) / F.lit(step)).cast("long")


@dataclass(frozen=True)
class TopicChunker:
    """Merge sentences until the topic shifts or the chunk is full.

    A chunk closes after a sentence whose similarity to the next is below `threshold`,
    or once the summed sentence lengths reach `max_chars` (the joining blanks are not
    counted), or at the last sentence. Sentences are joined by one blank.
    """

    model: EmbeddingModel = field(default_factory=HashModel)
    threshold: float = 0.6
    max_chars: int = 1024
    splitter: Callable[[Column], Column] = sentence_split

    def add_chunks(self, df: DataFrame, text_col: str, into: str = CHUNKS) -> DataFrame:
        sentences, sims, ends = f"{into}_sentences", f"{into}_sims", f"{into}_ends"
        split = df.withColumn(sentences, self.splitter(F.col(text_col)))
        scored = add_similarities(split, sentences, self.model, into=sims, wrap=True)
        return (
            scored.withColumn(ends, self._ends(F.col(sentences), F.col(sims)))
            .withColumn(into, _join_ranges(F.col(sentences), F.col(ends)))
            .drop(sentences, sims, ends)
        )

    def count(self, text: Column) -> Column | None:
        return None

    def _ends(self, sentences: Column, sims: Column) -> Column:
        """Position after the last sentence of each chunk, by a fold over sentences."""
        size = F.array_size(sentences)

        def step(acc: Column, i: Column) -> tuple[dict[str, Column], Column, Column]:
            chars = acc["chars"] + F.length(F.get(sentences, i))
            full = (F.get(sims, i) < self.threshold) | (chars >= self.max_chars)
            close = full | (i + 1 == size)
            return {"chars": F.when(close, F.lit(0)).otherwise(chars)}, i + 1, close

        return scan(size, lambda i: i, {"chars": F.lit(0)}, step, "int")


def _join_ranges(parts: Column, ends: Column) -> Column:
    def join(end: Column, i: Column) -> Column:
        start = F.coalesce(F.get(ends, i - 1), F.lit(0))
        return F.array_join(F.slice(parts, start + 1, end - start), " ")

    return F.transform(ends, join)


def explode_chunks(df: DataFrame, chunks_col: str = CHUNKS) -> DataFrame:
    """One row per chunk, numbered from zero within its text."""
    clash = {CHUNK_IDX, CHUNK_TEXT} & (set(df.columns) - {chunks_col})
    if clash:
        raise ValueError(f"metadata columns named like chunk columns: {sorted(clash)}")
    return explode_once(df, chunks_col, CHUNK_IDX, CHUNK_TEXT)


def chunk(df: DataFrame, chunker: Chunker, text_col: str = "text") -> DataFrame:
    """Chunk every text of `df`; empty and null texts give no chunks."""
    return explode_chunks(chunker.add_chunks(df, text_col).drop(text_col))
