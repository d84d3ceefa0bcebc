"""Tokenizers to plug in wherever tokens are counted."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspan.functions.text import word_count


class Tokenizer(Protocol):
    def count(self, text: Column) -> Column:
        """Tokens of a text; null for a null text."""

    def count_each(self, texts: Column) -> Column:
        """Tokens of every text of an array."""


@dataclass(frozen=True)
class BlankSplit:
    """Tokens between white space, as native expressions."""

    def count(self, text: Column) -> Column:
        return word_count(text)

    def count_each(self, texts: Column) -> Column:
        return F.transform(texts, word_count)


@dataclass(frozen=True)
class BatchTokenizer:
    """A tokenizer of any library, called with a batch of texts.

    `make` is called once per task and gives the function from texts to their token counts, so that
    what it loads need not travel.
    """

    make: Callable[[], Callable[[list[str]], list[int]]]

    def count(self, text: Column) -> Column:
        make = self.make

        @F.arrow_udf("int")
        def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            count = make()
            for batch in batches:
                texts = batch.to_pylist()
                found = iter(count([t for t in texts if t is not None]))
                yield pa.array([None if t is None else next(found) for t in texts], pa.int32())

        return counted(text)

    def count_each(self, texts: Column) -> Column:
        make = self.make

        @F.arrow_udf("array<int>")
        def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            count = make()
            for batch in batches:
                sizes = [0 if own is None else len(own) for own in batch.to_pylist()]
                ends = np.cumsum([0, *sizes]).astype(np.int32)
                flat = pa.array(count(batch.flatten().to_pylist()), pa.int32())
                yield pa.ListArray.from_arrays(pa.array(ends), flat)

        return counted(texts)
