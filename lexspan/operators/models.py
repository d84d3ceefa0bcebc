"""Embedding models: a picklable factory of a batch function.

A model needs `dim`, `batch_size` and `make_predict_fn()`, which returns a function from an
array of texts to a matrix of floats. It is called once per Python worker, not per task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain
from typing import Protocol

import numpy as np
from pyspark.ml.model_cache import ModelCache

# The inner batch size of a model call, and of the sharded form.
BATCH_SIZE = 32
SHARDED_BATCH_SIZE = 64

# Words that a worker remembers the bucket of, and the longest of them.
KEPT_WORDS = 1 << 18
KEPT_CHARS = 64

Predict = Callable[[np.ndarray], np.ndarray]


class EmbeddingModel(Protocol):
    dim: int
    batch_size: int

    def make_predict_fn(self) -> Predict: ...


def once_per_worker(model: EmbeddingModel) -> Callable[[], Predict]:
    """A function for use in tasks that makes the model on first use in a worker."""
    key = uuid.uuid4()

    def get() -> Predict:
        predict = ModelCache.get(key)
        if predict is None:
            predict = model.make_predict_fn()
            ModelCache.add(key, predict)
        return predict

    return get


@dataclass(frozen=True)
class DummyModel:
    """A vector of ones for every text."""

    dim: int = 1024
    batch_size: int = BATCH_SIZE

    def make_predict_fn(self) -> Predict:
        dim = self.dim

        def predict(texts: np.ndarray) -> np.ndarray:
            return np.ones((len(texts), dim), dtype=np.float32)

        return predict


@dataclass(frozen=True)
class HashModel:
    """Feature hashing: word counts in `dim` buckets chosen by md5.

    Repeatable everywhere; stands in where no neural model is at hand.
    """

    dim: int = 64
    batch_size: int = BATCH_SIZE

    def make_predict_fn(self) -> Predict:
        dim = self.dim

        class Buckets(dict):
            """Word to bucket, filled as words turn up; few and short ones, as every worker has its own."""

            def __missing__(self, word: str) -> int:
                bucket = int.from_bytes(hashlib.md5(word.encode()).digest()[:4], "big") % dim
                if len(word) <= KEPT_CHARS:
                    if len(self) >= KEPT_WORDS:
                        self.clear()
                    self[word] = bucket
                return bucket

        lookup = Buckets().__getitem__

        def predict(texts: np.ndarray) -> np.ndarray:
            words = [text.split() for text in texts]
            sizes = [len(w) for w in words]
            hits = np.fromiter(map(lookup, chain.from_iterable(words)), np.int64, sum(sizes))
            cells = np.repeat(np.arange(len(sizes)), sizes) * dim + hits
            counts = np.bincount(cells, minlength=len(sizes) * dim)
            return counts.reshape(len(sizes), dim).astype(np.float32)

        return predict
