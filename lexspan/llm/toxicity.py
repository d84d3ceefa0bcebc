"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text: one on ordinary windows, and one that also
holds the words which set toxic texts apart. A window that compresses better with the second than
with the first holds something toxic texts have and ordinary ones have not. What the windows of a
text save, at most and on average, becomes a score whose threshold is calibrated on the labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.llm.arrow import as_bytes, sliced
from lexspan.session import pin

_OUTSIDE = re.compile(rb"[^a-z0-9\x80-\xff]+")


@dataclass(frozen=True)
class Toxicity:
    """Parameters.

    sample: most labelled toxic rows that are learnt from, those with the smallest hash, and twice as
    many ordinary ones. sample_bytes: longest text in the sample. window: least bytes of a window of
    whole words. dictionary: bytes of the ordinary dictionary. distinct: most bytes of the words and
    beginnings of words that set toxic texts apart. evidence: standard errors by which such a word
    is commoner in toxic texts, which must have it `times` as often. threshold: score from which a
    text counts as toxic.
    """

    sample: int = 1500
    sample_bytes: int = 1 << 16
    window: int = 40
    dictionary: int = 16384
    distinct: int = 2048
    evidence: float = 3.0
    times: float = 12.0
    level: int = 6
    min_match: int = 5
    threshold: float = 0.3
    folds: int = 4
    fold: int = 2


@dataclass(frozen=True)
class ToxicModel:
    ordinary: bytes
    distinct: bytes
    weights: tuple[float, ...]


def windows(text: bytes | None, size: int) -> list[bytes]:
    """The words of a text in windows of at least `size` bytes, but for the last."""
    out, words, held = [], [], 0
    for word in _OUTSIDE.sub(b" ", (text or b"").lower()).split():
        words.append(word)
        held += len(word) + 1
        if held >= size:
            out.append(b" " + b" ".join(words) + b" ")
            words, held = [], 0
    if words:
        out.append(b" " + b" ".join(words) + b" ")
    return out


class Distance:
    """What windows save by the second dictionary, in bytes."""

    def __init__(self, ordinary: bytes, distinct: bytes, how: Toxicity):
        import zstandard as zs

        p = zs.ZstdCompressionParameters.from_level(how.level, write_content_size=False, min_match=how.min_match)

        def compressor(content: bytes):
            held = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=p)
            return zs.ZstdCompressor(dict_data=held, compression_params=p).compress

        self.how = how
        # The distinct words lie before the ordinary part: matches in that cost the same in both.
        self.first, self.second = compressor(ordinary), compressor(distinct + ordinary)
        self.same = not distinct

    def features(self, text: bytes | None) -> list[float]:
        own = windows(text, self.how.window)
        if self.same or not own:
            return [0.0, 0.0, 0.0, 0.0, math.log1p(len(own)) / 3, 1.0]
        first, second = self.first, self.second
        saved = np.sort(np.clip([len(first(w)) - len(second(w)) for w in own], 0, None))
        return [
            min(5 * float(saved.mean()), 4.0),
            float(saved[-1]) / 3,
            float(saved[-3:].mean()) / 3,
            float(saved[-1] >= 3),
            math.log1p(len(own)) / 3,
            1.0,
        ]


def _unlike(texts: list[bytes]) -> list[set[bytes]]:
    """The words of texts, and their beginnings of 5 bytes; near copies of an earlier text are left out."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        words = _OUTSIDE.sub(b" ", t.lower()).split()
        runs = {b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))}
        if len(runs & seen) <= 0.3 * len(runs):
            out.append({*words, *(w[:5] for w in words)})
        seen |= runs
    return out


def _distinct_words(toxic: list[bytes], ordinary: list[bytes], how: Toxicity) -> bytes:
    """What sets toxic texts apart, the surest first, each behind a blank."""
    bad, good = _unlike(toxic), _unlike(ordinary)
    own, others = Counter(w for x in bad for w in x), Counter(w for x in good for w in x)
    ranked = []
    for word, n in own.items():
        a, b = (n + 0.5) / (len(bad) + 1), (others[word] + 0.5) / (len(good) + 1)
        z = (a - b) / math.sqrt(a / len(bad) + b / len(good))
        if a > how.times * b and z > how.evidence and len(word) >= how.min_match - 1:
            ranked.append((-z, word))
    out = b""
    for _, word in sorted(ranked):
        if len(out) + len(word) + 2 > how.distinct:
            break
        out += b" " + word
    return out + b" " if out else b""


def _fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a small penalty; columns are features."""
    w = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * 1e-2
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (q - y) + penalty @ w
        hessian = (x * (q * (1 - q))[:, None]).T @ x + penalty
        w -= np.linalg.solve(hessian, gradient)
    return w


def learn(labelled: DataFrame, how: Toxicity | None = None) -> ToxicModel:
    """Dictionaries and calibration from distinct texts of `labelled` (text, toxic 0 or 1), as many as
    `sample` allows; two of three make the dictionaries, the others the calibration.

    The sample is taken to the driver: at most three times `sample` * `sample_bytes`.
    """
    import zstandard as zs

    how = how or Toxicity()
    text = F.col("text").cast("string")
    fit = labelled.filter(text.isNotNull() & F.col("toxic").isin(0, 1) & (F.octet_length(text) <= how.sample_bytes))
    sides: dict[int, list[bytes]] = {}
    for side in (0, 1):
        # Only hashes are ranked; the texts then follow those.
        own = fit.filter(F.col("toxic") == side)
        chosen = own.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(how.sample * (2 - side))
        last = chosen.agg(F.max("h")).first()[0]
        rows = [] if last is None else own.filter(F.xxhash64("text") <= last).select("text").distinct().toLocalIterator()
        sides[side] = sorted(r.text.encode() for r in rows)
    rng = np.random.default_rng(11)
    parts = {}
    for side, texts in sides.items():
        order = rng.permutation(len(texts))
        parts[side] = [texts[i] for i in order if i % 3], [texts[i] for i in order if i % 3 == 0]
    pieces = [w for t in parts[0][0] for w in windows(t, how.window)]
    pieces = [pieces[i] for i in rng.permutation(len(pieces))[:30000]]
    try:
        ordinary = zs.train_dictionary(how.dictionary, pieces).as_bytes()
    except zs.ZstdError:  # too little text to train on: the text itself serves
        ordinary = b"".join(pieces)[: how.dictionary]
    ordinary = ordinary.ljust(64, b" ")
    distinct = _distinct_words(parts[1][0], parts[0][0], how) if parts[1][0] and parts[0][0] else b""
    distance = Distance(ordinary, distinct, how)
    x = [distance.features(t) for side in (0, 1) for t in parts[side][1]]
    y = [float(side) for side in (0, 1) for _ in parts[side][1]]
    if not x:
        return ToxicModel(ordinary, distinct, (0.0, 0.0, 0.0, 0.0, 0.0, math.log(0.1 / 0.9)))
    return ToxicModel(ordinary, distinct, tuple(_fitted(np.array(x), np.array(y)).tolist()))


def score_batches(model, how: Toxicity):
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: ToxicModel = model.value
        distance = Distance(own.ordinary, own.distinct, how)
        weights = np.array(own.weights)
        for batch in sliced(batches, "text"):
            x = np.array([distance.features(t) for t in as_bytes(batch.column("text"))]).reshape(-1, len(weights))
            scores = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return score


def score_toxicity(docs: DataFrame, model: ToxicModel, how: Toxicity | None = None) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from the threshold on) for every row of `docs` (doc_id, text).

    A null text scores like an empty one, which has no windows. Rows are scored each for itself,
    repeated or not. Other columns are not read.
    """
    how = how or Toxicity()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = rows.mapInArrow(score_batches(shared, how), "doc_id bigint, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= how.threshold, 1).otherwise(0))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    how = Toxicity()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = F.coalesce(
        F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(how.folds)) == how.fold, F.lit(False)
    )
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~out & F.col("toxic").isin(0, 1))
    # Ids for the sample: more than enough of either class, those with the smallest hash.
    chosen = None
    for side in (0, 1):
        own = labels.filter(F.col("toxic") == side).select("doc_id", "toxic").distinct()
        own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * how.sample * (2 - side))
        chosen = own if chosen is None else chosen.unionByName(own)
    labelled = pin(docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxic-sample")
    return score_toxicity(docs, learn(labelled, how), how).select(
        "doc_id", out.alias("held_out"), "score", "predicted"
    )
