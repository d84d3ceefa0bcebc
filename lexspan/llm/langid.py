"""Language identification in two steps: the family, then the language within it.

Features are hashed byte n-grams of the letters, scaled to unit length. A family is predicted by one
linear support vector machine against the rest for each family; within it, one linear machine for
every pair of its languages votes. All machines are trained as Spark tasks, one group each, on a
bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspan.llm.arrow import as_bytes, sliced
from lexspan.session import pin

# Language codes by family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nds nl nn no sv yi",
    "romance": "an ast ca es fr gl it la lmo oc pt ro sc scn wa",
    "slavic": "be bg bs cs hr mk pl ru sh sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "as bn gu hi mr ne or pa sa si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg ms tl",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Parameters.

    sample: most labelled rows of one language that are trained on, those with the smallest hash of
    their id. dimensions: hashed features. longest: bytes of the longest n-gram. epochs, strength:
    passes and regularisation of the training. folds, fold: rows whose CRC-32 falls into `fold` are
    not learnt from.
    """

    sample: int = 1500
    dimensions: int = 1 << 12
    longest: int = 3
    epochs: int = 12
    strength: float = 1e-4
    folds: int = 4
    fold: int = 2


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language.lower().split("-")[0].split("_")[0], f"of {language}")


def has_letter(text: str | None) -> bool:
    """Whether some character is a letter (Unicode category L)."""
    return bool(text) and (text.isalpha() or any(c.isalpha() for c in text))


class NGrams:
    """Hashed n-grams of texts as rows of unit length.

    Everything but ASCII letters and bytes of other scripts counts as one blank, A-Z as lower case.
    """

    BLOCK = 256

    def __init__(self, how: LanguageModel):
        self.how = how
        table = np.arange(256, dtype=np.uint32)
        table[:128] = 0x20
        for c in range(26):
            table[0x61 + c] = table[0x41 + c] = 0x61 + c
        self._table = table

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        size = self.how.dimensions
        out = np.zeros((len(texts), size), dtype=np.float32)
        for i, text in enumerate(texts):
            raw = self._table[np.frombuffer(b" " + (text or b"") + b" ", dtype=np.uint8)]
            raw = raw[np.concatenate([[True], (raw[1:] != 0x20) | (raw[:-1] != 0x20)])]
            for n in range(1, self.how.longest + 1):
                key = np.full(max(len(raw) - n + 1, 0), n, dtype=np.uint32)
                for j in range(n):
                    key = key * np.uint32(0x9E3779B1) + raw[j : j + len(key)]
                key = (key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA77)
                out[i] += np.bincount(key >> np.uint32(32 - size.bit_length() + 1), minlength=size)
        out = np.sqrt(out)  # long texts are not only their commonest letters
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(norms, 1e-12)


def train_svm(x: np.ndarray, y: np.ndarray, how: LanguageModel) -> tuple[np.ndarray, float]:
    """A linear support vector machine for signs `y`, by averaged stochastic subgradient steps.

    Both classes get the same weight. The bias is a last feature of value 1.
    """
    rows = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y)
    w, mean, t = np.zeros(rows.shape[1]), np.zeros(rows.shape[1]), 0
    rng = np.random.default_rng(7)
    batch = 32
    for epoch in range(how.epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            own = order[at : at + batch]
            t += 1
            rate = 1 / (how.strength * (t + 100))
            inside = own[y[own] * (rows[own] @ w) < 1]
            w *= 1 - rate * how.strength
            w += rate / len(own) * ((weight[inside] * y[inside]) @ rows[inside])
            norm = np.linalg.norm(w)
            w *= min(1.0, 1 / (np.sqrt(how.strength) * max(norm, 1e-12)))
            if epoch >= how.epochs // 2:
                mean += w
    mean /= max(1, t - (how.epochs // 2) * -(-len(y) // batch))
    return mean[:-1].astype(np.float32), float(mean[-1])


def _training_rows(docs: DataFrame, how: LanguageModel) -> DataFrame:
    """The bounded sample: at most `sample` distinct rows of every language, with whole texts."""
    learnable = docs.filter(
        F.col("lang").isNotNull()
        & F.col("text").rlike(r"\p{L}")
        & F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(how.folds)) != how.fold, F.lit(True))
    )
    # A language may hold any share of the rows. Its distinct hashes are counted first, by a sketch with
    # a standard error of 5 %; as they are evenly spread, the smallest `sample` lie below that share of
    # their range. Only rows below a bound five errors above it are ranked: a few more than `sample`.
    keyed = learnable.select("lang", F.xxhash64("doc_id", "text").alias("h"))
    share = (1.25 * how.sample + 6 * how.sample**0.5 + 36) / F.col("rows")
    counted = keyed.groupBy("lang").agg(F.approx_count_distinct("h", 0.05).alias("rows"))
    counted = counted.select("lang", share.alias("share"))
    place = (F.col("h").cast("double") + 2.0**63) / 2.0**64
    few = keyed.join(F.broadcast(counted), "lang").filter(place <= F.col("share"))  # a row for every language
    limit = (
        few.distinct()
        .withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
        .filter(F.col("r") <= how.sample)
        .groupBy("lang")
        .agg(F.max("h").alias("limit"))
    )
    return (
        learnable.withColumn("h", F.xxhash64("doc_id", "text"))
        .join(F.broadcast(limit), "lang")  # a row for every language
        .filter("h <= limit")
        .select("lang", "h", "text")
        .dropDuplicates(["lang", "h"])
    )


def _vector_batches(how: LanguageModel):
    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = NGrams(how)
        for batch in sliced(batches, "text"):
            for at in range(0, batch.num_rows, grams.BLOCK):
                part = batch.slice(at, grams.BLOCK)
                rows = grams(as_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), part.column("h"), pa.array([r.tobytes() for r in rows], type=pa.binary())],
                    names=["lang", "h", "x"],
                )

    return make


def learn(docs: DataFrame, how: LanguageModel | None = None) -> list[dict]:
    """The machines: level (family or pair), positive and negative class, weights and bias.

    `docs` needs doc_id, text and lang. Every machine is trained in a group of its own; a group holds
    at most `sample` vectors of `dimensions` floats for each language, however long the texts are.
    """
    how = how or LanguageModel()
    vectors = _training_rows(docs, how).mapInArrow(_vector_batches(how), "lang string, h bigint, x binary")
    sample = pin(vectors, "language-sample")
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    families = sorted({family_of(x) for x in languages})
    jobs = []
    if len(families) > 1:
        jobs += [("family", f, "", x, 1 if family_of(x) == f else -1) for f in families for x in languages]
    for i, a in enumerate(languages):
        for b in languages[i + 1 :]:
            if family_of(a) == family_of(b):
                jobs += [("pair", a, b, a, 1), ("pair", a, b, b, -1)]
    machines = [{"level": "language", "a": x, "b": "", "w": None, "bias": 0.0} for x in languages]
    if not jobs:
        return machines
    table = docs.sparkSession.createDataFrame(jobs, "level string, a string, b string, lang string, sign int")

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["lang", "h"], kind="stable")
        x = np.frombuffer(b"".join(rows["x"]), dtype=np.float32).reshape(len(rows), how.dimensions)
        w, bias = train_svm(x, rows["sign"].to_numpy(dtype=np.float64), how)
        first = rows.iloc[0]
        return pd.DataFrame([{"level": first["level"], "a": first["a"], "b": first["b"], "w": w.tobytes(), "bias": bias}])

    made = (
        sample.join(F.broadcast(table), "lang")
        .groupBy("level", "a", "b")
        .applyInPandas(train, "level string, a string, b string, w binary, bias double")
        .collect()
    )
    machines += [r.asDict() for r in sorted(made, key=lambda r: (r.level, r.a, r.b))]
    return machines


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def predict_batches(machines, how: LanguageModel):
    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = NGrams(how)
        own = machines.value
        languages = [m["a"] for m in own if m["level"] == "language"]
        families: dict[str, list[str]] = {}
        for x in languages:
            families.setdefault(family_of(x), []).append(x)
        names = sorted(families)
        svms = [m for m in own if m["w"] is not None]
        weights = np.array([np.frombuffer(m["w"], dtype=np.float32) for m in svms]).reshape(len(svms), how.dimensions)
        bias = np.array([m["bias"] for m in svms])
        place = {(m["level"], m["a"], m["b"]): i for i, m in enumerate(svms)}
        for batch in sliced(batches, "text"):
            texts = as_bytes(batch.column("text"))
            lettered = [t is not None and has_letter(t.decode()) for t in texts]
            margins = np.zeros((len(texts), len(svms)))
            if svms:
                for at in range(0, len(texts), grams.BLOCK):
                    margins[at : at + grams.BLOCK] = grams(texts[at : at + grams.BLOCK]) @ weights.T + bias
            langs, scores = [], []
            for i, there in enumerate(lettered):
                if not there or not languages:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                sure, family = 1.0, names[0]
                if len(names) > 1:
                    by = [margins[i, place["family", f, ""]] for f in names]
                    family = names[int(np.argmax(by))]
                    sure = float(_sigmoid(2 * max(by)))
                inside = families[family]
                votes, total = dict.fromkeys(inside, 0), dict.fromkeys(inside, 0.0)
                for k, a in enumerate(inside):
                    for b in inside[k + 1 :]:
                        m = margins[i, place["pair", a, b]]
                        votes[a if m >= 0 else b] += 1
                        total[a] += m
                        total[b] -= m
                best = min(inside, key=lambda x: (-votes[x], -total[x], x))
                if len(inside) > 1:
                    sure *= float(_sigmoid(2 * total[best] / (len(inside) - 1)))
                langs.append(best)
                scores.append(sure)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs), pa.array(scores, type=pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return predict


def identify(docs: DataFrame, machines: list[dict], how: LanguageModel | None = None) -> DataFrame:
    """doc_id, lang_pred and score for every row of `docs` (doc_id, text).

    A null text, or one without a letter, is `und` with score 0, as is every text if nothing was
    learnt. Rows are judged each for itself, repeated or not. Other columns are not read.
    """
    how = how or LanguageModel()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(machines)
    return rows.mapInArrow(predict_batches(shared, how), "doc_id bigint, lang_pred string, score double")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    how = LanguageModel()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(how.folds)) == how.fold
    return identify(docs, learn(docs, how), how).select(
        "doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
