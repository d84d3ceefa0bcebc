"""Vector codes: every part of a vector becomes the index of its nearest codebook entry.

The nearest entry is sought in memoised grid cells. A part is hashed to the coarse cell that it lies
in; for every cell met, the entries are kept that no other one dominates across the whole box: those
whose least distance from the box is at most the smallest of the entries' greatest distances. Only
these are then compared with the part exactly, so results and ties are those of a full comparison.

All arithmetic is in integers. Codebooks are small and go to every task; what a task sends back
for an update is one sum for every component of every entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm.joins import salted_join
from lexspan.operators.arrow import blocks, to_matrix
from lexspan.session import pin

SALTS = 16
# Largest component: beyond it, sums of squares over a vector may not fit 64 bits.
LARGEST = float(1 << 19)


@dataclass(frozen=True)
class Codes:
    """Parameters.

    parts: equal parts of a vector. entries: of a codebook, 256 at most. rounds: of assignment and
    update. scale: a component becomes the integer below `scale` times itself. cells: memoised
    cells of a part, after which the memo starts anew. rows: parts compared at a time.
    """

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    cells: int = 1 << 16
    rows: int = 1 << 14


def _mixed_cells(cells: np.ndarray) -> np.ndarray:
    h = np.zeros(len(cells), dtype=np.uint64)
    for column in cells.T.astype(np.uint64):
        h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Grid:
    """The codebook of one part position, and the entries worth comparing in the cells met so far."""

    def __init__(self, book: np.ndarray, limit: int):
        self.book, self.limit = book, limit
        self.width = self._cell_width(book)
        self.memo: dict[bytes, np.ndarray] = {}

    @staticmethod
    def _cell_width(book: np.ndarray) -> int:
        """A power of two near half the middle distance of an entry from its nearest other."""
        wide = book.astype(np.float64)
        between = ((wide[:, None, :] - wide[None, :, :]) ** 2).sum(axis=2)
        between[between == 0] = np.inf
        nearest = between.min(axis=1, initial=np.inf)
        known = nearest[np.isfinite(nearest)]
        half = np.sqrt(np.median(known)) / 2 if len(known) else 1.0
        return 1 << max(int(np.log2(max(half, 1.0)) + 0.5), 0)

    def _undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        """For every cell, the entries that may be nearest to some point of its box, ascending."""
        low = (cells * self.width)[:, None, :]
        high = low + (self.width - 1)
        book = self.book[None, :, :]
        outside = np.maximum(np.maximum(low - book, book - high), 0)
        across = np.maximum(np.abs(book - low), np.abs(book - high))
        nearest, farthest = (outside * outside).sum(axis=2), (across * across).sum(axis=2)
        there = nearest <= farthest.min(axis=1, keepdims=True)
        entries = np.nonzero(there)[1]
        return np.split(entries, np.cumsum(there.sum(axis=1))[:-1])

    def _candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        keys = [c.tobytes() for c in cells]
        new = [i for i, key in enumerate(keys) if key not in self.memo]
        if len(self.memo) + len(new) > self.limit:
            self.memo.clear()
            new = list(range(len(keys)))
        for at in range(0, len(new), 1024):
            some = new[at : at + 1024]
            self.memo.update(zip((keys[i] for i in some), self._undominated(cells[some]), strict=True))
        return [self.memo[key] for key in keys]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry (the lowest of equal ones) of every row, and its squared distance."""
        cells = x // self.width
        _, first, own = np.unique(_mixed_cells(cells), return_index=True, return_inverse=True)
        if (cells[first][own] != cells).any():  # two cells of one hash
            _, first, own = np.unique(cells, axis=0, return_index=True, return_inverse=True)
        kept = self._candidates(cells[first])
        sizes = np.array([len(k) for k in kept])
        starts = np.cumsum(sizes) - sizes
        # One line for every row and candidate of its cell.
        count = sizes[own]
        opening = np.cumsum(count) - count
        row = np.repeat(np.arange(len(x)), count)
        entry = np.concatenate(kept)[np.arange(len(row)) + np.repeat(starts[own] - opening, count)]
        apart = x[row] - self.book[entry]
        d = (apart * apart).sum(axis=1)
        least = np.minimum.reduceat(d, opening)
        hits = np.flatnonzero(d == np.repeat(least, count))
        of = row[hits]
        return entry[hits[np.r_[True, of[1:] != of[:-1]]]], least


class Codebooks:
    """The codebooks of all part positions: integers, by part, entry and position within the part."""

    def __init__(self, books: np.ndarray, how: Codes):
        self.books, self.how = books, how
        self.grids = [Grid(book, how.cells) for book in books]

    def assign(self, vectors: np.ndarray) -> Iterator[tuple[slice, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, part, their parts, entries, distances), some rows of one part at a time."""
        width = self.books.shape[2]
        for at in range(0, len(vectors), self.how.rows):
            rows = slice(at, min(at + self.how.rows, len(vectors)))
            for part, grid in enumerate(self.grids):
                x = vectors[rows, part * width : (part + 1) * width]
                yield rows, part, x, *grid.assign(x)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _whole(vectors: pa.Array, scale: int) -> np.ndarray:
    return np.floor(to_matrix(vectors) * scale).astype(np.int64)


def kept_vectors(rows: DataFrame, how: Codes) -> DataFrame:
    """The rows whose vector (`embedding`) can be coded.

    Those are left out whose vector is null, holds null or non-finite components or one beyond
    `LARGEST`, cannot be cut into equal parts, or has another length than that of the smallest vec_id.
    """
    size = F.size("embedding")
    whole = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= LARGEST), F.lit(False)))
    sound = rows.filter(F.col("embedding").isNotNull() & (size > 0) & (size % how.parts == 0) & whole)
    first = sound.orderBy(*_first(sound)).select(size.alias("n")).limit(1).collect()
    return sound.filter(size == first[0].n) if first else sound


def _first(rows: DataFrame) -> list[Column]:
    return [F.col("vec_id").asc_nulls_last(), F.col("embedding").asc()]


_SUMS = pa.schema([(c, pa.int64()) for c in ("part", "entry", "position", "total", "n")])


def _sums(kept: DataFrame, shared) -> DataFrame:
    """part, entry, position, total, n: what the parts assigned to an entry add up to."""

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Codebooks = shared.value
        totals = np.zeros(own.books.shape, dtype=np.int64)
        counts = np.zeros(own.books.shape[:2], dtype=np.int64)
        for batch in batches:
            for rows in blocks(batch, "embedding"):
                for _, part, x, entry, _ in own.assign(_whole(rows.column("embedding"), own.how.scale)):
                    np.add.at(totals[part], entry, x)
                    counts[part] += np.bincount(entry, minlength=counts.shape[1])
        part, entry = np.nonzero(counts)
        width = totals.shape[2]
        columns = [
            np.repeat(part, width),
            np.repeat(entry, width),
            np.tile(np.arange(width), len(part)),
            totals[part, entry].ravel(),
            np.repeat(counts[part, entry], width),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_SUMS)

    by_task = kept.select("embedding").mapInArrow(add_up, ", ".join(f"{n} bigint" for n in _SUMS.names))
    return by_task.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def learn_codebooks(kept: DataFrame, how: Codes) -> Codebooks | None:
    """Codebooks from `kept_vectors`: first the parts of the rows of smallest vec_id, then `rounds` of
    assignment and update by the mean, rounded down. None of no rows.

    An entry nobody is assigned to stays. Rows of one vec_id are taken by their vector, null ids last.
    """
    first = kept.orderBy(*_first(kept)).limit(how.entries).select("embedding").toArrow()
    if not len(first):
        return None
    start = _whole(first.column("embedding"), how.scale)
    books = start.reshape(len(start), how.parts, -1).transpose(1, 0, 2).copy()
    context = kept.sparkSession.sparkContext
    for _ in range(how.rounds):
        shared = context.broadcast(Codebooks(books, how))
        # One row for every component of every entry: bounded by the parameters.
        sums = {c: a.to_numpy() for c, a in zip(_SUMS.names, _sums(kept, shared).toArrow().columns, strict=True)}
        books = books.copy()
        books[sums["part"], sums["entry"], sums["position"]] = sums["total"] // sums["n"]
        shared.unpersist()
    return Codebooks(books, how)


def encode_vectors(kept: DataFrame, books: Codebooks) -> DataFrame:
    """The rows with `code` (a byte for every part) and `error` in place of the vector."""
    shared = kept.sparkSession.sparkContext.broadcast(books)
    others = [c for c in kept.columns if c != "embedding"]

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Codebooks = shared.value
        for batch in batches:
            for part_of in blocks(batch, "embedding"):
                codes = np.zeros((part_of.num_rows, own.how.parts), dtype=np.uint8)
                errors = np.zeros(part_of.num_rows, dtype=np.int64)
                for rows, part, _, entry, d in own.assign(_whole(part_of.column("embedding"), own.how.scale)):
                    codes[rows, part] = entry
                    errors[rows] += d
                made = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors)]
                yield pa.RecordBatch.from_arrays(
                    [*(part_of.column(c) for c in others), *made], [*others, "code", "error"]
                )

    kinds = [f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in others]
    return kept.mapInArrow(encode, ", ".join([*kinds, "code binary", "error bigint"]))


def decoded_vectors(coded: DataFrame, books: Codebooks) -> DataFrame:
    """Add `approximate`: the vector that the code stands for, in the scale of the input."""
    shared = coded.sparkSession.sparkContext.broadcast(books.books)
    scale = books.how.scale

    @F.arrow_udf("array<double>")
    def vectors(codes: pa.Array) -> pa.Array:
        own = shared.value
        entries = np.frombuffer(b"".join(codes.to_pylist()), dtype=np.uint8).reshape(-1, len(own))
        parts = own[np.arange(len(own))[None, :], entries]
        width = own.shape[0] * own.shape[2]
        ends = np.arange(0, (len(codes) + 1) * width, width, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(parts.ravel() / scale))

    return coded.withColumn("approximate", vectors(F.col("code")))


def compress_vectors(rows: DataFrame, how: Codes | None = None) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, code, error and label_error of every row whose vector can be coded, and the codebooks.

    `rows` needs vec_id, label and embedding; others are not read. See `kept_vectors` for those left
    out. Repeated rows are coded each for itself; null labels count as one label. An empty
    table, or one of which nothing is kept, gives no rows and no codebooks.
    """
    how = how or Codes()
    if how.entries > 256:
        raise ValueError("an entry is one byte of a code: 256 at most")
    kept = kept_vectors(rows.select("vec_id", "label", "embedding"), how)
    books = learn_codebooks(kept, how)
    kinds = {c: kept.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    if books is None:
        schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code binary, error bigint, label_error bigint"
        return rows.sparkSession.createDataFrame([], schema), None
    coded = pin(encode_vectors(kept, books), "codes")
    # A null label takes part in the join as one of its own.
    keyed = coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = keyed.groupBy("_label").agg(F.sum("error").alias("label_error"))
    salted = keyed.withColumn("_salt", F.pmod(F.xxhash64("code"), F.lit(SALTS)).cast("int"))
    joined = salted_join(salted, sums, ["_label"], SALTS)
    return joined.select("vec_id", "label", "code", "error", "label_error"), books


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(books.digest() if books else hashlib.sha256().hexdigest()).alias("codebooks_sha256"),
    )


OP13_SQL = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (
  SELECT vec_id, label, CAST(p AS INT) AS p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x
  FROM kept, unnest(range(16)) AS t(p)),
book0 AS (
  SELECT p, rank() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c
  FROM cut WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
""" + ",\n".join(
    f"""near{k} AS (
  SELECT vec_id, label, p, x, min([d, e]) AS best FROM (
    SELECT vec_id, label, p, x, e,
      CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM cut JOIN book{k} USING (p)) GROUP BY ALL)"""
    + (
        f""",
book{k + 1} AS (
  SELECT p, e, coalesce(n.c, b.c) AS c FROM book{k} b LEFT JOIN (
    SELECT p, e, list(m ORDER BY i) AS c FROM (
      SELECT p, best[2] AS e, i, CAST(floor(sum(y) / count(*)) AS BIGINT) AS m
      FROM (SELECT p, best, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM near{k}) GROUP BY ALL)
    GROUP BY ALL) n USING (p, e))"""
        if k < 2
        else ""
    )
    for k in range(3)
) + """,
coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', CAST(best[2] AS INT))), '' ORDER BY p) AS code,
    CAST(sum(best[1]) AS BIGINT) AS error FROM near2 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM coded
"""
