"""Product quantisation: compressed vectors, searched by tables, ranked anew by the vectors themselves.

A vector is cut into parts; each part is coded by its nearest codebook entry, one byte a part. A query
makes a table of its distances from all entries of every part, and the distance from a coded vector is
a sum of table entries. The best of these are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lexspan.functions.vectors import l2_squared
from lexspan.operators.arrow import blocks, to_ids, to_matrix
from lexspan.operators.knn import (
    BROADCAST_BYTES,
    DEFAULT_COLUMNS,
    Columns,
    _final,
    _hit_schema,
    query_arrays,
    query_slices,
)
from lexspan.session import pin

# Fixed value: entries that one byte can name.
MOST_ENTRIES = 256

# Codebooks: parts x entries x width of a part.
Codebooks = np.ndarray


def _padded(books: list[np.ndarray]) -> Codebooks:
    """Books of one size; a short one repeats its last entry, which is never chosen before the first."""
    size = max(len(b) for b in books)
    return np.stack([np.concatenate([b, np.repeat(b[-1:], size - len(b), axis=0)]) for b in books])


def _pieces(batches: Iterator[pa.RecordBatch], parts: int, width: int) -> Iterator[list[np.ndarray]]:
    """The vectors of a task, block by block, cut into their parts."""
    for batch in batches:
        for rows in blocks(batch, "v", 1 << 20):
            matrix = to_matrix(rows.column("v"))
            if matrix.shape[1] != parts * width or not np.isfinite(matrix).all():
                raise ValueError("vectors must be finite and of one length")
            yield [np.ascontiguousarray(matrix[:, p * width : (p + 1) * width]) for p in range(parts)]


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of every point, a block of points at a time."""
    squares, step = (centres * centres).sum(axis=1), max(1, (1 << 20) // len(centres))
    found = [(squares - 2.0 * points[at : at + step] @ centres.T).argmin(axis=1) for at in range(0, len(points), step)]
    return np.concatenate(found)


def _apart(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    off = points - centres[_nearest(points, centres)]
    return (off * off).sum(axis=1)


def _drawn(vectors: DataFrame, centres: list[np.ndarray], width: int, most: int, seed: tuple[int, ...]) -> list[np.ndarray]:
    """For every part, so many pieces drawn from all vectors without being put back, by their squared
    distance from the centres. A task keeps the best of its own draws."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    out = pa.schema([("part", pa.int32()), ("key", pa.float64()), ("piece", pa.list_(pa.float64()))])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng([*seed, TaskContext.get().partitionId()])
        best = [(np.zeros(0), np.zeros((0, width))) for _ in shared.value]
        for pieces in _pieces(batches, len(shared.value), width):
            for part, (points, own) in enumerate(zip(pieces, shared.value, strict=True)):
                apart = _apart(points, own)
                there = np.flatnonzero(apart)
                keys = np.r_[best[part][0], random.exponential(size=len(points))[there] / apart[there]]
                points = np.concatenate([best[part][1], points[there]])
                keep = np.argpartition(keys, most - 1)[:most] if len(keys) > most else slice(None)
                best[part] = keys[keep], points[keep]
        for part, (keys, points) in enumerate(best):
            columns = (np.full(len(keys), part), keys, list(points))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    place = F.row_number().over(W.partitionBy("part").orderBy("key"))
    rows = vectors.mapInArrow(draw, "part int, key double, piece array<double>").withColumn("place", place)
    got = rows.where(F.col("place") <= most).orderBy("part", "key").toArrow()
    parts, points = got.column("part").to_numpy(), to_matrix(got.column("piece")).reshape(-1, width)
    return [points[parts == p] for p in range(len(centres))]


def _tallied(vectors: DataFrame, centres: list[np.ndarray], width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every part and centre, how many pieces are nearest to it, and their sum."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    out = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), *[(f"s{i}", pa.float64()) for i in range(width)]])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(own), 1 + width)) for own in shared.value]
        for pieces in _pieces(batches, len(sums), width):
            for points, own, held in zip(pieces, shared.value, sums, strict=True):
                at = _nearest(points, own)
                held[:, 0] += np.bincount(at, minlength=len(own))
                for i in range(width):
                    held[:, 1 + i] += np.bincount(at, weights=points[:, i], minlength=len(own))
        for part, held in enumerate(sums):
            entries = np.flatnonzero(held[:, 0])
            columns = (np.full(len(entries), part), entries, held[entries, 0].astype(np.int64), *held[entries, 1:].T)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    schema = ", ".join(["part int, entry int, n long", *[f"s{i} double" for i in range(width)]])
    added = [F.sum(c).alias(c) for c in out.names[2:]]
    got = vectors.mapInArrow(tally, schema).groupBy("part", "entry").agg(*added).toArrow()
    parts, entries = got.column("part").to_numpy(), got.column("entry").to_numpy()
    numbers = np.stack([got.column(c).to_numpy().astype(np.float64) for c in out.names[2:]], axis=1)
    made = []
    for part, own in enumerate(centres):
        held = np.zeros((len(own), 1 + width))
        held[entries[parts == part]] = numbers[parts == part]
        made.append((held[:, 0], held[:, 1:]))
    return made


def _moved(centres: np.ndarray, n: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Every centre in the middle of its points; one without points stays."""
    return np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)


def _chosen(points: np.ndarray, weights: np.ndarray, entries: int, random: np.random.Generator) -> np.ndarray:
    """At most so many centres of weighted points: each drawn by its distance from those before, then moved."""
    at = [random.choice(len(points), p=weights / weights.sum())]
    apart = ((points - points[at[0]]) ** 2).sum(axis=1)
    while len(at) < entries and (chance := weights * apart).sum() > 0:
        at.append(random.choice(len(points), p=chance / chance.sum()))
        apart = np.minimum(apart, ((points - points[at[-1]]) ** 2).sum(axis=1))
    centres = points[at]
    for _ in range(30):
        own = _nearest(points, centres)
        sums = np.stack([np.bincount(own, weights * points[:, i], len(centres)) for i in range(points.shape[1])], axis=1)
        before, centres = centres, _moved(centres, np.bincount(own, weights, len(centres)), sums)
        if np.array_equal(before, centres):
            break
    return centres


def train_codebooks(
    index: DataFrame,
    parts: int = 8,
    entries: int = MOST_ENTRIES,
    vector_col: str = "embedding",
    one_in: int = 1,
    rounds: int = 10,
    seed: int = 42,
) -> Codebooks:
    """Codebooks learnt by k-means for every part, from all vectors or one in so many by a hash.

    All parts learn in the same passes over the written vectors; between them only the centres are held.
    Centres start from pieces drawn by their distance (k-means||, two draws of twice the entries). Eager.
    """
    if not 0 < entries <= MOST_ENTRIES:
        raise ValueError(f"entries must be 1 to {MOST_ENTRIES}")
    if one_in > 1:
        index = index.where(F.pmod(F.xxhash64(vector_col, F.lit(seed)), F.lit(one_in)) == 0)
    vectors = pin(index.select(F.col(vector_col).alias("v")), "training")
    row = vectors.first()
    if row is None or len(row.v) % parts:
        raise ValueError(f"vectors must be there and fall into {parts} equal parts")
    width = len(row.v) // parts
    centres = list(np.array(row.v, dtype=np.float64).reshape(parts, 1, width))
    for step in range(2 if entries > 1 else 0):
        more = _drawn(vectors, centres, width, 2 * entries, (seed, step))
        centres = [np.unique(np.concatenate(both), axis=0) for both in zip(centres, more, strict=True)]
    if entries > 1:
        shares = _tallied(vectors, centres, width)
        random = [np.random.default_rng([seed, 2, part]) for part in range(parts)]
        centres = [_chosen(c, n, entries, r) for c, (n, _), r in zip(centres, shares, random, strict=True)]
    for _ in range(rounds):
        before = centres
        centres = [_moved(c, *held) for c, held in zip(before, _tallied(vectors, before, width), strict=True)]
        # As little as this is no change.
        if all((((a - b) ** 2).sum(axis=1) <= 1e-8).all() for a, b in zip(before, centres, strict=True)):
            break
    return _padded(centres)


def nearest_entries(matrix: np.ndarray, books: Codebooks) -> np.ndarray:
    """For every row and part, the nearest entry; of equal ones the lowest."""
    parts, _, width = books.shape
    out = np.empty((len(matrix), parts), dtype=np.uint8)
    for part, book in enumerate(books):
        apart = matrix[:, None, part * width : (part + 1) * width] - book[None, :, :]
        out[:, part] = (apart * apart).sum(axis=2).argmin(axis=1)
    return out


def encode(index: DataFrame, books: Codebooks, vector_col: str = "embedding") -> DataFrame:
    """Add the `code` of each vector: one byte for every part."""
    shared = index.sparkSession.sparkContext.broadcast(books)
    step = max(1, (1 << 20) // (books.shape[1] * books.shape[2]))

    @F.arrow_udf("binary")
    def codes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            matrix = to_matrix(vectors)
            made = [nearest_entries(matrix[at : at + step], shared.value) for at in range(0, len(matrix), step)]
            yield pa.array([row.tobytes() for part in made for row in part], pa.binary())

    return index.withColumn("code", codes(F.col(vector_col)))


def _entries(codes: pa.Array, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), dtype=np.uint8).reshape(-1, parts)


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """Add `approximate`, the vector that the code stands for."""
    shared = coded.sparkSession.sparkContext.broadcast(books)

    @F.arrow_udf("array<double>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        width = own.shape[0] * own.shape[2]
        for codes in batches:
            found = own[np.arange(len(own))[None, :], _entries(codes, len(own))].reshape(-1, width)
            ends = np.arange(0, (len(found) + 1) * width, width, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))

    return coded.withColumn("approximate", vectors(F.col("code")))


class _BestCoded:
    """The best coded rows per query seen so far in a task."""

    def __init__(self, tables: np.ndarray, most: int) -> None:
        self.tables, self.most = tables, most  # queries x parts x entries
        self.d = np.full((len(tables), 0), np.inf)
        self.ids: np.ndarray | None = None

    def add(self, ids: np.ndarray, entries: np.ndarray) -> None:
        d = np.zeros((len(self.tables), len(ids)))
        for part in range(entries.shape[1]):
            d += self.tables[:, part, :][:, entries[:, part]]
        own = np.broadcast_to(ids, d.shape)
        d = np.concatenate([self.d, d], axis=1)
        own = own if self.ids is None else np.concatenate([self.ids, own], axis=1)
        if d.shape[1] > self.most:
            keep = np.argpartition(d, self.most - 1, axis=1)[:, : self.most]
            d, own = np.take_along_axis(d, keep, axis=1), np.take_along_axis(own, keep, axis=1)
        self.d, self.ids = d, own


def knn_compressed(
    coded: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    books: Codebooks,
    k: int = 5,
    rerank: int = 20,
    columns: Columns = DEFAULT_COLUMNS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """About the `k` nearest rows (squared L2) of every query: query_id, index_id, distance, rank.

    `coded` has the ids and codes that are scanned, `vectors` the ids and vectors, of which only those
    of the `rerank * k` best codes of a query are compared. Eager: a slice's candidates are written before
    the next one is sent.
    """
    most = rerank * k
    scanned = coded.select(F.col(columns.index_id).alias("index_id"), "code")
    schema = _hit_schema(vectors, queries, columns)
    out = to_arrow_schema(schema)
    parts, entries, width = books.shape
    # Tables of a slice: a number for every part and entry of a query.
    per_query = 8 * parts * entries
    limit = 2 * 8 * parts * width * max(1, broadcast_bytes // (8 * per_query))
    found = []
    for sent in query_slices(queries, columns, min(broadcast_bytes, limit)):
        ids, matrix = query_arrays(sent)
        if not len(ids):
            continue
        apart = matrix.reshape(len(ids), parts, 1, width) - books[None]
        shared = coded.sparkSession.sparkContext.broadcast((ids, (apart * apart).sum(axis=3)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            query_ids, tables = shared.value
            best = _BestCoded(tables, most)
            step = max(1, (1 << 20) // len(tables))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    some = batch.slice(at, step)
                    best.add(to_ids(some.column("index_id")), _entries(some.column("code"), parts))
            if best.ids is not None:
                made = (np.repeat(query_ids, best.d.shape[1]), best.ids.ravel(), best.d.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, out, strict=True)], schema=out)

        found.append(pin(_final(scanned.mapInArrow(search, schema), most).select("query_id", "index_id"), "candidates"))
        shared.unpersist()
    if not found:
        return queries.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
    candidates = reduce(DataFrame.unionByName, found)
    exact = (
        candidates.join(vectors.select(F.col(columns.index_id).alias("index_id"), F.col(columns.index_vector).alias("v")), "index_id")
        .join(queries.select(F.col(columns.query_id).alias("query_id"), F.col(columns.query_vector).alias("q")), "query_id")
        .select("query_id", "index_id", l2_squared(F.col("q"), F.col("v")).alias("distance"))
    )
    return _final(exact, k)
