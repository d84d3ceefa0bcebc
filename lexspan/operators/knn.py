"""Nearest neighbours by squared L2 or cosine distance.

Scores are computed as matrix products inside tasks; a task keeps `k` rows per query,
so what is moved is small. Ties are broken by id, and fewer than `k` vectors give
fewer rows.

Queries go to the tasks, in slices of bounded size, and the index is read in place, once for
each slice. One ranking over all slices follows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexspan.functions.vectors import NORM_FLOOR, cosine, l2_squared
from lexspan.operators.arrow import blocks, to_ids, to_matrix
from lexspan.session import pin

L2 = "l2"
COSINE = "cosine"

# Query vectors of a slice that are sent to the tasks at a time.
BROADCAST_BYTES = 64 * 1024 * 1024
# A lookup of up to this many hits also filters the scan by their ids.
FILTER_IDS = 10_000
# Queries scored at a time, and pairs compared exactly at a time, within a task.
SCORE_ROWS = 256
EXACT_PAIRS = 65_536


@dataclass(frozen=True)
class Columns:
    """Names used by the index and the query table."""

    index_id: str = "index_id"
    index_vector: str = "embedding"
    query_id: str = "query_id"
    query_vector: str = "embedding"


DEFAULT_COLUMNS = Columns()


def distance(a: Column, b: Column, metric: str = L2) -> Column:
    if metric == L2:
        return l2_squared(a, b)
    if metric == COSINE:
        return F.lit(1.0) - cosine(a, b)
    raise ValueError(f"metric must be {L2} or {COSINE}, not {metric!r}")


class _Best:
    """The best `k` rows per query seen so far in a task, in arrays of fixed size."""

    def __init__(self, queries: np.ndarray, k: int, metric: str) -> None:
        self.queries, self.k, self.metric = queries, k, metric
        self.kth = np.full(len(queries), np.inf)
        self.held = np.zeros(len(queries), dtype=np.int64)
        self.distances = np.full((len(queries), k), np.inf)
        self.ids: np.ndarray | None = None
        self._squares = (queries * queries).sum(axis=1)

    def _approximate(self, rows: np.ndarray, x: np.ndarray, xx: np.ndarray):
        """Distances by matrix product, and a bound on their rounding error."""
        product = self.queries[rows] @ x.T
        if self.metric == L2:
            scale = self._squares[rows][:, None] + xx[None, :]
            return scale - 2.0 * product, 1e-10 * (scale.max(initial=0.0) + 1.0)
        norms = np.sqrt(self._squares[rows])[:, None] * np.sqrt(xx)[None, :]
        return 1.0 - product / np.maximum(norms, NORM_FLOOR), 1e-10

    def _exact(self, qi: np.ndarray, xi: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(qi))
        for lo in range(0, len(qi), EXACT_PAIRS):
            part = slice(lo, lo + EXACT_PAIRS)
            a, b = self.queries[qi[part]], x[xi[part]]
            if self.metric == L2:
                out[part] = ((a - b) * (a - b)).sum(axis=1)
            else:
                norms = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
                out[part] = 1.0 - (a * b).sum(axis=1) / np.maximum(norms, NORM_FLOOR)
        return out

    def add(self, ids: np.ndarray, x: np.ndarray, only: np.ndarray | None = None) -> None:
        """Compare a batch with all queries, or with the rows `only` of them."""
        wanted = np.arange(len(self.queries)) if only is None else only
        if not len(ids) or not len(wanted):
            return
        if x.shape[1] != self.queries.shape[1]:
            raise ValueError(f"queries have {self.queries.shape[1]} dimensions, vectors {x.shape[1]}")
        xx = (x * x).sum(axis=1)
        top = min(self.k, len(ids)) - 1
        for lo in range(0, len(wanted), SCORE_ROWS):
            rows = wanted[lo : lo + SCORE_ROWS]
            d, slack = self._approximate(rows, x, xx)
            # A full batch cannot push out more than its own k best per query. Every
            # row within rounding of the limit stays, and is compared exactly below.
            limit = self.kth[rows]
            if len(ids) >= self.k:
                limit = np.minimum(limit, np.partition(d, top, axis=1)[:, top])
            qi, xi = np.nonzero(d <= (limit + slack)[:, None])
            if len(qi):
                self._merge(rows[qi], self._exact(rows[qi], xi, x), ids[xi])

    def _merge(self, qi: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        """Put candidates in their place; only the queries they belong to are touched."""
        if self.ids is None:
            kind = ids.dtype if ids.dtype.kind in "iu" else object
            self.ids = np.zeros((len(self.queries), self.k), dtype=kind)
        touched = np.unique(qi)
        old = np.arange(self.k)[None, :] < self.held[touched, None]
        qi = np.concatenate([np.repeat(touched, self.held[touched]), qi])
        d = np.concatenate([self.distances[touched][old], d])
        before = self.ids[touched][old]
        ids = np.concatenate([before.astype(str) if before.dtype == object else before, ids])
        order = np.lexsort((ids, d, qi))
        qi, d, ids = qi[order], d[order], ids[order]
        starts = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
        sizes = np.diff(np.r_[starts, len(qi)])
        place = np.arange(len(qi)) - np.repeat(starts, sizes)
        keep = place < self.k
        self.distances[qi[keep], place[keep]] = d[keep]
        self.ids[qi[keep], place[keep]] = ids[keep]
        self.held[touched] = np.minimum(sizes, self.k)
        last = place == self.k - 1
        self.kth[qi[last]] = d[last]

    def table(self, query_ids: np.ndarray, schema: pa.Schema) -> pa.Table:
        if self.ids is None:
            return schema.empty_table()
        there = np.arange(self.k)[None, :] < self.held[:, None]
        qi = np.repeat(np.arange(len(self.queries)), self.held)
        columns = (query_ids[qi], self.ids[there], self.distances[there])
        return pa.table(
            [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )


def _final(partial: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("distance", "index_id")
    placed = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return placed.withColumn("rank", F.col("rank") - 1)


def _hit_schema(index: DataFrame, queries: DataFrame, columns: Columns) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema[columns.query_id].dataType),
            T.StructField("index_id", index.schema[columns.index_id].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def query_slices(
    queries: DataFrame, columns: Columns, limit_bytes: int = BROADCAST_BYTES
) -> Iterator[pa.Table]:
    """The query table in slices whose vectors have about half of `limit_bytes` each.

    The queries are written once before, as a model may be behind them. Slices are cut by a
    hash of the id and number, so that their sizes are even.
    """
    table = pin(
        queries.select(
            F.col(columns.query_id).alias("query_id"),
            F.col(columns.query_vector).alias("vector"),
            F.monotonically_increasing_id().alias("number"),
        ),
        "queries",
    )
    size, width = table.agg(F.count(F.lit(1)), F.max(F.array_size("vector"))).first()
    most = max(limit_bytes // (2 * 8 * max(width or 1, 1)), 1)
    slices = max(1, -(-size // most))
    own = F.pmod(F.xxhash64("query_id", "number"), F.lit(slices))
    for at in range(slices):
        part = table if slices == 1 else table.where(own == at)
        yield part.select("query_id", "vector").toArrow()


def query_arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the matrix of a query table."""
    return to_ids(table.column("query_id")), to_matrix(table.column("vector"))


def knn_batch(
    index: DataFrame,
    queries: DataFrame,
    k: int = 5,
    metric: str = L2,
    columns: Columns = DEFAULT_COLUMNS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The `k` nearest index rows of every query.

    Returns `query_id, index_id, distance, rank` with ranks from zero.
    """
    vectors = index.select(
        F.col(columns.index_id).alias("index_id"), F.col(columns.index_vector).alias("vector")
    )
    schema = _hit_schema(index, queries, columns)
    context = index.sparkSession.sparkContext
    out = to_arrow_schema(schema)

    def search_for(part: pa.Table) -> DataFrame:
        shared = context.broadcast(query_arrays(part))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, matrix = shared.value
            best = _Best(matrix, k, metric)
            for batch in batches:
                for rows in blocks(batch, "vector"):
                    best.add(to_ids(rows.column("index_id")), to_matrix(rows.column("vector")))
            yield from best.table(query_ids, out).to_batches()

        return vectors.mapInArrow(search, schema)

    parts = map(search_for, query_slices(queries, columns, broadcast_bytes))
    return _final(reduce(DataFrame.unionByName, parts), k)


def knn_exact(
    index: DataFrame,
    query: list[float],
    k: int = 5,
    metric: str = L2,
    columns: Columns = DEFAULT_COLUMNS,
) -> DataFrame:
    """The `k` rows of `index` nearest to one vector, with `distance` and `rank`."""
    spark = index.sparkSession
    one = spark.createDataFrame([(0, [float(x) for x in query])], "query_id int, embedding array<double>")
    asked = Columns(columns.index_id, columns.index_vector)
    hits = knn_batch(index, one, k, metric, asked).drop("query_id")
    return lookup_ranked(hits, index, columns.index_id)


def _with_few_hits(
    hits: DataFrame, table: DataFrame, index_id: str
) -> tuple[DataFrame, DataFrame]:
    """The hits under the table's id name, and the table to join them with.

    The hits are written once, so that the search behind them runs once. Where they are few, their
    ids are also given to the scan, so that row groups without a hit are skipped.
    """
    held = pin(hits.withColumnRenamed("index_id", index_id), "hits")
    ids = held.select(index_id).distinct().limit(FILTER_IDS + 1).toArrow().column(0).to_pylist()
    return held, table.where(F.col(index_id).isin(ids)) if len(ids) <= FILTER_IDS else table


def lookup_ranked(hits: DataFrame, table: DataFrame, index_id: str = "index_id") -> DataFrame:
    """The rows of `table` behind the hits, with query, rank and distance."""
    few, rows = _with_few_hits(hits, table, index_id)
    return rows.join(few, index_id)


def lookup_filter(hits: DataFrame, table: DataFrame, index_id: str = "index_id") -> DataFrame:
    """The rows of `table` that any query hit, without ranks."""
    few, rows = _with_few_hits(hits.select("index_id"), table, index_id)
    return rows.join(few, index_id, "left_semi")
