"""Exact nearest neighbours over a cell index, without reading all of it.

Every cell has a centre and a radius. A query first searches the nearest cells that together hold `k`
rows; its k-th distance then rules out, by the triangle inequality, each cell whose nearest possible
row is farther. Only what is left is searched in a second pass, so the result equals a full search.

Queries are worked off slice by slice: a slice's results are written before the next one is sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.operators.ann import PROBE_CELLS, search_cells
from lexspan.operators.arrow import blocks, to_matrix
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

# More than rounding takes from a distance or a radius, relative to the numbers it is made of.
_SLACK = 1e-9


@dataclass(frozen=True)
class CellBounds:
    """By cell number: centre, distance of the farthest row, and number of rows."""

    centres: np.ndarray
    radii: np.ndarray
    rows: np.ndarray

    def distances(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From rows to centres: about the distance, and no more than the distance."""
        scale = (matrix * matrix).sum(axis=1)[:, None] + (self.centres * self.centres).sum(axis=1)[None, :]
        square = scale - 2.0 * matrix @ self.centres.T
        return np.sqrt(np.maximum(square, 0.0)), np.sqrt(np.maximum(square - _SLACK * (scale + 1.0), 0.0))


def cell_bounds(index: DataFrame, centres: np.ndarray, vector_col: str = "embedding") -> CellBounds:
    """Radius and size of every cell of an index with `cell`: one row per cell comes back."""
    shared = index.sparkSession.sparkContext.broadcast(centres)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radii, rows = np.zeros(len(shared.value)), np.zeros(len(shared.value), dtype=np.int64)
        for batch in batches:
            for part in blocks(batch, "vector"):
                cell = part.column("cell").to_numpy(zero_copy_only=False)
                apart = to_matrix(part.column("vector")) - shared.value[cell]
                np.maximum.at(radii, cell, np.sqrt((apart * apart).sum(axis=1)))
                rows += np.bincount(cell, minlength=len(rows))
        met = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met.astype(np.int32)), pa.array(radii[met]), pa.array(rows[met])], ["cell", "radius", "n"]
        )

    by_task = index.select("cell", F.col(vector_col).alias("vector")).mapInArrow(measure, "cell int, radius double, n long")
    found = by_task.groupBy("cell").agg(F.max("radius").alias("radius"), F.sum("n").alias("n")).toArrow()
    radii, rows = np.zeros(len(centres)), np.zeros(len(centres), dtype=np.int64)
    cell = found.column("cell").to_numpy()
    radii[cell], rows[cell] = found.column("radius").to_numpy(), found.column("n").to_numpy()
    return CellBounds(centres, radii * (1 + _SLACK), rows)


def _asking(wanted: np.ndarray) -> dict[int, np.ndarray]:
    """From a matrix of queries and cells, the queries of each cell that any asks for."""
    return {int(c): np.flatnonzero(wanted[:, c]) for c in np.flatnonzero(wanted.any(axis=0))}


@dataclass(frozen=True)
class PrunedSearch:
    """`hits`: query_id, index_id, distance, rank. `report`: by query_id, the cells and rows compared."""

    hits: DataFrame
    report: DataFrame


def knn_pruned(
    index: DataFrame,
    queries: DataFrame,
    centres: np.ndarray,
    k: int = 5,
    columns: Columns = DEFAULT_COLUMNS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> PrunedSearch:
    """The `k` nearest rows (squared L2) of every query, equal to a full search, ties included.

    `index` carries `cell`, the nearest of `centres`; query ids must be unique. Eager: the searches
    run here, and their results are written.
    """
    bounds = cell_bounds(index, centres, columns.index_vector)
    vectors = index.select(
        F.col(columns.index_id).alias("index_id"), F.col(columns.index_vector).alias("vector"), "cell"
    )
    schema = _hit_schema(index, queries, columns)
    spark = index.sparkSession
    # Distances to all centres are held for a slice.
    per_slice = 2 * 8 * centres.shape[1] * max(1, PROBE_CELLS // len(centres))
    hits, reports = [], []
    for part in query_slices(queries, columns, min(broadcast_bytes, per_slice)):
        ids, matrix = query_arrays(part)
        matrix = matrix.reshape(len(ids), centres.shape[1])
        apart, at_least = bounds.distances(matrix)
        near = np.argsort(np.where(bounds.rows > 0, apart, np.inf), axis=1, kind="stable")
        before = np.cumsum(bounds.rows[near], axis=1) - bounds.rows[near]
        first = np.zeros(apart.shape, dtype=bool)
        np.put_along_axis(first, near, (before < k) & (bounds.rows[near] > 0), axis=1)

        def search(wanted: np.ndarray, ids=ids, matrix=matrix) -> DataFrame:
            return search_cells(vectors, schema, ids, matrix, _asking(wanted), len(centres), k)

        held = pin(_final(search(first), k).drop("rank"), "near-cells")
        # One number for every query of the slice.
        limits = held.groupBy("query_id").agg(F.max("distance").alias("d"), F.count(F.lit(1)).alias("n")).toArrow()
        known = dict(zip(limits.column("query_id").to_pylist(), zip(*(limits.column(c).to_pylist() for c in "dn")), strict=True))
        limit = np.array([known[i][0] if i in known and known[i][1] == k else np.inf for i in ids.tolist()])
        least = np.maximum(at_least - bounds.radii, 0.0)
        second = (least * least <= (limit * (1 + _SLACK))[:, None]) & ~first & (bounds.rows > 0)
        found = held.unionByName(search(second)) if second.any() else held
        hits.append(pin(_final(found, k), "hits"))
        searched = first | second
        made = pa.table(
            {
                "query_id": part.column("query_id"),
                "cells": pa.array(searched.sum(axis=1)),
                "rows": pa.array(searched @ bounds.rows),
            }
        )
        reports.append(pin(spark.createDataFrame(made), "report"))
    return PrunedSearch(reduce(DataFrame.unionByName, hits), reduce(DataFrame.unionByName, reports))
