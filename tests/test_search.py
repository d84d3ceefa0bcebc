"""Pruned and graph search against a full comparison."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspan.functions.vectors import l2_squared
from lexspan.operators import ann, knn
from lexspan.operators import graph as graph_module
from lexspan.operators.graph import build_graph, knn_graph
from lexspan.operators.pruned import knn_pruned
from lexspan.session import pin, scratch_scope, shared_dir

ROWS = "index_id long, embedding array<float>"


def clustered(rng, n, dim=8, spread=0.3):
    centres = rng.normal(0, 3, (12, dim))
    return centres[rng.integers(0, 12, n)] + rng.normal(0, spread, (n, dim))


def index_of(spark, x):
    return spark.createDataFrame([(int(i), v.astype("float32").tolist()) for i, v in enumerate(x)], ROWS)


def asked_of(spark, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "query_id long, embedding array<double>")


def found(hits):
    return sorted((r.query_id, r.rank, r.index_id, round(r.distance, 6)) for r in hits.collect())


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = clustered(rng, 1500)
    x[::3] = x[0]  # a third of all rows is one vector
    return index_of(spark, x).repartition(6).cache(), asked_of(spark, np.concatenate([clustered(rng, 20), x[:3]]))


def test_pruned_equals_full_search(spark, data):
    index, queries = data
    centres = ann.train_centres(index, cells=24)
    cells = ann.assign_cells(index, centres).cache()
    for k, sent in ((1, 1 << 20), (7, 1 << 10), (600, 1 << 20)):
        search = knn_pruned(cells, queries, centres, k, broadcast_bytes=sent)
        assert found(search.hits) == found(knn.knn_batch(index, queries, k))
        report = search.report.collect()
        assert len(report) == 23 and all(r.rows <= 1500 for r in report)
    few = knn_pruned(cells, queries, centres, 3).report.collect()
    assert sum(r.cells for r in few) < 0.5 * 24 * 23


def test_pruned_with_fewer_rows_than_k_and_empty_cells(spark):
    index = index_of(spark, np.array([[0.0, 0.0], [1.0, 1.0], [1.0, 1.0]]))
    centres = np.array([[0.0, 0.0], [50.0, 50.0], [1.0, 1.0]])
    cells = ann.assign_cells(index, centres)
    got = knn_pruned(cells, asked_of(spark, np.array([[0.9, 0.9]])), centres, 5)
    assert [(i, r) for _, r, i, _ in found(got.hits)] == [(1, 0), (2, 1), (0, 2)]
    assert got.report.first().cells == 2


def test_graph_recall_and_rows_read(spark, data):
    index, queries = data
    graph = build_graph(index, degree=8, rounds=6)
    assert graph.nodes.count() == 1001
    assert graph.edges.groupBy("a").count().agg({"count": "max"}).first()[0] <= 16
    search = knn_graph(graph, queries, k=5, beam=24)
    exact = knn.knn_batch(index, queries, 5)
    assert ann.recall(search.hits, exact).first().recall >= 0.95
    assert max(r.rows for r in search.report.collect()) < 1001
    # The vector that a third of the rows share comes with its least ids.
    assert [i for q, _, i, _ in found(search.hits) if q == 20] == [0, 3, 6, 9, 12]


def test_graph_of_few_rows(spark):
    index = index_of(spark, np.array([[0.0, 0.0], [1.0, 1.0], [1.0, 1.0]]))
    got = knn_graph(build_graph(index), asked_of(spark, np.array([[0.9, 0.9]])), k=5)
    assert [(i, r) for _, r, i, _ in found(got.hits)] == [(1, 0), (2, 1), (0, 2)]
    with pytest.raises(ValueError, match="beam"):
        knn_graph(build_graph(index), asked_of(spark, np.zeros((1, 2))), k=50)


def test_graph_is_the_same_by_cells_and_slices_and_shuffles_few_vectors(spark, data):
    index, _ = data
    whole = {(r.a, r.b) for r in build_graph(index, degree=4, rounds=2, least_change=0.0).edges.collect()}
    cut = build_graph(index, degree=4, rounds=2, least_change=0.0, cell_nodes=100, slice_nodes=400)
    assert {(r.a, r.b) for r in cut.edges.collect()} == whole
    # A cell asks for a vector once, not once for every node that has it as a neighbour.
    nodes = pin(cut.nodes, "nodes")
    edges = cut.edges.join(nodes.select(F.col("id").alias("a"), F.col("vector").alias("x")), "a").join(
        nodes.select(F.col("id").alias("b"), F.col("vector").alias("y")), "b"
    )
    edges = pin(edges.select("a", "b", l2_squared(F.col("x"), F.col("y")).alias("d"), F.lit(True).alias("new")), "edges")
    cells = pin(graph_module._cells(nodes, 1001, 250), "cells")
    assert cells.count() == 1001 and cells.groupBy("cell").count().agg(F.max("count")).first()[0] <= 400
    for found in graph_module._descend(edges, nodes, cells, 4, 1):
        once = found.groupBy("a", "b").count().agg(F.max("count")).first()[0]
        assert once is None or once <= cells.select("cell").distinct().count()


def test_rounds_of_a_graph_leave_only_the_last(spark, data):
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = {*shared.glob("graph-*")}
    with scratch_scope(spark):
        build_graph(data[0], degree=4, rounds=3, least_change=0.0)
        assert len({*shared.glob("graph-*")} - before) == 1
