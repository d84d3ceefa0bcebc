"""Requests against the plain rule: documents gather until there are enough chunks."""

import random

import pytest

from lexspan.plans.indexing import request_batches


def plain(sizes, size):
    out, request, held = [], 0, 0
    for ordinal, n in enumerate(sizes):
        if held >= size:
            request, held = request + 1, 0
        held += n
        out += [(ordinal, request)] * n
    return out


def chunks(spark, sizes):
    rows, index_id = [], 100  # the first id need not be zero
    for ordinal, n in enumerate(sizes):
        for i in range(n):
            rows.append((index_id, ordinal, i))
            index_id += 1
    return spark.createDataFrame(rows, "index_id long, doc_ordinal long, chunk_idx int").repartition(3)


@pytest.mark.parametrize("case", range(7))
def test_requests(spark, case):
    rng = random.Random(case)
    size = 800 if case == 0 else rng.choice([1, 3, 10])
    sizes = {0: [790, 20, 790, 10], 1: [1], 2: [5] * 40, 3: [1000, 1, 1, 3000]}.get(
        case, [rng.choice([1, 1, 2, 7, 40]) for _ in range(rng.randrange(1, 120))]
    )
    made = request_batches(chunks(spark, sizes), size)
    assert sorted((r.doc_ordinal, r.request_id) for r in made.collect()) == plain(sizes, size)


def test_no_documents(spark):
    assert request_batches(chunks(spark, [1]).limit(0)).count() == 0
