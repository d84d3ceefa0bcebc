"""Vector codes against a full comparison with every entry."""

import hashlib
import math
import random

import numpy as np

from lexspan.llm.codes import Codes, Grid, compress_vectors, decoded_vectors, op13_vector_codes

ROWS = "vec_id long, label int, embedding array<float>, code string, error string, _salt string"


def brute(rows, parts=16, entries=64, rounds=2):
    kept = []
    for vec_id, label, vector in rows:
        if vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((vec_id, label, [math.floor(256 * x) for x in vector]))
    if not kept:
        return []
    width = len(kept[0][2]) // parts
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for _, _, v in kept:
                own.setdefault(nearest(cut(v, p), book)[1], []).append(cut(v, p))
            books[p] = [
                [sum(col) // len(own[e]) for col in zip(*own[e], strict=True)] if e in own else c for e, c in enumerate(book)
            ]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    coded = []
    for vec_id, label, v in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        coded.append((vec_id, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    sums = {}
    for _, label, _, error in coded:
        sums[label] = sums.get(label, 0) + error
    return [(i, code, error, sums[label], digest) for i, label, code, error in coded]


def as_floats(rows):
    return [(i, lab, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, lab, v in rows]


def coded(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    spark.createDataFrame([(*r, "a", "b", "c") for r in rows], ROWS).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return sorted(map(tuple, op13_vector_codes(spark, path).collect()), key=repr)


def test_grid_equals_full_comparison():
    rng = np.random.default_rng(3)
    for spread, n in ((3, 64), (40, 64), (2000, 17), (40, 1)):
        book = rng.integers(-spread, spread + 1, (n, 4))
        x = rng.integers(-2 * spread, 2 * spread + 1, (3000, 4))  # small spreads are full of ties
        for limit in (1 << 16, 5):
            grid = Grid(book, limit)
            for _ in range(2):
                entry, least = grid.assign(x)
                d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
                assert (entry == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()


def test_edges(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, 1, None]), [rng.gauss(0, 0.2) for _ in range(32)]) for i in range(150)]
    rows += [(i, 5, [float(rng.randrange(-2, 3))] * 32) for i in range(200, 260)]  # ties all over
    rows += [rows[3], rows[3], rows[80], (None, None, rows[7][2]), (None, 4, [1.5] * 32)]
    rows += [(-1, 1, None), (-2, 1, [None] * 32), (-3, 1, [float("nan")] * 32), (-4, 1, [0.0] * 31 + [float("-inf")])]
    rows = as_floats(rows)
    assert coded(spark, tmp_path, rows) == sorted(brute(rows), key=repr)


def test_few_rows_and_none(spark, tmp_path):
    rows = as_floats([(9, None, [0.1] * 16), (4, 2, [-0.1] * 16)])
    assert coded(spark, tmp_path / "a", rows) == sorted(brute(rows), key=repr)
    assert coded(spark, tmp_path / "b", [(1, 1, None)]) == []
    assert coded(spark, tmp_path / "c", []) == []


def test_vectors_of_other_lengths_and_beyond_range_are_left_out(spark):
    rows = [(1, 0, [0.5] * 32), (2, 0, [0.5] * 16), (3, 0, [0.5] * 31), (4, 0, []), (5, 0, [1e30] * 32), (6, 0, [0.25] * 32)]
    frame = spark.createDataFrame([(*r, "", "", "") for r in rows], ROWS)
    assert sorted(r.vec_id for r in compress_vectors(frame)[0].collect()) == [1, 6]


def test_decoded_vectors_and_other_parameters(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, rng.normal(0, 0.2, 24).tolist(), "", "", "") for i in range(400)]
    frame = spark.createDataFrame(rows, ROWS)
    rough, fine = (compress_vectors(frame, how) for how in (Codes(parts=4, entries=8), Codes(parts=12, entries=200)))
    off = []
    for made, books in (rough, fine):
        known = {r[0]: np.floor(256 * np.array(r[2], dtype=np.float32)) for r in rows}
        total = 0
        for r in decoded_vectors(made, books).collect():
            error = ((known[r.vec_id] - 256 * np.array(r.approximate)) ** 2).sum()
            assert error == r.error
            total += error
        off.append(total)
    assert off[1] < off[0] / 4


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    assert sorted(map(tuple, op13_vector_codes(spark, sf).collect())) == sorted(brute(rows))
