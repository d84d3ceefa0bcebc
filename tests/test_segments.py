"""Index segments against a rebuilt index, and changes that fail."""

import random

import pytest
from pyspark.sql import functions as F

from lexspan.plans.segments import SegmentedIndex

ROWS = "index_id long, text string"


def rows(index):
    return sorted(map(tuple, index.read().collect()))


def test_any_mix_of_changes_equals_a_rebuild(spark, tmp_path):
    rng = random.Random(2)
    index, known = SegmentedIndex(spark, str(tmp_path / "ix")), {}
    for step in range(14):
        kind = rng.choice(["append", "append", "remove", "replace", "merge", "merge small", "vacuum"]) if step else "append"
        if kind == "append":
            made = {10 * step + i: f"a{step}" for i in range(rng.randrange(1, 9))} | {next(iter(known), 999): "again"}
            made = {i: t for i, t in made.items() if i not in known}
            index.append(spark.createDataFrame(list(made.items()), ROWS))
            known |= made
        elif kind == "remove":
            gone = rng.sample(sorted(known), len(known) // 3) + [10**9]
            index.remove(spark.createDataFrame([(i,) for i in gone], "index_id long"))
            known = {i: t for i, t in known.items() if i not in gone}
        elif kind == "replace":
            made = {i: f"r{step}" for i in rng.sample(sorted(known), len(known) // 2)} | {10**6 + step: "new"}
            index.replace(spark.createDataFrame(list(made.items()), ROWS))
            known |= made
        elif kind == "vacuum":
            index.vacuum()
        else:
            index.merge(5 if kind == "merge small" else None)
        assert rows(index) == sorted(known.items()), (step, kind)
    index.merge()
    held = index.manifest()
    assert len(held.segments) == 1 and not held.removals


def test_a_failed_change_leaves_the_index(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "ix"))
    index.append(spark.createDataFrame([(1, "a"), (2, "b")], ROWS))
    before = index.manifest()
    broken = spark.createDataFrame([(3, "c")], ROWS).withColumn("text", F.raise_error(F.lit("no model")).cast("string"))
    for change in (index.append, index.replace):
        with pytest.raises(Exception, match="no model"):
            change(broken)
    assert index.manifest() == before and rows(index) == [(1, "a"), (2, "b")]
    # Somebody else made the next change meanwhile.
    other = SegmentedIndex(spark, str(tmp_path / "ix"))
    other.manifest = lambda: before
    index.remove(spark.createDataFrame([(1,)], "index_id long"))
    with pytest.raises(RuntimeError, match="changed meanwhile"):
        other.append(spark.createDataFrame([(4, "d")], ROWS))
    assert rows(index) == [(2, "b")]


def test_nothing_there(spark, tmp_path):
    with pytest.raises(ValueError, match="nothing"):
        SegmentedIndex(spark, str(tmp_path / "none")).read()
