import pytest

from lexspan.session import pin, scratch_path, scratch_scope, shared_dir, spread


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master, conf=None, folder=None):
        self.sparkContext, self.conf = Context(master, folder), conf or {}


def test_the_named_folder_is_used():
    session = Session("spark://host:7077", {"spark.checkpoint.dir": "hdfs:///shared"})
    assert shared_dir(session) == "hdfs:///shared" == session.sparkContext.folder
    assert shared_dir(Session("yarn", folder="hdfs:///set")) == "hdfs:///set"


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session("spark://host:7077"))


def test_pinned_rows_do_not_change(spark):
    from pyspark.sql import functions as F

    fixed = pin(spark.range(100).select("id", F.rand().alias("r")))
    assert fixed.exceptAll(fixed).count() == 0
    assert sorted(map(tuple, fixed.collect())) == sorted(map(tuple, fixed.collect()))


def test_a_scope_leaves_nothing_behind(spark, tmp_path):
    from pathlib import Path

    with scratch_scope(spark):
        inner = scratch_path(spark, "inner")
        fixed = pin(spark.range(10).toDF("id"), "scoped")
        fixed.write.parquet(str(tmp_path / "result"))
        folder = Path(shared_dir(spark).removeprefix("file:"))
        assert list(folder.glob("scoped-*"))
    assert not list(folder.glob("scoped-*")) and not Path(inner).exists()
    assert spark.read.parquet(str(tmp_path / "result")).count() == 10
    kept = pin(spark.range(3).toDF("id"), "unscoped")
    assert kept.count() == 3 and list(folder.glob("unscoped-*"))


def test_spreading_is_for_short_scans_only(spark):
    assert spread(spark.range(0, 10, 1, 1), "id").rdd.getNumPartitions() == 8
    many = spark.range(0, 10, 1, 20)
    assert spread(many, "id") is many
