"""Session settings and the shared scratch space of a job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_open_scopes: list[list[str]] = []


def build_session(app: str = "lexspan", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; `conf` wins over them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Document rows are wide: keep the Arrow batches sent to Python small.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
        # Joins of wide rows with narrow ones on a key: hash the narrow side of each
        # partition where it fits, rather than sort the wide one.
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "128m",
        # Let lookups of many ids reach the row-group statistics.
        "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by `spark.checkpoint.dir`.

    Only a local-mode session may fall back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            named = tempfile.mkdtemp(prefix="lexspan-")
        context.setCheckpointDir(named)
    return named or current


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _open_scopes:
        _open_scopes[-1].append(path)
    return path


def delete(spark: SparkSession, name: str) -> None:
    """Delete a path of the shared folder, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what `pin` and `scratch_path` made inside; write results before.

    with scratch_scope(spark):
        create_index(documents, key, model).write.parquet(path)
    """
    made: list[str] = []
    _open_scopes.append(made)
    try:
        yield
    finally:
        _open_scopes.remove(made)
        for name in made:
            delete(spark, name)


def shuffle_partitions(spark: SparkSession) -> int:
    """Tasks of a shuffle: the session's setting, or every core if that is more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def pin(df: DataFrame, label: str = "pinned") -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Used where later steps must all see one fixed result (partition layout, model
    output) even if executors are lost and tasks run again.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition by `keys` when the scan yields fewer partitions than cores.

    A file of one row group is one task; on a large corpus this is a no-op.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
