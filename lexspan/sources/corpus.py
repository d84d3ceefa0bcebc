"""A corpus directory: one subdirectory of parquet per dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Corpus:
    """`base/<dataset>/<file>` holds the documents of one dataset."""

    def __init__(
        self,
        spark: SparkSession,
        base: str,
        file: str = "train.parquet",
        schema: T.StructType | None = None,
    ) -> None:
        self.spark, self.base, self.file, self.schema = spark, base.rstrip("/"), file, schema

    def dataset_names(self) -> list[str]:
        """The non-hidden subdirectories."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(self.base)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        names = [f.getPath().getName() for f in files if f.isDirectory()]
        return sorted(n for n in names if not n.startswith("."))

    def path_of(self, name: str) -> str:
        return f"{self.base}/{name}/{self.file}"

    def _read(self, *paths: str) -> DataFrame:
        reader = self.spark.read
        if self.schema is not None:
            reader = reader.schema(self.schema)
        return reader.parquet(*paths)

    def scan_dataset(self, name: str) -> DataFrame:
        names = self.dataset_names()
        if name not in names:
            raise _unknown(name, names)
        return self._read(self.path_of(name))

    def scan_all(self, merge_schemas: bool = False) -> DataFrame:
        """Every dataset; columns a dataset lacks are null when schemas are merged."""
        paths = [self.path_of(n) for n in self.dataset_names()]
        if merge_schemas and self.schema is None:
            return self.spark.read.option("mergeSchema", "true").parquet(*paths)
        return self._read(*paths)

    def count_rows(self) -> int:
        return self.scan_all().count()


def dataset_of_path(path: Column | None = None) -> Column:
    """The dataset a row was read from: the folder of its file.

    Works for `<dataset>/train.parquet`, for `<dataset>/train.parquet/part-*` and for
    partition folders `key=<dataset>/part-*`.
    """
    path = F.col("_metadata.file_path") if path is None else path
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(plain, r"/(?:[^/=]+=)?([^/]+)(?:/[^/]+\.parquet)?/[^/]+$", 1)


def _unknown(name: str, names: list[str]) -> ValueError:
    return ValueError(f"no dataset called {name!r} here; there are {names}")


def distinct_datasets(df: DataFrame, column: str = "dataset") -> DataFrame:
    """Dataset names of a table that has them in a column."""
    return df.select(F.col(column).alias("dataset")).where(~F.col("dataset").startswith(".")).distinct()


def scan_table(df: DataFrame, name: str, column: str = "dataset") -> DataFrame:
    """One dataset of a table; an unknown name is refused with the choices."""
    if df.where(F.col(column) == name).select(F.lit(1)).first() is None:
        names = sorted(r[0] for r in distinct_datasets(df, column).collect())
        raise _unknown(name, names)
    return df.where(F.col(column) == name)


def read_whole_text(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its name and its whole content."""
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("value").alias("text"),
    )


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Embedded chunks written by `save_chunks`.

    Partition folders carry the dataset; it is read as a string whatever it looks like.
    """
    found = spark.read.parquet(path).schema
    if "dataset" not in found.names:
        return spark.read.schema(found).parquet(path)
    fields = [T.StructField("dataset", T.StringType()) if f.name == "dataset" else f for f in found]
    return spark.read.schema(T.StructType(fields)).parquet(path)
