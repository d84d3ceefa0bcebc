"""Sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.session import scratch_path

# Fixed value: rows of the CSV sample written for inspection.
CSV_SAMPLE = 50


def save_chunks(chunks: DataFrame, path: str, partition_col: str = "dataset") -> None:
    """Embedded chunks as parquet, one folder per dataset."""
    chunks.write.mode("overwrite").partitionBy(partition_col).parquet(path)


def _flat(df: DataFrame) -> DataFrame:
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        [
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _csv(df: DataFrame):
    # Double quotes inside a field are doubled, as spreadsheet readers expect.
    # The writer would strip surrounding blanks by default.
    return df.write.options(
        header=True, escape="\"", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def csv_sample(chunks: DataFrame, order_by: list[str], n: int = CSV_SAMPLE) -> DataFrame:
    """The first `n` chunks in order, nested columns as JSON."""
    return _flat(chunks.orderBy(*order_by).limit(n))


def save_csv_sample(chunks: DataFrame, path: str, order_by: list[str], n: int = CSV_SAMPLE) -> None:
    _csv(csv_sample(chunks, order_by, n)).mode("overwrite").csv(path)


def incremental_save(chunks: DataFrame, path: str, batch_size: int = 32, every: int = 20) -> None:
    """Save in steps of `every * batch_size` documents; `chunks` must carry `doc_idx`.

    Each step is its own folder, and saving a step again replaces only that folder. Rows are
    cut by ranges of `doc_idx` first, so there are no more files than steps and tasks together.
    To have steps committed one after the other, save ranges of `doc_idx` one by one.
    """
    step = F.floor(F.col("doc_idx") / (every * batch_size)).cast("long")
    (
        chunks.withColumn("save_id", step)
        .repartitionByRange("doc_idx")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("save_id")
        .parquet(path)
    )


def finished_ranges(spark: SparkSession, path: str, size: int) -> set[int]:
    """The ranges of `size` documents that `resumable_save` has finished below `path`."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_finished")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    marks = [tuple(map(int, n.split("-"))) for n in names if not n.startswith((".", "_"))]
    if any(own != size for own, _ in marks):
        raise ValueError(f"ranges of another size than {size} are saved in {path}")
    return {step for _, step in marks}


def resumable_save(
    documents: DataFrame,
    embed_range: Callable[[DataFrame], DataFrame],
    path: str,
    batch_size: int = 32,
    every: int = 20,
    at_once: int = 1,
) -> list[int]:
    """Save `embed_range(documents)` in steps of `every * batch_size` documents, one after the other.

    `documents` carries `doc_idx`. A step is written to its own folder and then entered in a log; a run
    skips what the log holds, before any model is called, and writes again what was not finished.
    Returns the steps of this run. Documents are first laid out by range, so that no step reads those
    of another.

    With `at_once` above 1, one job writes the folders of up to so many steps, which are logged when it
    ends. `embed_range` must then work document by document and keep `doc_idx`. If such a job fails (or
    there is no `doc_idx`), its halves are run in turn, so all steps before the one that fails are saved, as
    if run one by one.
    """
    spark, size = documents.sparkSession, every * batch_size
    done = finished_ranges(spark, path, size)
    step = F.floor(F.col("doc_idx") / size).cast("long")
    # One number for every step that there is.
    there = documents.select(step.alias("step")).distinct().orderBy("step").toArrow().column(0).to_pylist()
    todo = [s for s in there if s is not None and s not in done]
    groups: dict[int, list[int]] = {}
    for own in todo:
        groups.setdefault(own // at_once, []).append(own)
    laid_out = documents
    if len(groups) > 1:
        tasks = min(len(todo), len(groups) * spark.sparkContext.defaultParallelism)
        at = scratch_path(spark, "ranges")
        by_group = documents.withColumn("_group", F.floor(F.col("doc_idx") / (size * at_once)).cast("long"))
        by_group = by_group.where(F.col("_group").isin(list(groups)))
        by_group.repartitionByRange(tasks, "doc_idx").write.partitionBy("_group").parquet(at)
        laid_out = spark.read.schema(by_group.schema).parquet(at)

    def folder(own: int):
        found = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/save_id={own}")
        return found.getFileSystem(spark._jsc.hadoopConfiguration()), found

    def write(part: DataFrame, steps: list[int]) -> None:
        saved = embed_range(part)
        if len(steps) > 1:
            for fs, old in map(folder, steps):  # what an unfinished run has left
                fs.delete(old, True)
            saved.withColumn("save_id", step).write.mode("append").partitionBy("save_id").parquet(path)
            saved = spark.createDataFrame([], saved.schema)
            # Steps without rows have a folder, too.
            steps = [own for own in steps if not folder(own)[0].exists(folder(own)[1])]
        for own in steps:
            saved.write.mode("overwrite").parquet(f"{path.rstrip('/')}/save_id={own}")

    def run(part: DataFrame, steps: list[int]) -> None:
        wanted = step == steps[0] if len(steps) == 1 else step.isin(steps)
        try:
            write(part.where(wanted), steps)
        except Exception:
            if len(steps) == 1:
                raise
            run(part, steps[: len(steps) // 2])
            run(part, steps[len(steps) // 2 :])
            return
        for own in steps:
            mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_finished/{size}-{own}")
            mark.getFileSystem(spark._jsc.hadoopConfiguration()).create(mark, True).close()

    for group, steps in groups.items():
        part = laid_out.where(F.col("_group") == group).drop("_group") if len(groups) > 1 else documents
        run(part, steps)
    return todo


def export_text_samples(samples: DataFrame, path: str, text_col: str) -> None:
    """One text file per sampled document; a null text gives an empty file."""
    (
        samples.select("dataset", "sample_idx", F.coalesce(text_col, F.lit("")).alias("value"))
        .write.mode("overwrite")
        .partitionBy("dataset", "sample_idx")
        .text(path)
    )


def save_similarities(similarities: DataFrame, path: str) -> None:
    similarities.write.mode("overwrite").parquet(path)


def append_error_log(errors: DataFrame, path: str) -> None:
    """Append parse errors as CSV with a header."""
    _csv(errors).mode("append").csv(path)


def report_lines(
    hits: DataFrame, query: Column, url: Column, text: Column, rank_col: str = "rank"
) -> DataFrame:
    """The entries of a retrieval report, to be read in the order of `rank_col`.

    The entry of rank zero opens with the query line.
    """
    rule = "-" * 65  # fixed value
    entry = F.format_string(
        "doc %d: URL: %s | %s\n " + rule + "\n", F.col(rank_col), url, text
    )
    opening = F.when(F.col(rank_col) == 0, F.concat(F.lit("query: "), query, F.lit("\n")))
    keep = [c for c in ("query_id", rank_col) if c in hits.columns]
    return hits.select(*keep, F.concat(F.coalesce(opening, F.lit("")), entry).alias("line"))


def save_report(lines: DataFrame, path: str, query_col: str = "query_id") -> None:
    """The entries of all reports as one table, in the order of query and rank."""
    ordered = lines.repartitionByRange(query_col, "rank").sortWithinPartitions(query_col, "rank")
    ordered.write.mode("overwrite").parquet(path)
