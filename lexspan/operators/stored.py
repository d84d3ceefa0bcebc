"""Running totals in the order in which rows are stored, without moving a row.

A scan task reads rows of a file one after another. Totals are taken for every such run, summed over
all runs by file and place, and added to the running sums inside the run. Only one narrow row for
every run is shuffled; texts stay in the task that read them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspan.operators.filters import has_text
from lexspan.operators.ordinals import document_counters, running_totals
from lexspan.schema import TEXT_EN
from lexspan.session import pin

# Names beginning with this are taken.
_OWN = "_stored_"
_FILE, _ROW, _START = f"{_OWN}file", f"{_OWN}row", f"{_OWN}start"

# Most runs that are sent to the tasks; more are joined by a shuffle.
BROADCAST_RUNS = 500_000


def _within_runs(names: list[str]):
    """Add the first row of the run and, in place of each measure, `before`: its sum over earlier rows of the run."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, row, start, totals = None, -1, 0, dict.fromkeys(names, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(_FILE).dictionary_encode()
            files, places = codes.indices.to_numpy(), batch.column(_ROW).to_numpy()
            opens = np.ones(len(places), dtype=bool)
            opens[1:] = (files[1:] != files[:-1]) | (places[1:] != places[:-1] + 1)
            first = codes.dictionary[int(files[0])].as_py()
            opens[0] = first != file or places[0] != row + 1
            at, run = np.flatnonzero(opens), np.cumsum(opens)
            starts = np.concatenate([[start], places[at]])[run]
            columns = {n: batch.column(n) for n in batch.schema.names}
            for name in names:
                own = columns[name].to_numpy()
                earlier = np.cumsum(own) - own
                before = earlier - np.concatenate([[-totals[name]], earlier[at]])[run]
                columns[f"{name}_before"] = pa.array(before)
                totals[name] = int(before[-1] + own[-1])
            columns[_START] = pa.array(starts)
            file, row, start = codes.dictionary[int(files[-1])].as_py(), int(places[-1]), int(starts[-1])
            yield pa.RecordBatch.from_pydict(columns)

    return add


def stored_totals(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """`df` with, for each row, the sum of each measure over all rows stored *before* it.

    Rows are in the order of their files' paths and, within a file, of their place. `df` is a scan of
    Parquet files with columns chosen or added, but without a filter: a row that should not count has a
    measure of 0 or null, and is dropped afterwards. Eager: the totals of the runs are written while the
    plan is built. If files are read in other pieces later, the job fails and numbers nothing wrongly.
    """
    own = {f"{_OWN}{i}": m for i, m in enumerate(measures.values())}
    placed = df.select(
        "*",
        F.col("_metadata.file_path").alias(_FILE),
        F.col("_metadata.row_index").alias(_ROW),
        *[F.coalesce(m.cast("long"), F.lit(0)).alias(n) for n, m in own.items()],
    )

    def with_runs(rows: DataFrame) -> DataFrame:
        added = [T.StructField(f"{n}_before", T.LongType()) for n in own]
        schema = T.StructType([*rows.schema.fields, *added, T.StructField(_START, T.LongType())])
        return rows.mapInArrow(_within_runs(list(own)), schema)

    narrow = with_runs(placed.select(_FILE, _ROW, *own))
    runs = pin(narrow.groupBy(_FILE, _START).agg(*[F.sum(n).alias(n) for n in own]), "runs")
    offsets = running_totals(runs, [_FILE, _START], {f"{n}_offset": F.col(n) for n in own})
    if runs.count() <= BROADCAST_RUNS:
        offsets = F.broadcast(offsets)
    moved = F.raise_error(F.lit("the files are read in other pieces than before"))
    numbered = with_runs(placed).join(offsets, [_FILE, _START], "left")
    return numbered.select(
        *df.columns,
        *[
            F.coalesce(F.col(f"{n}_offset") + F.col(f"{n}_before"), moved.cast("long")).alias(name)
            for n, name in zip(own, measures)
        ],
    )


def number_stored_documents(df: DataFrame, en_only: bool = True) -> DataFrame:
    """The documents that are kept, with `doc_idx`, `doc_idx_en` and `doc_idx_fr` in storage order."""
    counters = {n: m for n, m in document_counters(en_only).items() if n != "row_idx"}
    numbered = stored_totals(df, counters)
    return numbered.where(has_text(F.col(TEXT_EN))) if en_only else numbered
