"""Dense ordinals and running totals over a whole table, without one big task.

Only the ordering key and the counted values are moved: they are range-partitioned by
the key, written to the shared folder so that the layout is fixed, summed per
partition, and the few partition sums are turned into offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.operators.filters import has_text
from lexspan.schema import TEXT_EN, TEXT_FR
from lexspan.session import pin, shuffle_partitions

_PART = "_part"


def running_totals(
    df: DataFrame,
    order_by: list[str],
    measures: dict[str, Column],
    carry: dict[str, Column] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """For each row, the sum of each measure over all rows *before* it.

    `order_by` must identify a row. Returns those columns, one long per measure, and
    the `carry` columns as they are.
    """
    parts = partitions or shuffle_partitions(df.sparkSession)
    carry = carry or {}
    # Written before it is partitioned, since finding the range bounds reads it twice
    # and the measures may come from whole texts.
    narrow = pin(
        df.select(
            *order_by,
            *[m.cast("long").alias(n) for n, m in measures.items()],
            *[c.alias(n) for n, c in carry.items()],
        ),
        "measures",
    )
    fixed = pin(
        narrow.repartitionByRange(parts, *order_by).withColumn(_PART, F.spark_partition_id()),
        "running-totals",
    )
    # At most `parts` rows, whatever the size of the table.
    totals = fixed.groupBy(_PART).agg(*[F.sum(n).alias(n) for n in measures])
    earlier = W.orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(_PART, *[_sum_before(n, earlier).alias(f"{n}_offset") for n in measures])
    within = W.partitionBy(_PART).orderBy(*order_by).rowsBetween(W.unboundedPreceding, -1)
    return fixed.join(F.broadcast(offsets), _PART).select(
        *order_by,
        *[(F.col(f"{n}_offset") + _sum_before(n, within)).alias(n) for n in measures],
        *carry,
    )


def _sum_before(column: str, window) -> Column:
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def document_counters(en_only: bool = True) -> dict[str, Column]:
    """What `doc_idx`, `doc_idx_en` and `doc_idx_fr` count, and the plain row position."""
    kept = has_text(F.col(TEXT_EN)) if en_only else F.lit(True)
    return {
        "row_idx": F.lit(1),
        "doc_idx": F.when(kept, 1).otherwise(0),
        "doc_idx_en": F.when(kept & has_text(F.col(TEXT_EN), "empty"), 1).otherwise(0),
        "doc_idx_fr": F.when(kept & has_text(F.col(TEXT_FR), "empty"), 1).otherwise(0),
    }


def document_ordinals(
    df: DataFrame, order_by: list[str], en_only: bool = True, partitions: int | None = None
) -> DataFrame:
    """`order_by` and the counters of every row, skipped rows included."""
    return running_totals(df, order_by, document_counters(en_only), partitions=partitions)


def number_documents(
    df: DataFrame, order_by: list[str], en_only: bool = True, partitions: int | None = None
) -> DataFrame:
    """The documents that are kept, with `doc_idx`, `doc_idx_en` and `doc_idx_fr`."""
    kept = df.where(has_text(F.col(TEXT_EN))) if en_only else df
    numbers = document_ordinals(df, order_by, en_only, partitions).drop("row_idx")
    return kept.join(numbers, order_by)
