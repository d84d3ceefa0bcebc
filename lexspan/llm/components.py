"""Connected components of a graph of links, by falling labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.session import pin


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of `links` (a, b): the least id that it is linked with.

    Every round takes the least label of the neighbours, then that label's own label. Each round is
    a written table, so that a lost executor costs one round at most; stars take two or three.
    """
    both = pin(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = pin(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("n")).select("id", F.least("id", "n").alias("label")),
        "labels",
    )
    while True:
        seen = (
            both.join(labels.select(F.col("id").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(seen, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        rows = lower.join(jump, "label").select("id", "old", F.least("label", "far").alias("label"))
        labels = pin(rows, "labels")
        if labels.filter("label < old").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
        labels = labels.drop("old")
