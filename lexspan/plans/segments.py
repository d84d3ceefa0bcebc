"""An index that is kept up to date: segments of records, removals, and a manifest.

Appended records are a new segment; removed ids are a table of their own, which holds for the segments
that were there before it. A manifest lists what counts. It is written beside and renamed into place as
the last step of every change, so a change that fails leaves the index as it was, and readers see a
change whole or not at all. Changes are made by one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    """A folder of records or of removed ids, in the order of the changes."""

    path: str
    change: int
    rows: int


@dataclass(frozen=True)
class Manifest:
    version: int
    segments: tuple[Part, ...]
    removals: tuple[Part, ...]


class SegmentedIndex:
    """An index below `path`, a folder on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, index_id: str = "index_id"):
        self.spark, self.path, self.index_id = spark, path.rstrip("/"), index_id
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- the manifest

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def manifest(self) -> Manifest:
        """The newest manifest; of an empty index, if there is none."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)] if self._fs.exists(self._root) else []
        versions = [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]
        if not versions:
            return Manifest(0, (), ())
        text = self.spark.read.text(f"{self.path}/manifest-{max(versions)}.json", wholetext=True).first()[0]
        held = json.loads(text)
        return Manifest(held["version"], *(tuple(Part(**p) for p in held[c]) for c in ("segments", "removals")))

    def _commit(self, held: Manifest) -> None:
        beside, final = self._file(f".manifest-{uuid.uuid4().hex}"), self._file(f"manifest-{held.version}.json")
        stream = self._fs.create(beside, True)
        stream.write(bytearray(json.dumps(asdict(held)).encode()))
        stream.close()
        # A rename onto a file that is there fails: somebody else made this change.
        if self._fs.exists(final) or not self._fs.rename(beside, final):
            self._fs.delete(beside, False)
            raise RuntimeError(f"the index has been changed meanwhile: {final} is there")

    def _write(self, rows: DataFrame, kind: str, change: int) -> Part:
        path = f"{self.path}/{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return Part(path, change, self.spark.read.parquet(path).count())

    # ---- changes

    def append(self, records: DataFrame) -> None:
        """Add records. Their ids must be new, or removed before."""
        held = self.manifest()
        change = held.version + 1
        part = self._write(records, "segment", change)
        self._commit(Manifest(change, (*held.segments, part), held.removals))

    def remove(self, ids: DataFrame) -> None:
        """Take records out by the ids in column `index_id`; ids that are not there do nothing."""
        held = self.manifest()
        change = held.version + 1
        part = self._write(ids.select(self.index_id).dropna().distinct(), "removed", change)
        self._commit(Manifest(change, held.segments, (*held.removals, part)))

    def replace(self, records: DataFrame) -> None:
        """Add records in place of those with their ids, as one change."""
        held = self.manifest()
        change = held.version + 1
        part = self._write(records, "segment", change)
        stored = self.spark.read.parquet(part.path)
        gone = self._write(stored.select(self.index_id).dropna().distinct(), "removed", change)
        # A removal holds for earlier changes only, so not for the segment made with it.
        self._commit(Manifest(change, (*held.segments, part), (*held.removals, gone)))

    def merge(self, smaller_than: int | None = None) -> None:
        """Write the segments of fewer rows (all, if not told otherwise) as one, without what was removed.

        Removals stay listed while a segment is left that they may hold for.
        """
        held = self.manifest()
        chosen = [s for s in held.segments if smaller_than is None or s.rows < smaller_than]
        rest = [s for s in held.segments if s not in chosen]
        if not chosen or (len(chosen) == 1 and not held.removals):
            return
        change = held.version + 1
        part = self._write(self._live(Manifest(held.version, tuple(chosen), held.removals)), "segment", change)
        removals = tuple(r for r in held.removals if any(s.change < r.change for s in rest))
        segments = (*rest, part) if part.rows else tuple(rest)
        self._commit(Manifest(change, segments, removals))

    def vacuum(self) -> None:
        """Delete folders that the newest manifest does not list, and older manifests.

        Readers of older manifests must be done.
        """
        held = self.manifest()
        listed = {p.path.rsplit("/", 1)[1] for p in (*held.segments, *held.removals)}
        keep = {*listed, f"manifest-{held.version}.json"}
        for status in self._fs.listStatus(self._root):
            if status.getPath().getName() not in keep:
                self._fs.delete(status.getPath(), True)

    # ---- reading

    def _live(self, held: Manifest) -> DataFrame:
        parts = [self.spark.read.parquet(s.path).withColumn("_change", F.lit(s.change)) for s in held.segments]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        first = min(s.change for s in held.segments)
        gone = [
            self.spark.read.parquet(r.path).select(F.col(self.index_id).alias("_gone"), F.lit(r.change).alias("_at"))
            for r in held.removals
            if r.change > first
        ]
        if gone:
            # The last removal of an id decides: it holds for all earlier segments.
            last = reduce(DataFrame.unionByName, gone).groupBy("_gone").agg(F.max("_at").alias("_at"))
            match = (F.col(self.index_id) == F.col("_gone")) & (F.col("_change") < F.col("_at"))
            rows = rows.join(last, match, "left_anti")
        return rows.drop("_change")

    def read(self) -> DataFrame:
        """The records that are there, as one table for any search."""
        held = self.manifest()
        if not held.segments:
            raise ValueError(f"there is nothing in the index at {self.path}")
        return self._live(held)
