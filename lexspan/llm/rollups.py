"""Token counts maintained by deltas.

A batch of changes (documents put in, revised or deleted) is turned into signed rows: what a
document counted before with a minus, what it counts now with a plus. Their sums by source,
language and tokenizer version are added to the totals. A batch is committed once: its folders are
written again if it failed halfway, and a batch that is committed already changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.llm.text import words
from lexspan.session import scratch_path

Counter = Callable[[Column], Column]

KEYS = ["source", "lang", "tokenizer"]
ROWS = "doc_id bigint, source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_chars bigint"
COMMIT = "batch bigint"


def word_tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.size(words(text))


def piece_tokens(text: Column) -> Column:
    """Runs of letters and digits, and every other visible character for itself."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"))


TOKENIZERS: dict[str, Counter] = {"words-1": word_tokens, "pieces-2": piece_tokens}


class TokenCounts:
    """Totals by source, language and tokenizer version below one shared folder.

    `changes/batch=N` has the signed rows of a batch by document, `totals/batch=N` their sums, and
    `commits/batch=N` is written last. What has no commit is not read.
    """

    def __init__(self, spark: SparkSession, path: str, tokenizers: dict[str, Counter] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.tokenizers = tokenizers or TOKENIZERS

    def _committed(self) -> list[int]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        files = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(hadoop):
            return []
        found = [s.getPath().getName() for s in files.listStatus(hadoop)]
        done = [b for b in found if files.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{b}/_SUCCESS"))]
        return sorted(int(b.split("=")[1]) for b in done)

    def _read(self, kind: str, columns: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], columns)
        return self.spark.read.schema(columns).parquet(*[f"{self.path}/{kind}/batch={b}" for b in batches])

    def _signed(self, changes: DataFrame, before: list[int]) -> DataFrame:
        """The signed rows of a batch. Of several changes to a document the one with the largest `seq`
        counts; of equal ones, a deletion, then the largest text."""
        text = F.col("text")
        counted = [
            F.when(
                F.col("tokenizer") == name,
                F.struct(F.lit(name).alias("tokenizer"), count(text).cast("bigint").alias("n_tokens")),
            )
            for name, count in self.tokenizers.items()
        ]
        size = F.length(F.coalesce("text", F.lit(""))).cast("bigint")
        narrow = changes.filter("doc_id is not null").select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("seq").cast("bigint").alias("seq"),
            (F.col("op") == "delete").alias("gone"),
            "source",
            "lang",
            F.coalesce(*counted).alias("count"),
            size.alias("n_chars"),
        )
        last = narrow.groupBy("doc_id").agg(
            F.max(F.struct("seq", "gone", "n_chars", "count", "source", "lang")).alias("c")
        )
        new = last.filter("not c.gone and c.count is not null").select(
            "doc_id",
            "c.source",
            "c.lang",
            "c.count.tokenizer",
            F.lit(1).cast("bigint").alias("n_docs"),
            "c.count.n_tokens",
            "c.n_chars",
        )
        held = (
            self._read("changes", ROWS, before)
            .join(last.select("doc_id"), "doc_id", "left_semi")
            .groupBy("doc_id", *KEYS)
            .agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_chars")])
            .filter("n_docs <> 0")
        )
        taken = held.select("doc_id", *KEYS, *[(-F.col(c)).alias(c) for c in ("n_docs", "n_tokens", "n_chars")])
        return taken.unionByName(new)

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Commit a batch; false if it was committed before.

        `changes` has doc_id, seq, op (`put` or `delete`), text, source, lang and tokenizer, the version
        to count with. A put of a document that is held is a revision. Null ids are left out: they name
        no document; so are puts for an unknown tokenizer. A null text counts nothing but the document.
        Batches are numbered in the order they apply.
        """
        committed = self._committed()
        if batch in committed:
            return False
        if committed and batch < committed[-1]:
            raise ValueError(f"batch {batch} comes after {committed[-1]}")
        own = f"batch={batch}"
        self._signed(changes, committed).write.mode("overwrite").parquet(f"{self.path}/changes/{own}")
        sums = self._read("changes", ROWS, [batch]).groupBy(*KEYS).agg(
            *[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_chars")]
        )
        sums.write.mode("overwrite").parquet(f"{self.path}/totals/{own}")
        self.spark.range(batch, batch + 1).withColumnRenamed("id", "batch").write.mode("overwrite").parquet(
            f"{self.path}/commits/{own}"
        )
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_chars of what is held now."""
        columns = ROWS.split(", ", 1)[1]
        return (
            self._read("totals", columns, self._committed())
            .groupBy(*KEYS)
            .agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_chars")])
            .filter("n_docs <> 0")
        )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: put in with the first tokenizer; labelled ones counted again
    with the second; those labelled bad deleted. The second is sent twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    first, second = TOKENIZERS
    counts = TokenCounts(spark, scratch_path(spark, "token-counts"))
    put = docs.withColumns({"seq": F.lit(0), "op": F.lit("put"), "tokenizer": F.lit(first)})
    counts.apply(1, put)
    again = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    again = again.withColumns({"seq": F.lit(0), "op": F.lit("put"), "tokenizer": F.lit(second)})
    counts.apply(2, again)
    counts.apply(2, again)
    nothing = {c: F.lit(None).cast("string") for c in ("text", "source", "lang", "tokenizer")}
    bad = labels.filter("quality = 0").select("doc_id").distinct()
    counts.apply(3, bad.withColumns({"seq": F.lit(0), "op": F.lit("delete"), **nothing}))
    return counts.totals()


OP5_SQL = r"""
WITH labelled AS (SELECT DISTINCT doc_id FROM labels),
bad AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0),
counted AS (
  SELECT d.source, d.lang, length(coalesce(text, '')) AS n_chars,
    CASE WHEN l.doc_id IS NULL THEN 'words-1' ELSE 'pieces-2' END AS tokenizer,
    CASE WHEN l.doc_id IS NULL THEN len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))
      ELSE len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) END AS n_tokens
  FROM documents d LEFT JOIN labelled l ON l.doc_id = d.doc_id
  WHERE d.doc_id NOT IN (SELECT doc_id FROM bad))
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n_tokens) AS BIGINT) AS n_tokens,
  CAST(sum(n_chars) AS BIGINT) AS n_chars
FROM counted GROUP BY ALL
"""
