"""Quality rules: simple counts, and a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed one- and two-word features, one of trusted documents and one of
the raw corpus, give every document the mean log ratio of its features. A document below the
threshold reads less like the trusted ones than like the raw corpus, and is rejected.

All of it is built-in functions. A document is scored within its row; only counts by bucket,
of which there is a fixed number, are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm.text import places, words


@dataclass(frozen=True)
class Quality:
    """Parameters.

    buckets: hashed features, a power of two; also the bound of the table sent to the tasks.
    trusted: most trusted documents that the target multinomial is fitted on, those with the
    smallest hash of their id. smoothing: added to every bucket.
    threshold: smallest mean log ratio of a document that is kept.
    """

    buckets: int = 1 << 15
    trusted: int = 200_000
    smoothing: float = 1.0
    threshold: float = -0.08
    min_words: int = 10
    repeat_percent: int = 20


def hashed_words(words_column: Column) -> Column:
    return F.transform(words_column, lambda w: F.xxhash64(w))


def bucket(hashed: Column, buckets: int) -> Column:
    return hashed.bitwiseAND(F.lit(buckets - 1).cast("bigint"))


def feature_rows(docs: DataFrame, words_column: Column, buckets: int) -> DataFrame:
    """One row with the `bucket` of every single word and of every pair of neighbours.

    The words are set beside their followers and exploded, so that hashing is compiled code.
    """
    others = [c for c in docs.columns if c != "text"]
    zipped = F.arrays_zip(F.col("_words").alias("w"), F.slice("_words", 2, F.greatest(F.size("_words"), F.lit(1))).alias("next"))
    rows = docs.select(*others, words_column.alias("_words")).select(*others, F.explode(zipped).alias("_pair"))
    own = F.xxhash64("_pair.w")
    # The pair of the last word has no follower.
    pair = F.when(F.col("_pair.next").isNotNull(), F.xxhash64(own, F.xxhash64("_pair.next")))
    both = F.explode(F.array(bucket(own, buckets), bucket(pair, buckets))).alias("bucket")
    return rows.select(*others, both).filter("bucket is not null")


def score(hashes: str, table: str, buckets: int) -> Column:
    """The mean table entry of the buckets of all single words and pairs of neighbours; 0 of none."""
    h, t = F.col(hashes), F.col(table)
    n = F.size(h)

    def add(acc: Column, i: Column) -> Column:
        pair = F.xxhash64(h[i], F.get(h, i + 1))
        return acc + t[bucket(h[i], buckets)] + F.when(i + 1 < n, t[bucket(pair, buckets)]).otherwise(0.0)

    return F.aggregate(places(n, 1), F.lit(0.0), add) / F.greatest(2 * n - 1, F.lit(1))


def log_ratios(docs: DataFrame, trusted: DataFrame, how: Quality) -> DataFrame:
    """One row with the array `llr`: by bucket, log p(trusted) - log p(raw).

    Raw counts are of all of `docs` (columns doc_id, text), the trusted ones of those in `trusted`
    (column doc_id). Null ids are never trusted.
    """
    chosen = (
        trusted.select(F.col("doc_id").cast("bigint").alias("_id"))
        .dropna()
        .distinct()
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(how.trusted)
    )
    marked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left"
    )
    counts = (
        feature_rows(marked.select(F.col("_id").isNotNull().alias("own"), "text"), words(F.col("text")), how.buckets)
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.count_if("own").alias("target"))
    )
    every = docs.sparkSession.range(how.buckets).withColumnRenamed("id", "bucket").join(counts, "bucket", "left")
    table = every.agg(
        F.array_sort(
            F.collect_list(F.struct("bucket", F.coalesce("raw", F.lit(0)).alias("r"), F.coalesce("target", F.lit(0)).alias("t")))
        ).alias("rows"),
        F.coalesce(F.sum("raw"), F.lit(0)).alias("all_raw"),
        F.coalesce(F.sum("target"), F.lit(0)).alias("all_target"),
    )
    extra = how.smoothing * how.buckets

    def ratio(x: Column) -> Column:
        own = F.log((x["t"] + how.smoothing) / (F.col("all_target") + extra))
        return (own - F.log((x["r"] + how.smoothing) / (F.col("all_raw") + extra))).cast("float")

    return table.select(
        F.when(F.col("all_target") > 0, F.transform("rows", ratio))
        .otherwise(F.transform("rows", lambda x: F.lit(0.0).cast("float")))
        .alias("llr")
    )


def with_repeated_words(docs: DataFrame, words_column: str, hashes: str, width: int = 5) -> DataFrame:
    """Add `n_repeat_words`: words that lie in a window of `width` words found twice or more in the text.

    A window is hashed from the hashes of its words. Where a hash repeats, and only there, the windows
    themselves are compared.
    """
    w, h = F.col(words_column), F.col(hashes)
    starts = places(F.size(h), width)
    pairs, again, texts, twice = (F.col(c) for c in ("_pairs", "_again", "_texts", "_twice"))

    def repeated(column: Column, key: str) -> Column:
        """The elements of a sorted array whose key is that of a neighbour."""
        return F.filter(
            column,
            lambda x, i: F.coalesce(x[key] == F.get(column, i - 1)[key], F.lit(False))
            | F.coalesce(x[key] == F.get(column, i + 1)[key], F.lit(False)),
        )

    def window(x: Column) -> Column:
        # Words hold no blank, so joined windows are equal only if all their words are.
        return F.struct(F.concat_ws(" ", F.slice(w, x["i"] + 1, width)).alias("w"), x["i"].alias("i"))

    by_hash = F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(i - acc["last"], F.lit(width))).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    # Null from the first step on where no hash repeats, as in most texts.
    return (
        docs.withColumn("_windows", F.transform(starts, lambda i: F.xxhash64(*[h[i + j] for j in range(width)])))
        .withColumn("_pairs", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), by_hash))
        .withColumn("_again", F.when(pairs.isNotNull(), repeated(pairs, "h")))
        .withColumn("_texts", F.when(again.isNotNull(), F.sort_array(F.transform(again, window))))
        .withColumn("_twice", F.when(texts.isNotNull(), repeated(texts, "w")))
        .withColumn("n_repeat_words", F.when(twice.isNotNull(), covered).otherwise(0).cast("bigint"))
        .drop("_windows", "_pairs", "_again", "_texts", "_twice")
    )


def measure(docs: DataFrame) -> DataFrame:
    """Add the counts of a text (column `text`) and the words' hashes to every row.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and _hashes; a null text has
    none of anything.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = (
        docs.withColumn("_words", words(F.col("text")))
        .withColumn("n_words", F.size("_words").cast("bigint"))
        .withColumn("word_chars", F.length(F.concat_ws("", "_words")).cast("bigint"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("bigint"))
        .withColumn("_lines", lines)
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"))
        .withColumn("_hashes", hashed_words(F.col("_words")))
    )
    return with_repeated_words(counted, "_words", "_hashes").drop("_words", "_lines")


def judge(docs: DataFrame, trusted: DataFrame, how: Quality | None = None) -> DataFrame:
    """Every row of `docs` with its counts, base_failed, mean log ratio `llr` and kept.

    `docs` needs doc_id and text, `trusted` doc_id. A document without words fails the base rules.
    Repeated rows are judged each for itself; columns of `docs` named like an added one are replaced.
    With no trusted document every ratio is 0, and the base rules alone decide.
    """
    how = how or Quality()
    # A subquery may not stand inside a lambda function, so the table goes there as a column: a
    # copy of fixed size in the task's row buffer, dropped in the next step.
    table = log_ratios(docs, trusted, how).scalar()
    n = F.col("n_words")
    failed = (n < how.min_words) | (100 * F.col("n_repeat_words") > how.repeat_percent * n)
    scored = (
        measure(docs)
        .withColumn("_table", table)
        .withColumn("llr", score("_hashes", "_table", how.buckets))
    )
    return (
        scored.withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= how.threshold))
        .drop("_hashes", "_table")
    )


def trusted_documents(spark, sf_dir: str) -> DataFrame:
    """Ids of the documents labelled good."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, trusted_documents(spark, sf_dir)).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "llr",
    )
