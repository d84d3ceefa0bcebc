"""The given tables in the shape the operators expect.

`corpus` gives `documents` the columns of a bilingual corpus. Bodies: every text that is
not French is the English body, and French documents have a null or (short ones) a blank
one; French and Spanish texts are the French body, so Spanish documents have both;
German documents have an empty and English ones a null French body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.operators.models import HashModel
from lexspan.plans.indexing import create_index
from lexspan.session import spread

KEY = ["doc_id"]
MODEL = HashModel(64)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def wide_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents on as many tasks as there are cores."""
    return spread(documents(spark, sf), "doc_id")


def corpus(spark: SparkSession, sf: str, wide: bool = False) -> DataFrame:
    d = wide_documents(spark, sf) if wide else documents(spark, sf)
    lang = F.col("lang")
    french = lang.isin("fr", "es")
    date = F.make_date(1990 + F.pmod("doc_id", F.lit(35)), F.lit(1), F.lit(1)).cast("timestamp")

    def only(test: Column, value: Column) -> Column:
        return F.when(test, value)

    return d.select(
        "doc_id",
        F.col("source").alias("dataset"),
        F.concat(F.lit("doc-"), "doc_id").alias("citation_en"),
        F.lit(None).cast("string").alias("citation2_en"),
        F.concat(F.lit("Document "), "doc_id").alias("name_en"),
        date.alias("document_date_en"),
        F.concat(F.lit("https://example.org/"), "doc_id").alias("url_en"),
        date.alias("scraped_timestamp_en"),
        F.when(lang != "fr", F.col("text"))
        .when(F.col("n_chars") < 1000, F.lit("  \n"))
        .alias("unofficial_text_en"),
        only(french, F.concat(F.lit("doc-fr-"), "doc_id")).alias("citation_fr"),
        F.lit(None).cast("string").alias("citation2_fr"),
        only(french, F.concat(F.lit("Document fr "), "doc_id")).alias("name_fr"),
        only(french, date).alias("document_date_fr"),
        only(french, F.concat(F.lit("https://example.org/fr/"), "doc_id")).alias("url_fr"),
        only(french, date).alias("scraped_timestamp_fr"),
        F.when(french, F.col("text")).when(lang == "de", F.lit("")).alias("unofficial_text_fr"),
        F.lit("CC0").alias("upstream_license"),
    )


CORPUS_SQL = r"""corpus AS (
  SELECT doc_id, source AS dataset, 'doc-' || doc_id AS citation_en,
    CAST(NULL AS VARCHAR) AS citation2_en, 'Document ' || doc_id AS name_en,
    make_date(1990 + doc_id % 35, 1, 1) AS document_date_en,
    'https://example.org/' || doc_id AS url_en,
    CASE WHEN lang <> 'fr' THEN text WHEN n_chars < 1000 THEN '  ' || chr(10) END
      AS unofficial_text_en,
    CASE WHEN lang IN ('fr', 'es') THEN 'doc-fr-' || doc_id END AS citation_fr,
    CASE WHEN lang IN ('fr', 'es') THEN 'Document fr ' || doc_id END AS name_fr,
    CASE WHEN lang IN ('fr', 'es') THEN make_date(1990 + doc_id % 35, 1, 1) END
      AS document_date_fr,
    CASE WHEN lang IN ('fr', 'es') THEN 'https://example.org/fr/' || doc_id END AS url_fr,
    CASE WHEN lang IN ('fr', 'es') THEN text WHEN lang = 'de' THEN '' END AS unofficial_text_fr,
    'CC0' AS upstream_license
  FROM documents)"""


def numbered_lines(spark: SparkSession, sf: str) -> DataFrame:
    """`corpus` whose English body carries paragraph numbers.

    English texts get `[k]` before each line, French and Spanish ones a bare `k`, German
    ones stay as they are.
    """
    d = documents(spark, sf)
    lines = F.split("text", "\n")

    def joined(left: str, right: str) -> Column:
        return F.concat(
            F.lit("Decision"),
            F.array_join(
                F.transform(
                    lines,
                    lambda line, i: F.concat(
                        F.lit("\n" + left), (i + 1).cast("string"), F.lit(right + " "), line
                    ),
                ),
                "",
            ),
        )

    text = (
        F.when(F.col("lang") == "en", joined("[", "]"))
        .when(F.col("lang").isin("fr", "es"), joined("", ""))
        .otherwise(F.col("text"))
    )
    return d.select(
        "doc_id",
        text.alias("unofficial_text_en"),
        F.concat(F.lit("doc-"), "doc_id").alias("citation_en"),
        F.concat(F.lit("doc-fr-"), "doc_id").alias("citation_fr"),
        F.concat(F.lit("https://example.org/"), "doc_id").alias("url_en"),
    )


NUMBERED_SQL = r"""numbered AS (
  SELECT doc_id, 'doc-' || doc_id AS citation_en, 'doc-fr-' || doc_id AS citation_fr,
    'https://example.org/' || doc_id AS url_en,
    CASE WHEN lang = 'en' THEN 'Decision' || array_to_string(list_transform(
           string_split(text, chr(10)), lambda x, i: chr(10) || '[' || i || '] ' || x), '')
         WHEN lang IN ('fr', 'es') THEN 'Decision' || array_to_string(list_transform(
           string_split(text, chr(10)), lambda x, i: chr(10) || i || ' ' || x), '')
         ELSE text END AS text
  FROM documents)"""


def headed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents under a header block: label lines for English, `Label: value` lines for
    French, a bilingual form for Spanish texts, none for German ones."""
    d = documents(spark, sf)
    number = F.col("doc_id").cast("string")
    labelled = F.concat(
        F.lit("Title "), number, F.lit("\nCollection\n"), "source",
        F.lit("\nDate\n2001-02-03\nNeutral citation\n2001 X "), number,
        F.lit("\nGrounds\nRace\nReligion\nDecision Content\n"), "text",
    )
    inline = F.concat(
        F.lit("2001 X "), number, F.lit("\n\nCitation: 2001 X "), number,
        F.lit("\nTribunal: "), "source", F.lit("\nCountry: Mexico\n\nDECISION\n\n[1] "), "text",
    )
    form = F.concat(
        F.lit("\nPrivate Proceeding / Huis clos\nPanel\n"), "source",
        F.lit("\nDate of Decision\nMarch 4, 2010\n[1] "), "text",
    )
    text = (
        F.when(F.col("lang") == "en", labelled)
        .when(F.col("lang") == "fr", inline)
        .when(F.col("lang") == "es", form)
        .otherwise(F.col("text"))
    )
    return d.select("doc_id", text.alias("unofficial_text_en"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark passages as questions."""
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def chunk_index(spark: SparkSession, sf: str) -> DataFrame:
    """An index over fixed-size chunks of every document."""
    d = wide_documents(spark, sf).select(
        "doc_id",
        F.col("source").alias("dataset"),
        F.concat(F.lit("https://example.org/"), "doc_id").alias("url_en"),
        F.col("text").alias("unofficial_text_en"),
    )
    return create_index(d, KEY, MODEL, max_tokens=None)


def whole_numbers(vector: str = "embedding") -> Column:
    """A vector of counts as text, so that both engines compare exactly."""
    return F.array_join(F.transform(vector, lambda x: x.cast("int").cast("string")), ",")
