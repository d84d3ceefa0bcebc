"""Splitting, chunking and parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sql import WS, adjacent, naive_chunks, sentences, with_
from catalog.tables import (
    CORPUS_SQL,
    KEY,
    MODEL,
    NUMBERED_SQL,
    corpus,
    documents,
    headed_documents,
    numbered_lines,
    wide_documents,
)
from lexspan.functions.splitters import sentence_split as split_sentences
from lexspan.functions.splitters import whitespace_split as split_words
from lexspan.operators.chunking import NaiveChunker, TopicChunker, chunk
from lexspan.operators.explode import explode_once
from lexspan.operators.filters import unpivot_languages
from lexspan.operators.similarity import adjacent_similarity as adjacent_sims
from lexspan.operators.similarity import corpus_similarities as all_sims
from lexspan.plans import parsing

def _long_idx() -> Column:
    return F.col("chunk_idx").cast("long").alias("chunk_idx")


@query(
    "naive_chunk",
    with_(naive_chunks("c", "documents", cols="doc_id"))
    + "SELECT doc_id, chunk_idx, chunk AS unofficial_text FROM c",
)
def naive_chunk(spark: SparkSession, sf: str) -> DataFrame:
    d = wide_documents(spark, sf).select("doc_id", "text")
    return chunk(d, NaiveChunker()).select("doc_id", _long_idx(), "unofficial_text")


_SENTENCES = sentences("s", "documents", "doc_id", "text")

# The fold of a topic chunk, one sentence of every document per step.
_FOLD = """scored AS (
  SELECT doc_id, pos, sentence, sim, length(sentence) AS len,
    pos = max(pos) OVER (PARTITION BY doc_id) AS last FROM a),
fold AS (
  SELECT doc_id, pos, 0 AS chunk_idx, len AS size,
    sim < {threshold} OR len >= 1024 AS closed FROM scored WHERE pos = 0
  UNION ALL
  SELECT s.doc_id, s.pos, f.chunk_idx + CAST(f.closed AS INT),
    CASE WHEN f.closed THEN 0 ELSE f.size END + s.len,
    s.sim < {threshold} OR CASE WHEN f.closed THEN 0 ELSE f.size END + s.len >= 1024
  FROM fold f JOIN scored s ON s.doc_id = f.doc_id AND s.pos = f.pos + 1)
"""


@query(
    "topic_chunk",
    with_(_SENTENCES, adjacent("a", "s", "doc_id", wrap=True), _FOLD.format(threshold=0.2), recursive=True)
    + """SELECT doc_id, CAST(chunk_idx AS BIGINT) AS chunk_idx,
           string_agg(sentence, ' ' ORDER BY pos) AS unofficial_text
         FROM fold JOIN scored USING (doc_id, pos) GROUP BY ALL""",
)
def topic_chunk(spark: SparkSession, sf: str) -> DataFrame:
    # Hashed word counts of short sentences are less alike than model vectors, hence
    # the lower threshold.
    d = wide_documents(spark, sf).select("doc_id", "text")
    return chunk(d, TopicChunker(MODEL, threshold=0.2)).select("doc_id", _long_idx(), "unofficial_text")


@query(
    "batch_chunk",
    with_(
        CORPUS_SQL,
        """bodies AS (
           SELECT doc_id, citation_en, 'en' AS chunk_language, unofficial_text_en AS text FROM corpus
             WHERE unofficial_text_en <> ''
           UNION ALL SELECT doc_id, citation_en, 'fr', unofficial_text_fr FROM corpus
             WHERE unofficial_text_fr <> '')""",
        naive_chunks("c", "bodies", cols="doc_id, citation_en, chunk_language"),
    )
    + "SELECT doc_id, citation_en, chunk_language, chunk_idx, chunk AS unofficial_text FROM c",
)
def batch_chunk(spark: SparkSession, sf: str) -> DataFrame:
    columns = ("doc_id", "citation_en", "unofficial_text_en", "unofficial_text_fr")
    bodies = unpivot_languages(corpus(spark, sf, wide=True).select(*columns), en_only=False)
    return chunk(bodies, NaiveChunker()).withColumn("chunk_idx", _long_idx())


@query(
    "attach_metadata",
    with_(naive_chunks("c", "documents"))
    + """SELECT doc_id, lang, source, n_chars, 'https://example.org/' || doc_id AS url_en, chunk_idx,
           md5(chunk) AS chunk_md5 FROM c""",
)
def attach_metadata(spark: SparkSession, sf: str) -> DataFrame:
    url = F.concat(F.lit("https://example.org/"), "doc_id")
    chunks = chunk(wide_documents(spark, sf).withColumn("url_en", url), NaiveChunker())
    return chunks.withColumns(
        {"chunk_idx": _long_idx(), "chunk_md5": F.md5("unofficial_text")}
    ).drop("unofficial_text")


@query(
    "whitespace_split",
    f"""SELECT doc_id, len(w) AS words, md5(array_to_string(w, '|')) AS words_md5
        FROM (SELECT doc_id, regexp_extract_all(text, '([^{WS}]+)[{WS}]', 1) AS w FROM documents)""",
)
def whitespace_split(spark: SparkSession, sf: str) -> DataFrame:
    split = wide_documents(spark, sf).select("doc_id", split_words(F.col("text")).alias("w"))
    return split.select(
        "doc_id",
        F.array_size("w").cast("long").alias("words"),
        F.md5(F.array_join("w", "|")).alias("words_md5"),
    )


@query("sentence_split", with_(_SENTENCES) + "SELECT doc_id, pos, sentence FROM s")
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    d = wide_documents(spark, sf)
    parts = d.select("doc_id", split_sentences(F.col("text")).alias("parts"))
    return explode_once(parts, "parts", "pos", "sentence").withColumn("pos", F.col("pos").cast("long"))


_BRACKETED = rf"[{WS}]\[(\p{{Nd}}+)\] "
_SPACED = rf"[{WS}](\p{{Nd}}+) "
_ANY = rf"[{WS}]\[\p{{Nd}}+\] |[{WS}]\p{{Nd}}+ "


@query(
    "paragraph_markers",
    with_(NUMBERED_SQL)
    + f"""SELECT doc_id, CAST(generate_subscripts(m, 1) - 1 AS BIGINT) AS pos, unnest(m) AS marker
          FROM (SELECT doc_id, regexp_extract_all(text, '{_ANY}') AS m FROM numbered)""",
)
def paragraph_markers(spark: SparkSession, sf: str) -> DataFrame:
    found = parsing.markers(numbered_lines(spark, sf), KEY)
    return found.withColumn("pos", F.col("pos").cast("long"))


_STYLED = f"""styled AS (
  SELECT *, CASE WHEN len(m) = 0 THEN NULL WHEN contains(m[1], '[') THEN 'BRACKETED'
                 ELSE 'SPACE' END AS style,
    CASE WHEN regexp_matches(text, '{_BRACKETED}') THEN 'BRACKETED'
         WHEN regexp_matches(text, '{_SPACED}') THEN 'SPACE' END AS preferred
  FROM (SELECT *, regexp_extract_all(text, '{_ANY}') AS m FROM numbered WHERE text <> ''))"""


@query(
    "paragraph_style",
    with_(NUMBERED_SQL, _STYLED) + "SELECT doc_id, style, preferred FROM styled",
)
def paragraph_style(spark: SparkSession, sf: str) -> DataFrame:
    n = numbered_lines(spark, sf)
    first = parsing.styled(n).select("doc_id", "unofficial_text_en", "style")
    return parsing.styled(
        first.withColumnRenamed("style", "first_style"), prefer_bracketed=True
    ).select("doc_id", F.col("first_style").alias("style"), F.col("style").alias("preferred"))


@query(
    "paragraph_errors",
    with_(NUMBERED_SQL, _STYLED)
    + """SELECT citation_en, citation_fr, url_en, 'No paragraph markers found' AS error_message
         FROM styled WHERE style IS NULL""",
)
def paragraph_errors(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.paragraph_errors(numbered_lines(spark, sf))


@query(
    "paragraph_split",
    with_(
        NUMBERED_SQL,
        _STYLED,
        f"""cut AS (
          SELECT doc_id, style, string_split(CASE WHEN style = 'BRACKETED'
              THEN regexp_replace(text, '{_BRACKETED}', chr(1) || '\\1' || chr(2), 'g')
              ELSE regexp_replace(text, '{_SPACED}', chr(1) || '\\1' || chr(2), 'g') END, chr(1)) AS parts
          FROM styled WHERE style IS NOT NULL)""",
        """pieces AS (SELECT doc_id, style, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS pos,
             unnest(parts) AS part FROM cut)""",
    )
    + """SELECT doc_id, style, pos,
           CASE WHEN pos > 0 THEN string_split(part, chr(2))[1] END AS number,
           CASE WHEN pos > 0 THEN string_split(part, chr(2))[2] ELSE part END AS body FROM pieces""",
)
def paragraph_split(spark: SparkSession, sf: str) -> DataFrame:
    pieces = parsing.paragraphs(numbered_lines(spark, sf), KEY)
    return pieces.withColumn("pos", F.col("pos").cast("long"))


_HEADERS = """
SELECT doc_id, CAST(pos AS BIGINT) AS pos, label, value FROM (
  SELECT doc_id, 0 AS pos, 'Title' AS label, 'Title ' || doc_id AS value FROM documents WHERE lang = 'en'
  UNION ALL SELECT doc_id, 1, 'Collection', source FROM documents WHERE lang = 'en'
  UNION ALL SELECT doc_id, 2, 'Date', '2001-02-03' FROM documents WHERE lang = 'en'
  UNION ALL SELECT doc_id, 3, 'Neutral citation', '2001 X ' || doc_id FROM documents WHERE lang = 'en'
  UNION ALL SELECT doc_id, 4, 'Grounds', 'Race' || chr(10) || 'Religion' FROM documents WHERE lang = 'en'
  UNION ALL SELECT doc_id, 0, 'Citation', '2001 X ' || doc_id FROM documents WHERE lang = 'fr'
  UNION ALL SELECT doc_id, 1, 'Tribunal', source FROM documents WHERE lang = 'fr'
  UNION ALL SELECT doc_id, 2, 'Country', 'Mexico' FROM documents WHERE lang = 'fr'
  UNION ALL SELECT doc_id, 0, 'Private Proceeding / Huis clos', '' FROM documents WHERE lang = 'es'
  UNION ALL SELECT doc_id, 1, 'Panel', source FROM documents WHERE lang = 'es'
  UNION ALL SELECT doc_id, 2, 'Date of Decision', 'March 4, 2010' FROM documents WHERE lang = 'es')"""


@query("header_metadata", _HEADERS)
def header_metadata(spark: SparkSession, sf: str) -> DataFrame:
    entries = parsing.header_entries(headed_documents(spark, sf), KEY)
    return entries.withColumn("pos", F.col("pos").cast("long"))


# ---------------------------------------------------------------- sentence similarity


@query(
    "adjacent_similarity",
    with_(_SENTENCES, adjacent("a", "s", "doc_id", wrap=True))
    + "SELECT doc_id, pos, round(sim, 6) AS similarity FROM a",
)
def adjacent_similarity(spark: SparkSession, sf: str) -> DataFrame:
    d = wide_documents(spark, sf).select("doc_id", "text")
    return _rounded(adjacent_sims(d, MODEL))


@query(
    "adjacent_similarity_nowrap",
    with_(_SENTENCES, adjacent("a", "s", "doc_id", wrap=False))
    + "SELECT doc_id, pos, round(sim, 6) AS similarity FROM a",
)
def adjacent_similarity_nowrap(spark: SparkSession, sf: str) -> DataFrame:
    d = wide_documents(spark, sf).select("doc_id", "text")
    return _rounded(adjacent_sims(d, MODEL, wrap=False))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", F.col("pos").cast("long").alias("pos"), F.round("similarity", 6).alias("similarity")
    )


@query(
    "corpus_similarities",
    with_(_SENTENCES, adjacent("a", "s", "doc_id", wrap=True))
    + "SELECT round(sim, 6) AS similarities FROM a",
)
def corpus_similarities(spark: SparkSession, sf: str) -> DataFrame:
    sims = all_sims(wide_documents(spark, sf), MODEL)
    return sims.select(F.round("similarities", 6).alias("similarities"))
