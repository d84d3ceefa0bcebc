"""Scans, sinks, filters and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sql import (
    adjacent,
    hash_vectors,
    naive_chunks,
    sentences,
    with_,
    words,
)
from catalog.tables import (
    CORPUS_SQL,
    KEY,
    MODEL,
    NUMBERED_SQL,
    corpus,
    documents,
    numbered_lines,
    table,
    wide_documents,
)
from lexspan.functions import text as tx
from lexspan.functions.vectors import norm
from lexspan.operators import filters, sampling
from lexspan.operators.chunking import NaiveChunker, chunk
from lexspan.operators.embedding import embed
from lexspan.operators.ordinals import number_documents
from lexspan.operators.stored import number_stored_documents
from lexspan.operators.similarity import corpus_similarities
from lexspan.plans.embedding import chunk_dataset
from lexspan.plans.indexing import read_index, with_search_columns, write_index
from lexspan.plans.parsing import paragraph_errors
from lexspan.sources import corpus as src
from lexspan.sources import writers
from lexspan.session import pin, scratch_path

# ---------------------------------------------------------------- scans


@query("list_datasets", "SELECT DISTINCT source AS dataset FROM documents")
def list_datasets(spark: SparkSession, sf: str) -> DataFrame:
    return src.distinct_datasets(documents(spark, sf), "source")


@query("scan_dataset", "SELECT doc_id, source, text FROM documents WHERE source = 'src3'")
def scan_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return src.scan_table(documents(spark, sf), "src3", "source").select("doc_id", "source", "text")


@query("scan_all", "SELECT doc_id, source, lang, n_chars, text FROM documents")
def scan_all(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", "source", "lang", "n_chars", "text")


@query("count_rows", "SELECT count(*) AS n_rows FROM documents")
def count_rows(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"))


@query("read_whole_text", "SELECT item_id, text FROM benchmark")
def read_whole_text(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "texts")
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("value"))
    items.write.partitionBy("item_id").text(path)
    files = src.read_whole_text(spark, f"{path}/*")
    return files.select(
        F.regexp_extract("file_path", r"item_id=(\d+)", 1).cast("long").alias("item_id"),
        # The writer ends each file with a line feed.
        F.regexp_replace("text", r"\n\z", "").alias("text"),
    )


@query(
    "load_embeddings",
    """SELECT vec_id, label, len(embedding) AS dim,
         round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm
       FROM embeddings""",
)
def load_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return src.load_embeddings(spark, f"{sf}/embeddings.parquet").select(
        "vec_id",
        "label",
        F.array_size("embedding").cast("long").alias("dim"),
        F.round(norm(F.col("embedding")), 6).alias("norm"),
    )


# ---------------------------------------------------------------- sinks


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = wide_documents(spark, sf).select("doc_id", F.col("source").alias("dataset"), "text")
    return chunk(d, NaiveChunker())


@query(
    "save_chunks",
    with_(naive_chunks("c", "documents"))
    + "SELECT doc_id, source AS dataset, chunk_idx, chunk AS unofficial_text FROM c",
)
def save_chunks(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "chunks")
    writers.save_chunks(_chunks(spark, sf), path)
    saved = src.load_embeddings(spark, path)
    return saved.select("doc_id", "dataset", F.col("chunk_idx").cast("long"), "unofficial_text")


@query(
    "save_csv_sample",
    with_(
        naive_chunks("c", "documents", cols="doc_id"),
        "head AS (SELECT *, doc_id || '/' || chunk_idx AS cid FROM c ORDER BY doc_id, chunk_idx LIMIT 50)",
        hash_vectors("v", "head", "cid", "chunk"),
    )
    + """SELECT doc_id, chunk_idx, chunk AS unofficial_text,
           '[' || array_to_string(list_transform(v, lambda x: x || '.0'), ',') || ']' AS embedding
         FROM head JOIN v USING (cid)""",
)
def save_csv_sample(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    # The sample is taken from what was saved, so that the model runs once.
    embedded = embed(_chunks(spark, sf).drop("dataset"), MODEL, "unofficial_text")
    chunks = pin(embedded, "embedded")
    writers.save_csv_sample(chunks, path, ["doc_id", "chunk_idx"])
    return (
        spark.read.schema("doc_id long, chunk_idx long, unofficial_text string, embedding string")
        .options(header=True, multiLine=True, escape='"')
        .csv(path)
    )


_STEPS_SQL = (
    with_(
        CORPUS_SQL,
        "kept AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS doc_idx FROM corpus "
        "WHERE unofficial_text_en IS NOT NULL AND trim(unofficial_text_en, ' ' || chr(10)) <> '')",
        """bodies AS (SELECT doc_idx, unofficial_text_en AS text FROM kept UNION ALL
            SELECT doc_idx, unofficial_text_fr FROM kept WHERE unofficial_text_fr <> '')""",
        naive_chunks("c", "bodies", cols="doc_idx"),
    )
    + "SELECT CAST(doc_idx // 640 AS BIGINT) AS save_id, count(*) AS chunks FROM c GROUP BY 1"
)


@query("incremental_save", _STEPS_SQL)
def incremental_save(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "steps")
    writers.incremental_save(chunk_dataset(corpus(spark, sf), KEY), path)
    saved = spark.read.parquet(path)
    return saved.groupBy(F.col("save_id").cast("long")).agg(F.count(F.lit(1)).alias("chunks"))


@query("resumable_save", _STEPS_SQL)
def resumable_save(spark: SparkSession, sf: str) -> DataFrame:
    """The same steps, each finished by itself: a first run ends after one, a second does the rest."""
    path = scratch_path(spark, "resumed")
    numbered = pin(number_documents(corpus(spark, sf), KEY), "numbered")

    def chunks(part: DataFrame) -> DataFrame:
        return chunk(filters.unpivot_languages(part, en_only=False), NaiveChunker())

    writers.resumable_save(numbered.where("doc_idx < 640"), chunks, path)
    writers.resumable_save(numbered, chunks, path, at_once=64)
    saved = spark.read.parquet(path)
    return saved.groupBy(F.col("save_id").cast("long")).agg(F.count(F.lit(1)).alias("chunks"))


_PER_SOURCE = """sampled AS (
  SELECT source AS dataset, text,
    row_number() OVER (PARTITION BY source ORDER BY md5('423|' || doc_id), doc_id) - 1 AS sample_idx
  FROM documents)"""


@query(
    "export_text_samples",
    with_(_PER_SOURCE) + "SELECT dataset, sample_idx, text FROM sampled WHERE sample_idx < 5",
)
def export_text_samples(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "samples")
    d = documents(spark, sf).select("doc_id", F.col("source").alias("dataset"), "text")
    writers.export_text_samples(sampling.sample_per_dataset(d, KEY, n=5), path, "text")
    files = src.read_whole_text(spark, f"{path}/*/*")
    return files.select(
        F.regexp_extract("file_path", r"dataset=([^/]+)", 1).alias("dataset"),
        F.regexp_extract("file_path", r"sample_idx=(\d+)", 1).cast("long").alias("sample_idx"),
        F.regexp_replace("text", r"\n\z", "").alias("text"),
    )


_SENTENCES = sentences("s", "documents", "doc_id", "text")


@query(
    "save_similarities",
    with_(_SENTENCES, adjacent("a", "s", "doc_id", wrap=True))
    + "SELECT round(sim, 6) AS similarities FROM a",
)
def save_similarities(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "similarities")
    writers.save_similarities(corpus_similarities(wide_documents(spark, sf), MODEL), path)
    return spark.read.parquet(path).select(F.round("similarities", 6).alias("similarities"))


@query(
    "append_error_log",
    with_(NUMBERED_SQL)
    + r"""SELECT citation_en, citation_fr, url_en, 'No paragraph markers found' AS error_message
          FROM numbered WHERE text <> ''
          AND NOT regexp_matches(text, '[\t-\r\x1c-\x20\x{85}\p{Z}](\[\p{Nd}+\]|\p{Nd}+) ')""",
)
def append_error_log(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "errors")
    writers.append_error_log(paragraph_errors(numbered_lines(spark, sf)), path)
    return (
        spark.read.schema("citation_en string, citation_fr string, url_en string, error_message string")
        .options(header=True, escape='"')
        .csv(path)
    )


@query(
    "persist_index",
    """SELECT vec_id AS index_id, label AS cell,
         round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm
       FROM embeddings""",
)
def persist_index(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "index")
    vectors = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "index_id")
    index = with_search_columns(vectors).withColumn("cell", F.col("label"))
    write_index(index.drop("label"), path)
    return read_index(spark, path).select("index_id", "cell", F.round("norm", 6).alias("norm"))


# ---------------------------------------------------------------- filters and projections


@query(
    "drop_empty_text",
    with_(CORPUS_SQL)
    + """SELECT 'blank' AS mode, doc_id, unofficial_text_en FROM corpus
           WHERE trim(unofficial_text_en, ' ' || chr(10)) <> ''
         UNION ALL SELECT 'empty', doc_id, unofficial_text_en FROM corpus WHERE unofficial_text_en <> ''
         UNION ALL SELECT 'null', doc_id, unofficial_text_en FROM corpus
           WHERE unofficial_text_en IS NOT NULL""",
)
def drop_empty_text(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus(spark, sf).select("doc_id", "unofficial_text_en")
    kept = [
        filters.drop_empty_text(c, mode=m).select(F.lit(m).alias("mode"), "*")
        for m in ("blank", "empty", "null")
    ]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


@query(
    "skipped_audit",
    with_(CORPUS_SQL)
    + """SELECT doc_id, citation_en, name_en, strftime(document_date_en, '%Y-%m-%d') AS document_date_en,
           citation_fr, name_fr, strftime(document_date_fr, '%Y-%m-%d') AS document_date_fr
         FROM corpus WHERE unofficial_text_en IS NULL
           OR trim(unofficial_text_en, ' ' || chr(10)) = ''""",
)
def skipped_audit(spark: SparkSession, sf: str) -> DataFrame:
    skipped = filters.skipped_audit(corpus(spark, sf), "doc_id")
    return skipped.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd") for c in ("document_date_en", "document_date_fr")}
    )


@query(
    "project_metadata",
    with_(CORPUS_SQL)
    + """SELECT doc_id, dataset, citation_en, citation2_en, name_en,
           strftime(document_date_en, '%Y-%m-%d') AS document_date_en, url_en,
           strftime(document_date_en, '%Y-%m-%d') AS scraped_timestamp_en,
           citation_fr, CAST(NULL AS VARCHAR) AS citation2_fr, name_fr,
           strftime(document_date_fr, '%Y-%m-%d') AS document_date_fr, url_fr,
           strftime(document_date_fr, '%Y-%m-%d') AS scraped_timestamp_fr, upstream_license
         FROM corpus""",
)
def project_metadata(spark: SparkSession, sf: str) -> DataFrame:
    flat = filters.project_metadata(corpus(spark, sf))
    dates = [c for c in flat.columns if "date" in c or "timestamp" in c]
    return flat.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd") for c in dates if c != "dataset"}
    )


@query(
    "filter_datasets",
    "SELECT doc_id, source, text FROM documents WHERE source IN ('src1', 'src5', 'src7')",
)
def filter_datasets(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).select("doc_id", "source", "text")
    return filters.filter_datasets(d, ["src1", "src5", "src7"], "source")


@query(
    "filter_min_year",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders
       WHERE year(o_orderdate) >= 1996""",
)
def filter_min_year(spark: SparkSession, sf: str) -> DataFrame:
    kept = filters.filter_min_year(table(spark, sf, "orders"), 1996, "o_orderdate")
    return kept.select("o_orderkey", F.year("o_orderdate").cast("long").alias("year"))


_KEPT = """kept AS (SELECT * FROM corpus WHERE unofficial_text_en IS NOT NULL
  AND trim(unofficial_text_en, ' ' || chr(10)) <> '')"""


@query(
    "unpivot_languages",
    with_(CORPUS_SQL, _KEPT)
    + """SELECT doc_id, 'en' AS chunk_language, unofficial_text_en AS text FROM kept
         UNION ALL SELECT doc_id, 'fr', unofficial_text_fr FROM kept WHERE unofficial_text_fr <> ''""",
)
def unpivot_languages(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus(spark, sf).select("doc_id", "unofficial_text_en", "unofficial_text_fr")
    return filters.unpivot_languages(c)


_ORDINALS_SQL = (
    with_(CORPUS_SQL, _KEPT)
    + """SELECT doc_id, row_number() OVER w - 1 AS doc_idx,
           CAST(coalesce(sum(1) OVER b, 0) AS BIGINT) AS doc_idx_en,
           CAST(coalesce(sum(CASE WHEN unofficial_text_fr <> '' THEN 1 ELSE 0 END) OVER b, 0)
             AS BIGINT) AS doc_idx_fr
         FROM kept WINDOW w AS (ORDER BY doc_id),
           b AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)


@query("document_ordinals", _ORDINALS_SQL)
def document_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus(spark, sf).select("doc_id", "unofficial_text_en", "unofficial_text_fr")
    return number_documents(c, KEY).select("doc_id", "doc_idx", "doc_idx_en", "doc_idx_fr")


# The table is stored in the order of its key.
@query("stored_ordinals", _ORDINALS_SQL)
def stored_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    c = corpus(spark, sf).select("doc_id", "unofficial_text_en", "unofficial_text_fr")
    return number_stored_documents(c).select("doc_id", "doc_idx", "doc_idx_en", "doc_idx_fr")


@query(
    "sample_documents",
    "SELECT doc_id, text FROM documents ORDER BY md5('423|' || doc_id), doc_id LIMIT 25",
)
def sample_documents(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.sample_documents(documents(spark, sf).select("doc_id", "text"), KEY)


@query(
    "text_prefixes",
    """SELECT doc_id, i AS idx, substring(text, 1, CAST(50 * i AS BIGINT)) AS prefix,
         length(substring(text, 1, CAST(50 * i AS BIGINT))) AS chars
       FROM documents, unnest(range(1, 6)) AS t(i)""",
)
def text_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    cut = F.posexplode(filters.text_prefixes(F.col("text"))).alias("pos", "prefix")
    return documents(spark, sf).select("doc_id", cut).select(
        "doc_id",
        (F.col("pos") + 1).cast("long").alias("idx"),
        "prefix",
        F.length("prefix").cast("long").alias("chars"),
    )


# ---------------------------------------------------------------- scalar functions


@query("word_count", f"SELECT doc_id, len({words('text')}) AS words FROM documents")
def word_count(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        "doc_id", tx.word_count(F.col("text")).cast("long").alias("words")
    )


@query("char_count", "SELECT doc_id, length(text) AS chars FROM documents")
def char_count(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        "doc_id", tx.char_count(F.col("text")).cast("long").alias("chars")
    )


@query("slice", "SELECT doc_id, substring(text, 11, 50) AS part FROM documents")
def slice_(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", tx.slice_text(F.col("text"), 10, 60).alias("part"))


@query(
    "blank_test",
    with_(CORPUS_SQL)
    + "SELECT doc_id, trim(unofficial_text_en, ' ' || chr(10)) = '' AS is_blank FROM corpus",
)
def blank_test(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf).select(
        "doc_id", tx.is_blank(F.col("unofficial_text_en")).alias("is_blank")
    )


@query(
    "year_of",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders",
)
def year_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey", F.year("o_orderdate").cast("long").alias("year")
    )


@query("dataset_path", "SELECT source AS dataset, count(*) AS n_rows FROM documents GROUP BY 1")
def dataset_path(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "folders")
    documents(spark, sf).select("doc_id", "source").write.partitionBy("source").parquet(path)
    files = spark.read.parquet(path)
    return files.groupBy(src.dataset_of_path().alias("dataset")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@query(
    "document_key",
    with_(naive_chunks("c", "documents", cols="doc_id, source"))
    + "SELECT source || '_doc-' || doc_id || '_chunk-' || chunk_idx AS document_id FROM c",
)
def document_key(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select(
        tx.document_key(F.col("dataset"), F.col("doc_id"), F.col("chunk_idx")).alias("document_id")
    )


@query(
    "render_template",
    """SELECT doc_id, 'Read: ' || text || chr(10) || 'Ask {5} questions.' AS prompt FROM documents""",
)
def render_template(spark: SparkSession, sf: str) -> DataFrame:
    template = "Read: {document_text}\nAsk {{{num_queries}}} questions."
    return documents(spark, sf).select(
        "doc_id",
        tx.render_template(template, document_text=F.col("text"), num_queries=F.lit(5)).alias(
            "prompt"
        ),
    )


@query(
    "parse_json_list",
    """SELECT doc_id, CAST(generate_subscripts(items, 1) - 1 AS BIGINT) AS pos, unnest(items) AS item
       FROM (SELECT doc_id, string_split(text, chr(10)) AS items FROM documents WHERE lang <> 'de')
       UNION ALL SELECT doc_id, -1, NULL FROM documents WHERE lang = 'de'""",
)
def parse_json_list(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.to_json(F.split("text", "\n"))
    # German replies lack their closing bracket.
    reply = F.when(F.col("lang") == "de", F.regexp_replace(lines, r"\]\z", "")).otherwise(lines)
    parsed = documents(spark, sf).select("doc_id", tx.parse_json_list(reply).alias("items"))
    rows = parsed.select("doc_id", F.posexplode_outer("items").alias("pos", "item"))
    return rows.select("doc_id", F.coalesce("pos", F.lit(-1)).cast("long").alias("pos"), "item")
