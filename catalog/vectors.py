"""Embedding, vector search, indexing, profiles, streaming and validation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.sql import (
    DIM,
    INDEX_SQL,
    QUESTIONS_SQL,
    hash_vectors,
    naive_chunks,
    nearest,
    vector_text,
    with_,
    words,
)
from catalog.tables import (
    CORPUS_SQL,
    KEY,
    MODEL,
    chunk_index,
    corpus,
    documents,
    questions,
    table,
    whole_numbers,
    wide_documents,
)
from lexspan.functions import vectors as vx
from lexspan.functions.text import document_key, word_count
from lexspan.operators import ann, embedding, graph, knn, metrics, pq, pruned
from lexspan.operators.arrow import to_matrix
from lexspan.operators.chunking import NaiveChunker, chunk
from lexspan.operators.models import BATCH_SIZE, SHARDED_BATCH_SIZE, DummyModel
from lexspan.operators.ordinals import running_totals
from lexspan.operators.tokenizers import BatchTokenizer
from lexspan.plans import indexing, validation
from lexspan.plans.embedding import chunk_dataset
from lexspan.plans.embedding import embed_dataset as embed_corpus
from lexspan.plans.retrieval import embed_query as embed_questions
from lexspan.plans.retrieval import retrieve as retrieve_chunks
from lexspan.plans.segments import SegmentedIndex
from lexspan.session import pin, scratch_path
from lexspan.sources.writers import report_lines, save_report
from lexspan.streaming.ingest import document_stream, read_ingested
from lexspan.streaming.ingest import stream_ingest as ingest

VECTOR_IDS = knn.Columns(index_id="vec_id")


def _long(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk(wide_documents(spark, sf).select("doc_id", "text"), NaiveChunker())


# ---------------------------------------------------------------- embedding

_CHUNK_SQL = naive_chunks("c", "documents", cols="doc_id")
_KEYED_CHUNKS = f"{_CHUNK_SQL},\nkeyed AS (SELECT *, doc_id || '/' || chunk_idx AS cid FROM c)"


@query(
    "embed_chunks",
    with_(_KEYED_CHUNKS, hash_vectors("h", "keyed", "cid", "chunk"))
    + f"SELECT doc_id, chunk_idx, {vector_text()} AS embedding FROM keyed JOIN h USING (cid)",
)
def embed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    embedded = embedding.embed(_chunks(spark, sf), MODEL, "unofficial_text")
    return embedded.select("doc_id", _long("chunk_idx"), whole_numbers().alias("embedding"))


@query(
    "encode_batch_size",
    with_(_CHUNK_SQL)
    + f"""SELECT CAST(size AS BIGINT) AS batch_size, count(*) AS texts,
            CAST(ceil(count(*) / size) AS BIGINT) AS calls
          FROM c, (VALUES ({BATCH_SIZE}), ({SHARDED_BATCH_SIZE})) t(size) GROUP BY size""",
)
def encode_batch_size(spark: SparkSession, sf: str) -> DataFrame:
    def planned(size: int) -> DataFrame:
        calls = embedding.planned_calls(_chunks(spark, sf), size)
        return calls.select(F.lit(size).cast("long").alias("batch_size"), "texts", "calls")

    return planned(BATCH_SIZE).unionByName(planned(SHARDED_BATCH_SIZE))


@query(
    "dummy_embedding",
    """SELECT doc_id, CAST(1024 AS BIGINT) AS dim, CAST(1024.0 AS DOUBLE) AS total FROM documents
       WHERE text IS NOT NULL""",
)
def dummy_embedding(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).where(F.col("text").isNotNull())
    embedded = embedding.embed(d, DummyModel(), "text")
    total = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x)
    return embedded.select(
        "doc_id", F.array_size("embedding").cast("long").alias("dim"), total.alias("total")
    )


@query(
    "shard_texts",
    "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 4 AS BIGINT) AS shard FROM documents",
)
def shard_texts(spark: SparkSession, sf: str) -> DataFrame:
    places = running_totals(documents(spark, sf), KEY, {"place": F.lit(1)})
    return places.select("doc_id", embedding.shard_of(F.col("place"), 4).alias("shard"))


@query("call_count")
def call_count(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of one run; how many depends on the partitions, so there is no SQL."""
    counter = embedding.CallCounter(spark)
    embedded = embedding.embed(_chunks(spark, sf), MODEL, "unofficial_text", counter=counter)
    run = embedded.agg(F.count("embedding").alias("texts"))
    texts = run.first()["texts"]
    return spark.createDataFrame([(texts, counter.value)], "texts long, calls long")


@query(
    "check_dimension",
    """SELECT vec_id, CAST(len(embedding) AS BIGINT) AS dim, CAST(128 AS BIGINT) AS expected_dim
       FROM embeddings WHERE len(embedding) <> 128""",
)
def check_dimension(spark: SparkSession, sf: str) -> DataFrame:
    wrong = embedding.dimension_errors(table(spark, sf, "embeddings"), 128)
    return wrong.select(
        "vec_id", F.array_size("embedding").cast("long").alias("dim"), _long("expected_dim")
    )


@query(
    "token_count",
    with_(_CHUNK_SQL) + f"SELECT doc_id, chunk_idx, len({words('chunk')}) AS tokens FROM c",
)
def token_count(spark: SparkSession, sf: str) -> DataFrame:
    tokens = word_count(F.col("unofficial_text")).cast("long").alias("tokens")
    return _chunks(spark, sf).select("doc_id", _long("chunk_idx"), tokens)


def _visible() -> Callable[[list[str]], list[int]]:
    """A stand-in for a tokenizer of another library: a token for every visible character."""
    return lambda texts: [sum(map(len, t.split())) for t in texts]


@query(
    "token_count_plugged",
    with_(_CHUNK_SQL) + f"SELECT doc_id, chunk_idx, length(array_to_string({words('chunk')}, '')) AS tokens FROM c",
)
def token_count_plugged(spark: SparkSession, sf: str) -> DataFrame:
    tokens = BatchTokenizer(_visible).count(F.col("unofficial_text")).cast("long").alias("tokens")
    return _chunks(spark, sf).select("doc_id", _long("chunk_idx"), tokens)


@query(
    "token_roundtrip",
    with_(_CHUNK_SQL)
    + f"""SELECT doc_id, chunk_idx, array_to_string({words('chunk')}, ' ') = chunk AS matches FROM c""",
)
def token_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    same = embedding.token_roundtrip(F.col("unofficial_text")).alias("matches")
    return _chunks(spark, sf).select("doc_id", _long("chunk_idx"), same)


@query(
    "hash_embedding",
    with_(hash_vectors("h", "documents", "doc_id", "text"))
    + f"SELECT doc_id, {vector_text()} AS embedding FROM h",
)
def hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    d = wide_documents(spark, sf).select("doc_id", "text")
    return embedding.embed(d, MODEL, "text").select("doc_id", whole_numbers().alias("embedding"))


# ---------------------------------------------------------------- vector functions

_D = "CAST(embedding AS DOUBLE[])"
_R = "list_reverse(CAST(embedding AS DOUBLE[]))"


@query(
    "cosine",
    f"""SELECT vec_id, round(list_dot_product({_D}, {_R})
          / greatest(sqrt(list_dot_product({_D}, {_D})) * sqrt(list_dot_product({_R}, {_R})), 1e-8), 6)
          AS cosine FROM embeddings""",
)
def cosine(spark: SparkSession, sf: str) -> DataFrame:
    value = vx.cosine(F.col("embedding"), F.reverse("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(value, 6).alias("cosine"))


@query(
    "l2_squared",
    f"""SELECT vec_id, round(list_sum(list_transform(list_zip({_D}, {_R}),
          lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS distance FROM embeddings""",
)
def l2_squared(spark: SparkSession, sf: str) -> DataFrame:
    value = vx.l2_squared(F.col("embedding"), F.reverse("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", F.round(value, 6).alias("distance"))


# ---------------------------------------------------------------- nearest neighbours

# The stand-in model gives every question the vector of ones.
_ONES = [1.0] * DIM
_ONES_SQL = """scored AS (
  SELECT vec_id, label, list_sum(list_transform(embedding,
    lambda x: (x::DOUBLE - 1) * (x::DOUBLE - 1))) AS distance FROM embeddings),
hits AS (
  SELECT *, row_number() OVER (ORDER BY distance, vec_id) - 1 AS rank FROM scored
  ORDER BY distance, vec_id LIMIT 5)"""


def _near_ones(spark: SparkSession, sf: str) -> DataFrame:
    return knn.knn_exact(table(spark, sf, "embeddings"), _ONES, columns=VECTOR_IDS)


@query(
    "knn_exact",
    with_(_ONES_SQL) + "SELECT vec_id, round(distance, 6) AS distance, rank FROM hits",
)
def knn_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _near_ones(spark, sf).select(
        "vec_id", F.round("distance", 6).alias("distance"), _long("rank")
    )


@query(
    "knn_lookup_ranked",
    with_(_ONES_SQL)
    + """SELECT vec_id, label, rank, round(distance, 6) AS distance,
           array_to_string(list_transform(embedding, lambda x: (x > 0)::INT), '') AS signs
         FROM hits JOIN (SELECT vec_id, embedding FROM embeddings) USING (vec_id)""",
)
def knn_lookup_ranked(spark: SparkSession, sf: str) -> DataFrame:
    hits = _near_ones(spark, sf).select(F.col("vec_id").alias("index_id"), "rank", "distance")
    found = knn.lookup_ranked(hits, table(spark, sf, "embeddings"), "vec_id")
    return found.select(
        "vec_id", "label", _long("rank"), F.round("distance", 6).alias("distance"), _signs()
    )


@query(
    "knn_lookup_filter",
    with_(_ONES_SQL)
    + """SELECT vec_id, label,
           array_to_string(list_transform(embedding, lambda x: (x > 0)::INT), '') AS signs
         FROM embeddings WHERE vec_id IN (SELECT vec_id FROM hits)""",
)
def knn_lookup_filter(spark: SparkSession, sf: str) -> DataFrame:
    hits = _near_ones(spark, sf).select(F.col("vec_id").alias("index_id"))
    return knn.lookup_filter(hits, table(spark, sf, "embeddings"), "vec_id").select(
        "vec_id", "label", _signs()
    )


def _signs() -> Column:
    signs = F.transform("embedding", lambda x: (x > 0).cast("int").cast("string"))
    return F.array_join(signs, "").alias("signs")


def _question_hits(spark: SparkSession, sf: str, metric: str = knn.L2) -> DataFrame:
    asked = embed_questions(questions(spark, sf), MODEL)
    return knn.knn_batch(chunk_index(spark, sf), asked, metric=metric)


def _hit_columns(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", "index_id", F.round("distance", 6).alias("distance"), _long("rank")
    )


@query(
    "knn_batch",
    with_(INDEX_SQL, QUESTIONS_SQL, nearest("hits", "asked_vec"))
    + "SELECT query_id, index_id, round(distance, 6) AS distance, rank FROM hits",
)
def knn_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _hit_columns(_question_hits(spark, sf))


@query(
    "knn_cosine",
    with_(INDEX_SQL, QUESTIONS_SQL, nearest("hits", "asked_vec", metric="cosine"))
    + "SELECT query_id, index_id, round(distance, 6) AS distance, rank FROM hits",
)
def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _hit_columns(_question_hits(spark, sf, knn.COSINE))


def _written_cells(spark: SparkSession, sf: str) -> tuple[DataFrame, np.ndarray]:
    """The index as a user has it: cells trained, vectors assigned, written and read."""
    vectors = pin(chunk_index(spark, sf).select("index_id", "embedding"), "vectors")
    centres = ann.train_centres(vectors, cells=32)
    path = scratch_path(spark, "cell-index")
    indexing.write_index(indexing.with_search_columns(vectors, centres), path)
    return indexing.read_index(spark, path), centres


@query("knn_approx")
def knn_approx(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of a search for few cells of a written index against the exact one."""
    stored, centres = _written_cells(spark, sf)
    asked = embed_questions(questions(spark, sf), MODEL)
    near = ann.knn_approx(stored, asked, centres, nprobe=8)
    return ann.recall(near, knn.knn_batch(stored, asked))


@query(
    "knn_approx_all_cells",
    with_(INDEX_SQL, QUESTIONS_SQL, nearest("hits", "asked_vec"))
    + "SELECT query_id, index_id, round(distance, 6) AS distance, rank FROM hits",
)
def knn_approx_all_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The search over every cell of a written index, which must equal the exact one."""
    stored, centres = _written_cells(spark, sf)
    asked = embed_questions(questions(spark, sf), MODEL)
    return _hit_columns(ann.knn_approx(stored, asked, centres, nprobe=len(centres)))


@query(
    "knn_pruned",
    with_(INDEX_SQL, QUESTIONS_SQL, nearest("hits", "asked_vec"))
    + "SELECT query_id, index_id, round(distance, 6) AS distance, rank FROM hits",
)
def knn_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """The exact search over a written index that leaves out cells which are too far away."""
    stored, centres = _written_cells(spark, sf)
    asked = embed_questions(questions(spark, sf), MODEL)
    return _hit_columns(pruned.knn_pruned(stored, asked, centres).hits)


_SEARCHED = """counted AS (SELECT (SELECT count(*) FROM asked) AS queries, (SELECT count(*) FROM ix) AS rows)
SELECT queries, least(rows, 5) * queries AS exact_hits, true AS recall_reached, true AS fewer_rows FROM counted"""


def _search_report(hits: DataFrame, exact: DataFrame, report: DataFrame, rows: int, least: float) -> DataFrame:
    """Recall against the exact hits, and whether less than all rows were compared for a query."""
    found = ann.recall(hits, exact)
    read = report.agg(F.count(F.lit(1)).alias("queries"), (F.avg("rows") < rows).alias("fewer_rows"))
    both = found.withColumn("_one", F.lit(1)).join(read.withColumn("_one", F.lit(1)), "_one")
    return both.select("queries", "exact_hits", (F.col("recall") >= least).alias("recall_reached"), "fewer_rows")


@query("knn_pruned_report", with_(INDEX_SQL, QUESTIONS_SQL) + "," + _SEARCHED)
def knn_pruned_report(spark: SparkSession, sf: str) -> DataFrame:
    stored, centres = _written_cells(spark, sf)
    asked = embed_questions(questions(spark, sf), MODEL)
    search = pruned.knn_pruned(stored, asked, centres)
    return _search_report(search.hits, knn.knn_batch(stored, asked), search.report, stored.count(), 1.0)


@query("knn_graph", with_(INDEX_SQL, QUESTIONS_SQL) + "," + _SEARCHED)
def knn_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The search over a neighbour graph against the exact one."""
    vectors = pin(chunk_index(spark, sf).select("index_id", "embedding"), "vectors")
    asked = pin(embed_questions(questions(spark, sf), MODEL), "asked")
    search = graph.knn_graph(graph.build_graph(vectors), asked)
    return _search_report(search.hits, knn.knn_batch(vectors, asked), search.report, vectors.count(), 0.95)


@query(
    "pq_codes",
    """WITH cut AS (
      SELECT vec_id, p, list_transform(embedding[p * 8 + 1:p * 8 + 8], lambda x: CAST(x AS DOUBLE)) AS x
      FROM embeddings, unnest(range(8)) AS t(p)),
    books AS (SELECT p, x AS c, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM cut
      WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 16))
    SELECT vec_id, string_agg(lower(printf('%02x', CAST(e AS INT))), '' ORDER BY p) AS code FROM (
      SELECT vec_id, p, arg_min(e, [list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))),
        CAST(e AS DOUBLE)]) AS e FROM cut JOIN books USING (p) GROUP BY vec_id, p) GROUP BY vec_id""",
)
def pq_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes by given codebooks: the parts of the first sixteen vectors."""
    vectors = table(spark, sf, "embeddings")
    first = vectors.orderBy("vec_id").limit(16).toArrow()
    books = to_matrix(first.column("embedding")).reshape(first.num_rows, 8, -1).transpose(1, 0, 2)
    return pq.encode(vectors, books).select("vec_id", F.lower(F.hex("code")).alias("code"))


@query(
    "knn_compressed",
    with_(INDEX_SQL, QUESTIONS_SQL)
    + """, counted AS (SELECT (SELECT count(*) FROM asked) AS queries, (SELECT count(*) FROM ix) AS rows)
    SELECT least(rows, 5) * queries AS exact_hits, true AS recall_reached, 16::BIGINT AS bytes_per_code,
      256::BIGINT AS bytes_per_vector FROM counted""",
)
def knn_compressed(spark: SparkSession, sf: str) -> DataFrame:
    """The search over compressed vectors against the exact one."""
    vectors = pin(chunk_index(spark, sf).select("index_id", "embedding"), "vectors")
    asked = pin(embed_questions(questions(spark, sf), MODEL), "asked")
    books = pq.train_codebooks(vectors, parts=16, entries=64)
    coded = pin(pq.encode(vectors, books).select("index_id", "code"), "codes")
    found = ann.recall(pq.knn_compressed(coded, vectors, asked, books), knn.knn_batch(vectors, asked))
    sizes = coded.agg(F.max(F.octet_length("code")).cast("long").alias("bytes_per_code"))
    width = vectors.agg((4 * F.max(F.size("embedding"))).cast("long").alias("bytes_per_vector"))
    joined = found
    for part in (sizes, width):
        joined = joined.withColumn("_one", F.lit(1)).join(part.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return joined.select("exact_hits", (F.col("recall") >= 0.95).alias("recall_reached"), "bytes_per_code", "bytes_per_vector")


@query(
    "embed_query",
    with_(QUESTIONS_SQL)
    + f"SELECT query_id, query, {vector_text()} AS embedding FROM asked JOIN asked_vec USING (query_id)",
)
def embed_query(spark: SparkSession, sf: str) -> DataFrame:
    return embed_questions(questions(spark, sf), MODEL).withColumn("embedding", whole_numbers())


_RETRIEVED = """found AS (
  SELECT h.query_id, q.query, h.rank, h.distance, ix.* FROM hits h
  JOIN ix USING (index_id) JOIN asked q USING (query_id))"""


def _stored_index(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "index")
    indexing.write_index(indexing.with_search_columns(chunk_index(spark, sf)), path)
    return indexing.read_index(spark, path)


@query(
    "retrieve",
    with_(INDEX_SQL, QUESTIONS_SQL, nearest("hits", "asked_vec"), _RETRIEVED)
    + """SELECT query_id, query, rank, round(distance, 6) AS distance, index_id, document_id, url_en,
           chunk AS unofficial_text_en FROM found""",
)
def retrieve(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieve_chunks(_stored_index(spark, sf), questions(spark, sf), MODEL)
    return found.select(
        "query_id",
        "query",
        _long("rank"),
        F.round("distance", 6).alias("distance"),
        "index_id",
        "document_id",
        "url_en",
        "unofficial_text_en",
    )


@query(
    "retrieval_report",
    with_(INDEX_SQL, QUESTIONS_SQL, nearest("hits", "asked_vec"), _RETRIEVED)
    + f"""SELECT query_id, rank, CASE WHEN rank = 0 THEN 'query: ' || query || chr(10)
            ELSE '' END || 'doc ' || rank || ': URL: ' || url_en || ' | ' || chunk || chr(10)
            || ' {"-" * 65}' || chr(10) AS line FROM found""",
)
def retrieval_report(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieve_chunks(_stored_index(spark, sf), questions(spark, sf), MODEL)
    lines = report_lines(found, F.col("query"), F.col("url_en"), F.col("unofficial_text_en"))
    path = scratch_path(spark, "report")
    save_report(lines, path)
    return spark.read.parquet(path).withColumn("rank", _long("rank"))


# ---------------------------------------------------------------- index building


@query(
    "create_index",
    with_(INDEX_SQL)
    + f"""SELECT index_id, document_id, chunk AS unofficial_text_en, {vector_text()} AS embedding,
            chunk_idx, num_tokens, doc_id, dataset, url_en FROM ix JOIN ix_vec USING (index_id)""",
)
def create_index(spark: SparkSession, sf: str) -> DataFrame:
    index = chunk_index(spark, sf)
    return index.withColumns({"embedding": whole_numbers(), "chunk_idx": _long("chunk_idx")})


@query("index_ids", with_(INDEX_SQL) + "SELECT index_id, document_id, doc_id, chunk_idx FROM ix")
def index_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = wide_documents(spark, sf).withColumnRenamed("text", "unofficial_text_en")
    chunks = indexing.numbered_chunk_ids(d, KEY)
    key = document_key(F.col("source"), F.col("doc_ordinal"), F.col("chunk_idx"))
    return chunks.select("index_id", key.alias("document_id"), "doc_id", _long("chunk_idx"))


@query("stored_index_ids", with_(INDEX_SQL) + "SELECT index_id, document_id, doc_id, chunk_idx, num_tokens FROM ix")
def stored_index_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).withColumnRenamed("text", "unofficial_text_en")
    chunks = indexing.numbered_chunks(d, None)
    key = document_key(F.col("source"), F.col("doc_ordinal"), F.col("chunk_idx"))
    return chunks.select("index_id", key.alias("document_id"), "doc_id", _long("chunk_idx"), "num_tokens")


@query(
    "token_budget",
    with_(INDEX_SQL)
    + """SELECT index_id, num_tokens, tokens_before FROM (
           SELECT index_id, num_tokens, CAST(coalesce(sum(num_tokens) OVER (ORDER BY index_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tokens_before FROM ix)
         WHERE tokens_before <= 100000""",
)
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    d = wide_documents(spark, sf).withColumnRenamed("text", "unofficial_text_en")
    chunks = indexing.numbered_chunks(d, KEY, max_tokens=indexing.MAX_TOKENS)
    return chunks.select("index_id", "num_tokens", "tokens_before")


# Documents gather in order until a request has 800 chunks.
_GATHERED = """sizes AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS place, count(*) AS n, min(index_id) AS first_id
  FROM ix GROUP BY doc_id),
gathered AS (
  SELECT place, n, first_id, n AS held, 0::BIGINT AS request_id FROM sizes WHERE place = 1
  UNION ALL
  SELECT s.place, s.n, s.first_id, CASE WHEN g.held >= 800 THEN s.n ELSE g.held + s.n END,
    g.request_id + CAST(g.held >= 800 AS BIGINT)
  FROM gathered g JOIN sizes s ON s.place = g.place + 1)"""


@query(
    "request_batches",
    with_(INDEX_SQL, _GATHERED, recursive=True)
    + """SELECT request_id, CAST(sum(n) AS BIGINT) AS chunks, count(*) AS documents, min(first_id) AS first_index_id
         FROM gathered GROUP BY request_id""",
)
def request_batches(spark: SparkSession, sf: str) -> DataFrame:
    d = wide_documents(spark, sf).withColumnRenamed("text", "unofficial_text_en")
    chunks = indexing.request_batches(indexing.numbered_chunk_ids(d, KEY))
    # Every document has a chunk zero, and one only.
    first = F.when(F.col("chunk_idx") == 0, 1)
    return chunks.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count(first).alias("documents"),
        F.min("index_id").alias("first_index_id"),
    )


@query(
    "build_index",
    with_(INDEX_SQL)
    + """SELECT index_id, document_id, round(sqrt(sq), 6) AS norm, CAST(0 AS INT) AS cell
         FROM ix JOIN ix_vec USING (index_id)""",
)
def build_index(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "index")
    indexing.write_index(indexing.with_search_columns(chunk_index(spark, sf)), path)
    built = indexing.read_index(spark, path)
    return built.select("index_id", "document_id", F.round("norm", 6).alias("norm"), "cell")


@query(
    "index_segments",
    with_(INDEX_SQL)
    + """SELECT index_id, document_id, md5(chunk) AS chunk_md5 FROM ix
         WHERE index_id % 7 <> 0 OR index_id % 14 = 0""",
)
def index_segments(spark: SparkSession, sf: str) -> DataFrame:
    """An index made by appending in three steps, removing, merging and replacing."""
    built = pin(chunk_index(spark, sf).drop("embedding"), "records")
    own = F.col("index_id")
    index = SegmentedIndex(spark, scratch_path(spark, "segments"))
    for step in range(3):
        index.append(built.where(own % 3 == step))
    index.remove(built.where(own % 7 == 0))
    index.merge()
    index.replace(built.where(own % 14 == 0))
    index.replace(built.where(own % 5 == 1).where(own % 7 != 0))
    return index.read().select("index_id", "document_id", F.md5("unofficial_text_en").alias("chunk_md5"))


_BODIES = """kept AS (
  SELECT *, row_number() OVER w - 1 AS doc_idx,
    row_number() OVER w - 1 AS doc_idx_en,
    CAST(coalesce(sum(CASE WHEN unofficial_text_fr <> '' THEN 1 ELSE 0 END) OVER b, 0) AS BIGINT)
      AS doc_idx_fr
  FROM corpus WHERE unofficial_text_en IS NOT NULL
    AND trim(unofficial_text_en, ' ' || chr(10)) <> ''
  WINDOW w AS (ORDER BY doc_id),
    b AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bodies AS (
  SELECT doc_id, dataset, citation_en, doc_idx, doc_idx_en, doc_idx_fr, 'en' AS chunk_language,
    unofficial_text_en AS text FROM kept
  UNION ALL
  SELECT doc_id, dataset, citation_en, doc_idx, doc_idx_en, doc_idx_fr, 'fr', unofficial_text_fr
  FROM kept WHERE unofficial_text_fr <> '')"""


@query(
    "embed_dataset",
    with_(
        CORPUS_SQL,
        _BODIES,
        naive_chunks("c", "bodies", cols="* EXCLUDE text"),
        "keyed AS (SELECT *, doc_id || chunk_language || chunk_idx AS cid FROM c)",
        hash_vectors("h", "keyed", "cid", "chunk"),
    )
    + f"""SELECT doc_id, dataset, citation_en, doc_idx, doc_idx_en, doc_idx_fr, chunk_language, chunk_idx,
            chunk AS unofficial_text, {vector_text()} AS embedding FROM keyed JOIN h USING (cid)""",
)
def embed_dataset(spark: SparkSession, sf: str) -> DataFrame:
    embedded = embed_corpus(corpus(spark, sf, wide=True), KEY, MODEL)
    return embedded.select(
        "doc_id",
        "dataset",
        "citation_en",
        "doc_idx",
        "doc_idx_en",
        "doc_idx_fr",
        "chunk_language",
        _long("chunk_idx"),
        "unofficial_text",
        whole_numbers().alias("embedding"),
    )


# ---------------------------------------------------------------- profiles


@query(
    "avg_doc_words",
    with_(CORPUS_SQL)
    + f"""SELECT dataset, round(avg(len({words('unofficial_text_en')})), 6) AS avg_words
          FROM corpus WHERE unofficial_text_en IS NOT NULL GROUP BY dataset""",
)
def avg_doc_words(spark: SparkSession, sf: str) -> DataFrame:
    profile = metrics.avg_doc_words(corpus(spark, sf, wide=True))
    return profile.withColumn("avg_words", F.round("avg_words", 6))


@query(
    "batch_text_metrics",
    with_(
        CORPUS_SQL,
        """placed AS (
          SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS row_idx,
            coalesce(trim(unofficial_text_en, ' ' || chr(10)) <> '', false) AS kept FROM corpus)""",
        f"""measured AS (
          SELECT *, CAST(sum(CAST(kept AS INT)) OVER (ORDER BY row_idx) AS BIGINT) AS so_far,
            CASE WHEN kept THEN 1 + CAST(coalesce(unofficial_text_fr <> '', false) AS INT) ELSE 0 END AS n,
            CASE WHEN kept THEN length(unofficial_text_en)
              + coalesce(length(unofficial_text_fr), 0) ELSE 0 END AS chars,
            CASE WHEN kept THEN len({words('unofficial_text_en')})
              + coalesce(len({words('unofficial_text_fr')}), 0) ELSE 0 END AS words FROM placed)""",
    )
    + """SELECT CAST(row_idx // 32 AS BIGINT) AS batch_id, count(*) AS batch_rows,
           CAST(sum(n) AS BIGINT) AS texts, CAST(sum(chars) AS BIGINT) AS chars,
           CAST(sum(words) AS BIGINT) AS words, max(so_far) AS documents_so_far
         FROM measured GROUP BY 1""",
)
def batch_text_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.batch_text_metrics(corpus(spark, sf, wide=True), KEY)


@query(
    "batch_chunk_counts",
    with_(CORPUS_SQL, _BODIES, naive_chunks("c", "bodies", cols="doc_idx"))
    + "SELECT CAST(doc_idx // 32 AS BIGINT) AS batch_id, count(*) AS chunks FROM c GROUP BY 1",
)
def batch_chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.batch_chunk_counts(chunk_dataset(corpus(spark, sf, wide=True), KEY))


# ---------------------------------------------------------------- streaming


@query(
    "stream_ingest",
    with_(_KEYED_CHUNKS, hash_vectors("h", "keyed", "cid", "chunk"))
    + f"""SELECT doc_id, chunk_idx, chunk AS unofficial_text, {vector_text()} AS embedding
          FROM keyed JOIN h USING (cid)""",
)
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    arriving, saved = scratch_path(spark, "arriving"), scratch_path(spark, "ingested")
    # Several batches of several files: a file for every core, or for every task of the scan if those are more,
    # so that no file grows with the table.
    d = documents(spark, sf).select("doc_id", "text")
    batches, cores = 4, spark.sparkContext.defaultParallelism
    per_batch = max(cores, -(-d.rdd.getNumPartitions() // batches))
    d.repartition(batches * per_batch, "doc_id", "text").write.parquet(arriving)
    stream = document_stream(spark, arriving, d.schema, per_batch)
    ingest(stream, MODEL, saved, scratch_path(spark, "progress")).awaitTermination()
    return read_ingested(spark, saved).select(
        "doc_id", _long("chunk_idx"), "unofficial_text", whole_numbers().alias("embedding")
    )


# ---------------------------------------------------------------- retrieval validation

_SAMPLE = """sampled AS (
  SELECT *, row_number() OVER (ORDER BY md5('42|' || index_id), index_id) - 1 AS sample_idx
  FROM ix ORDER BY md5('42|' || index_id), index_id LIMIT 100)"""


def _sample(index: DataFrame) -> DataFrame:
    return validation.validation_sample(index.drop("embedding"), ["index_id"])


@query(
    "validation_sample",
    with_(INDEX_SQL, _SAMPLE)
    + "SELECT sample_idx, index_id, document_id, chunk AS unofficial_text_en FROM sampled",
)
def validation_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _sample(chunk_index(spark, sf)).select(
        _long("sample_idx"), "index_id", "document_id", "unofficial_text_en"
    )


@query(
    "validation_prompts",
    with_(INDEX_SQL, _SAMPLE)
    + "SELECT index_id, '"
    + validation.PROMPT.replace("'", "''")
    .replace("{num_queries}", "5")
    .replace("{document_text}", "' || chunk || '")
    + "' AS prompt FROM sampled",
)
def validation_prompts(spark: SparkSession, sf: str) -> DataFrame:
    prompts = validation.validation_prompts(_sample(chunk_index(spark, sf)), "unofficial_text_en")
    return prompts.select("index_id", "prompt")


def _replies(sample: DataFrame) -> DataFrame:
    """Stand-in replies: the lines of the chunk as questions; those for a first chunk
    lack the closing bracket."""
    lines = F.to_json(F.split("unofficial_text_en", "\n"))
    broken = F.regexp_replace(lines, r"\]\z", "")
    return sample.select(
        "index_id", F.when(F.col("chunk_idx") == 0, broken).otherwise(lines).alias("reply")
    )


_QUERIES = """lines AS (
  SELECT index_id, CAST(generate_subscripts(items, 1) - 1 AS BIGINT) AS query_pos, unnest(items) AS query
  FROM (SELECT index_id, string_split(chunk, chr(10)) AS items FROM sampled WHERE chunk_idx > 0))"""


@query(
    "validation_queries",
    with_(INDEX_SQL, _SAMPLE, _QUERIES)
    + """SELECT index_id, query_pos, query, NULL AS error_message FROM lines
         UNION ALL SELECT index_id, NULL, NULL, 'Reply is not a JSON list' FROM sampled
         WHERE chunk_idx = 0""",
)
def validation_queries(spark: SparkSession, sf: str) -> DataFrame:
    replies = _replies(_sample(chunk_index(spark, sf)))
    good, bad = validation.validation_queries(replies, ["index_id"])
    return (
        good.withColumn("query_pos", _long("query_pos"))
        .unionByName(bad.drop("reply"), allowMissingColumns=True)
        .select("index_id", "query_pos", "query", "error_message")
    )


@query(
    "retrieval_eval",
    with_(
        INDEX_SQL,
        _SAMPLE,
        _QUERIES,
        "q AS (SELECT *, index_id || '/' || query_pos AS query_id FROM lines)",
        hash_vectors("q_vec", "q", "query_id", "query"),
        nearest("hits", "q_vec"),
    )
    + """SELECT count(*) AS queries,
           round(avg(CASE WHEN h.rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall_at_k,
           round(avg(CASE WHEN h.rank IS NULL THEN 0.0 ELSE 1.0 / (h.rank + 1) END), 6) AS mrr
         FROM q LEFT JOIN hits h ON h.query_id = q.query_id AND h.index_id = q.index_id""",
)
def retrieval_eval(spark: SparkSession, sf: str) -> DataFrame:
    index = pin(chunk_index(spark, sf), "index")
    good, _ = validation.validation_queries(_replies(_sample(index)), ["index_id"])
    asked = good.select(
        F.concat_ws("/", "index_id", "query_pos").alias("query_id"), "index_id", "query"
    )
    hits = knn.knn_batch(index, embed_questions(asked, MODEL))
    scores = validation.retrieval_eval(hits, asked.select("query_id", "index_id"))
    return scores.select(
        "queries", F.round("recall_at_k", 6).alias("recall_at_k"), F.round("mrr", 6).alias("mrr")
    )
