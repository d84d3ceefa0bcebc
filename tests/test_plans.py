import csv
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lexspan.operators.chunking import NaiveChunker, TopicChunker, chunk
from lexspan.operators.embedding import CallCounter, embed
from lexspan.operators.models import HashModel
from lexspan.operators.tokenizers import BatchTokenizer
from lexspan.plans import indexing, validation
from lexspan.plans.embedding import embed_dataset
from lexspan.plans.retrieval import question_table, retrieve
from lexspan.session import shared_dir
from lexspan.sources import corpus as src
from lexspan.sources import writers
from lexspan.streaming.ingest import document_stream, read_ingested, stream_ingest

MODEL = HashModel(16)
WORDS = "court appeal tax claim order judge ruling".split()


def body(i):
    return " ".join(WORDS[(i * j) % 7] + ("." if j % 5 == 4 else "") for j in range(1, 20 + 9 * i))


def documents(spark, n=12):
    rows = [
        (f"d{i % 3}", i, None if i == 4 else "" if i == 5 else body(i), body(i + 1) if i % 4 == 0 else None, f"u{i}")
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "dataset string, k int, unofficial_text_en string, unofficial_text_fr string, url_en string"
    ).repartition(4)


def test_corpus_directory(spark, tmp_path):
    for name, columns in (("A", ["dataset", "t"]), ("B", ["dataset", "t", "more"]), (".hidden", ["dataset"])):
        rows = spark.range(3).select(*[F.lit(f"{name}-{c}").alias(c) for c in columns])
        rows.coalesce(1).write.parquet(str(tmp_path / name / "train.parquet"))
    (tmp_path / "file").write_text("not a dataset")
    base = src.Corpus(spark, str(tmp_path))
    assert base.dataset_names() == ["A", "B"]
    assert base.scan_dataset("A").count() == 3
    assert base.count_rows() == 6
    every = base.scan_all(merge_schemas=True)
    assert every.where("more is null").count() == 3
    assert sorted(r[0] for r in every.select(src.dataset_of_path()).distinct().collect()) == ["A", "B"]
    with pytest.raises(ValueError, match="no dataset called 'C'.*'A', 'B'"):
        base.scan_dataset("C")
    with pytest.raises(ValueError, match="no dataset called"):
        src.scan_table(every, "C")


def test_embedded_dataset(spark, tmp_path):
    got = embed_dataset(documents(spark), ["k"], MODEL, NaiveChunker(50, 10), partitions=3)
    rows = got.collect()
    kept = [i for i in range(12) if i not in (4, 5)]
    assert {r.k for r in rows} == set(kept)
    assert all(r.doc_idx == kept.index(r.k) for r in rows)
    french = {r.k for r in rows if r.chunk_language == "fr"}
    assert french == {0, 8}
    for k in kept:
        text = "".join(r.unofficial_text[:40] for r in sorted(
            (r for r in rows if r.k == k and r.chunk_language == "en"), key=lambda r: r.chunk_idx))
        assert text.startswith(body(k)[:40]) and len(text) >= len(body(k)) - 10
    assert got.columns[:2] == ["chunk_idx", "unofficial_text"] and got.columns[-1] == "embedding"

    path = str(tmp_path / "saved")
    writers.save_chunks(got, path)
    saved = src.load_embeddings(spark, path)
    assert saved.schema["dataset"].dataType.simpleString() == "string"
    assert saved.count() == len(rows)


def test_numeric_dataset_names_stay_strings(spark, tmp_path):
    path = str(tmp_path / "p")
    writers.save_chunks(spark.createDataFrame([("007", 1)], "dataset string, x int"), path)
    assert src.load_embeddings(spark, path).first()["dataset"] == "007"


@pytest.mark.parametrize("chunker", [NaiveChunker(60, 5), TopicChunker(MODEL, 0.5, 80)])
@pytest.mark.parametrize("budget", [None, 0, 100, 10**9])
def test_index_ids_and_budget(spark, chunker, budget):
    docs = documents(spark).drop("unofficial_text_fr")
    got = indexing.numbered_chunks(docs, ["k"], chunker, max_tokens=budget).orderBy("index_id").collect()
    plain = chunk(docs.where("unofficial_text_en <> ''"), chunker, "unofficial_text_en")
    want, used = [], 0
    for r in plain.orderBy("k", "chunk_idx").collect():
        if budget is not None and used > budget:
            break
        want.append((len(want), r.k, r.chunk_idx, r.unofficial_text, len(r.unofficial_text.split())))
        used += want[-1][-1]
    assert [(r.index_id, r.k, r.chunk_idx, r.unofficial_text_en, r.num_tokens) for r in got] == want


@pytest.mark.parametrize("chunker", [NaiveChunker(60, 5), TopicChunker(MODEL, 0.5, 80)])
def test_ids_without_texts(spark, chunker):
    docs = documents(spark).drop("unofficial_text_fr")
    whole = indexing.numbered_chunks(docs, ["k"], chunker)
    ids = indexing.numbered_chunk_ids(docs, ["k"], chunker)
    assert "unofficial_text_en" not in ids.columns
    assert sorted(map(str, ids.collect())) == sorted(map(str, whole.select(*ids.columns).collect()))


@pytest.mark.parametrize("budget", [None, 300])
def test_a_tokenizer_plugged_in(spark, budget):
    def make():
        return lambda texts: [len(t) for t in texts]

    docs = documents(spark).drop("unofficial_text_fr")
    own = BatchTokenizer(make)
    rows = indexing.numbered_chunks(docs, ["k"], NaiveChunker(60, 5), max_tokens=budget, tokenizer=own)
    rows = rows.orderBy("index_id").collect()
    assert rows and all(r.num_tokens == len(r.unofficial_text_en) for r in rows)
    if budget is not None:
        assert sum(r.num_tokens for r in rows[:-1]) <= budget
    counted = spark.createDataFrame([("abc",), (None,)], "t string").select(own.count(F.col("t"))).collect()
    assert [r[0] for r in counted] == [3, None]


def test_index_roundtrip_and_retrieval(spark, tmp_path):
    index = indexing.create_index(documents(spark), ["k"], MODEL, NaiveChunker(60, 5), ["d0", "d1"])
    path = str(tmp_path / "index")
    indexing.write_index(indexing.with_search_columns(index), path)
    stored = indexing.read_index(spark, path)
    assert {r.dataset for r in stored.select("dataset").distinct().collect()} == {"d0", "d1"}
    assert "unofficial_text_fr" not in stored.columns
    first = stored.where("index_id = 0").first()
    assert first.document_id == "d0_doc-0_chunk-0"
    asked = question_table(spark, [first.unofficial_text_en, "no such words"])
    hits = retrieve(stored, asked, MODEL, k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"]) for r in hits] == [(q, r) for q in (0, 1) for r in range(3)]
    assert hits[0].distance == 0 and hits[0].unofficial_text_en == first.unofficial_text_en
    lines = writers.report_lines(
        spark.createDataFrame(hits), F.col("query"), F.col("url_en"), F.col("unofficial_text_en")
    )
    report = str(tmp_path / "report")
    writers.save_report(lines, report)
    text = "".join(r.line for r in spark.read.parquet(report).where("query_id = 0").orderBy("rank").collect())
    assert text.startswith("query: ") and text.count("doc ") == 3
    assert text.index("doc 0: URL: ") < text.index("doc 1: URL: ") < text.index("doc 2: URL: ")


def test_request_batches_keep_documents_whole(spark):
    docs = documents(spark).drop("unofficial_text_fr")
    chunks = indexing.request_batches(indexing.numbered_chunks(docs, ["k"], NaiveChunker(20, 0)), 10)
    assert chunks.groupBy("k").agg(F.countDistinct("request_id").alias("n")).where("n > 1").count() == 0
    rows = chunks.orderBy("index_id").collect()
    assert [r.request_id for r in rows] == sorted(r.request_id for r in rows)


def test_csv_sample(spark, tmp_path):
    rows = [(i, f'say "{i}", then\nbreak ', [1.0, float(i)]) for i in range(80)]
    df = spark.createDataFrame(rows, "k int, t string, embedding array<float>").repartition(5)
    writers.save_csv_sample(df, str(tmp_path / "csv"), ["k"])
    [part] = (tmp_path / "csv").glob("*.csv")
    with part.open(newline="") as f:
        got = list(csv.DictReader(f))
    assert len(got) == 50
    assert got[7]["t"] == 'say "7", then\nbreak ' and json.loads(got[7]["embedding"]) == [1.0, 7.0]


def test_incremental_save_is_idempotent(spark, tmp_path):
    chunks = spark.range(100).select(F.col("id").alias("doc_idx"), F.lit("t").alias("text"))
    path = str(tmp_path / "steps")
    writers.incremental_save(chunks, path, batch_size=2, every=5)
    writers.incremental_save(chunks.where("doc_idx < 15"), path, batch_size=2, every=5)
    saved = spark.read.parquet(path)
    # Step 1 was saved again with half of its documents; the others were left alone.
    assert saved.groupBy("save_id").count().where("count <> 10").collect()[0]["count"] == 5
    assert saved.count() == 95


def test_resumed_save_calls_no_model_for_finished_ranges(spark, tmp_path):
    docs = spark.createDataFrame([(i, body(i)) for i in range(23)], "doc_idx long, text string")
    counter = CallCounter(spark)
    path, whole = str(tmp_path / "resumed"), str(tmp_path / "whole")

    def embedded(part, fails_at=None):
        first = part.agg(F.min("doc_idx")).first()[0]
        if first == fails_at:
            raise RuntimeError("killed")
        return embed(part, MODEL, "text", counter=counter)

    with pytest.raises(RuntimeError, match="killed"):
        writers.resumable_save(docs, lambda part: embedded(part, fails_at=10), path, batch_size=5, every=1)
    assert writers.finished_ranges(spark, path, 5) == {0, 1}
    counter.reset()
    assert writers.resumable_save(docs.where("doc_idx < 10"), embedded, path, batch_size=5, every=1) == []
    assert counter.value == 0
    assert writers.resumable_save(docs, embedded, path, batch_size=5, every=1) == [2, 3, 4]
    assert counter.value > 0
    assert writers.resumable_save(docs, embedded, whole, batch_size=5, every=1) == [0, 1, 2, 3, 4]
    rows = [sorted(map(tuple, spark.read.parquet(p).collect())) for p in (path, whole)]
    assert rows[0] == rows[1] and len(rows[0]) == 23
    with pytest.raises(ValueError, match="another size"):
        writers.resumable_save(docs, embedded, path, batch_size=6, every=1)


@pytest.mark.parametrize("at_once", [1, 4])
def test_steps_do_not_read_the_documents_of_others(spark, tmp_path, at_once):
    read = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(i):
        read.add(1)
        return i

    docs = spark.range(60).select(counted("id").alias("doc_idx"), F.lit("t").alias("text"))
    path = str(tmp_path / "steps")
    size = {"batch_size": 5, "every": 1} | ({"at_once": at_once} if at_once > 1 else {})
    assert writers.resumable_save(docs, lambda part: embed(part, MODEL, "text"), path, **size) == list(range(12))
    # To find the steps, to find the bounds of the ranges and to lay them out, the last two with a filter;
    # not once for every step.
    assert 0 < read.value <= 5 * 60
    saved = spark.read.parquet(path)
    assert saved.where(F.floor(F.col("doc_idx") / 5) == F.col("save_id")).count() == 60
    assert sorted(r.doc_idx for r in saved.collect()) == list(range(60))


def test_steps_saved_at_once_end_where_one_fails(spark, tmp_path):
    docs = spark.createDataFrame([(i, body(i)) for i in range(40) if not 10 <= i < 15], "doc_idx long, text string")
    path = str(tmp_path / "steps")

    def only(part, fails_at=None):
        bad = F.raise_error("killed").cast("string")
        kept = part.where((F.col("doc_idx") < 20) | (F.col("doc_idx") >= 25))  # no rows of step 4
        return kept.withColumn("text", F.when(F.col("doc_idx") == fails_at, bad).otherwise(F.col("text")))

    (tmp_path / "steps" / "save_id=4").mkdir(parents=True)
    docs.write.mode("overwrite").parquet(f"{path}/save_id=4")  # left by a run that was not finished
    size = {"batch_size": 5, "every": 1, "at_once": 8}
    with pytest.raises(Exception, match="killed"):
        writers.resumable_save(docs, lambda part: only(part, 28), path, **size)
    assert writers.finished_ranges(spark, path, 5) == {0, 1, 3, 4}
    assert writers.resumable_save(docs, only, path, **size) == [5, 6, 7]
    saved = spark.read.parquet(path)
    assert sorted(r.doc_idx for r in saved.collect()) == [*range(10), *range(15, 20), *range(25, 40)]
    assert saved.where(F.floor(F.col("doc_idx") / 5) != F.col("save_id")).isEmpty()
    assert (tmp_path / "steps" / "save_id=4").exists()
    # Rows that cannot be told apart by step are saved one step at a time.
    assert writers.resumable_save(docs.where("doc_idx < 3"), lambda p: p.drop("doc_idx"), path + "2", 1, 1, 3) == [0, 1, 2]
    assert spark.read.parquet(path + "2").groupBy("save_id").count().count() == 3


def test_text_export_and_error_log(spark, tmp_path):
    rows = spark.createDataFrame([("A", 0, "x\ny"), ("A", 1, None)], "dataset string, sample_idx int, t string")
    writers.export_text_samples(rows, str(tmp_path / "t"), "t")
    got = {r.file_path.split("/")[-2]: r.text for r in src.read_whole_text(spark, str(tmp_path / "t" / "*" / "*")).collect()}
    assert {k: v.strip() for k, v in got.items()} == {"sample_idx=0": "x\ny", "sample_idx=1": ""}
    errors = spark.createDataFrame([("a", "b")], "citation_en string, error_message string")
    for _ in range(2):
        writers.append_error_log(errors, str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 2


def test_streamed_files_do_not_grow_with_the_table(spark, tmp_path):
    docs = spark.createDataFrame([(None if i % 2 else i, f"text {i}") for i in range(600)], "doc_id long, text string")
    docs.repartition(60).write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # a task for every file
    folder = Path(shared_dir(spark).removeprefix("file:"))
    old = set(folder.iterdir())
    try:
        got = queries()["stream_ingest"](spark, str(tmp_path))
        assert got.select("unofficial_text").distinct().count() == 600
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    made = {p.name.split("-")[0]: p for p in folder.iterdir() if p not in old}
    sizes = [spark.read.parquet(str(p)).count() for p in made["arriving"].glob("part-*")]
    assert sum(sizes) == 600 and max(sizes) <= 40
    assert len(list(made["ingested"].glob("batch_id=*"))) == 4


def test_stream_equals_batch_and_restarts_without_duplicates(spark, tmp_path):
    docs = spark.createDataFrame([(i, body(i)) for i in range(9)], "k long, text string")
    arriving, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    docs.where("k < 6").repartition(3).write.parquet(arriving)

    def run():
        stream = document_stream(spark, arriving, docs.schema)
        stream_ingest(stream, MODEL, out, progress, chunker=NaiveChunker(40, 8)).awaitTermination()

    run()
    assert len(list((tmp_path / "out").iterdir())) == 3
    run()
    docs.where("k >= 6").coalesce(1).write.mode("append").parquet(arriving)
    run()
    got = read_ingested(spark, out).select("k", "chunk_idx", "unofficial_text")
    want = chunk(docs, NaiveChunker(40, 8)).select("k", "chunk_idx", "unofficial_text")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0

    # A batch that runs again overwrites its own folder.
    import shutil

    shutil.copytree(progress, tmp_path / "again")
    last = max((tmp_path / "again" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    progress = str(tmp_path / "again")
    run()
    assert read_ingested(spark, out).count() == want.count()


def test_validation(spark):
    chunks = spark.range(300).select(F.col("id").alias("index_id"), F.concat(F.lit("chunk {num_queries} "), "id").alias("t"))
    sample = validation.validation_sample(chunks, ["index_id"], 20)
    assert sorted(r.sample_idx for r in sample.collect()) == list(range(20))
    prompt = validation.validation_prompts(sample, "t").first()
    assert "Write 5 questions" in prompt.prompt and prompt.t in prompt.prompt
    replies = spark.createDataFrame([(1, '["a", "b"]'), (2, "sorry"), (3, "[]")], "index_id long, reply string")
    good, bad = validation.validation_queries(replies, ["index_id"])
    assert sorted((r.index_id, r.query_pos, r.query) for r in good.collect()) == [(1, 0, "a"), (1, 1, "b")]
    assert [(r.index_id, r.reply) for r in bad.collect()] == [(2, "sorry")]


def test_retrieval_scores(spark):
    hits = spark.createDataFrame(
        [("q1", 10, 0), ("q1", 11, 1), ("q2", 12, 0), ("q2", 13, 1), ("q3", 1, 0)],
        "query_id string, index_id long, rank int",
    )
    truth = spark.createDataFrame([("q1", 10), ("q2", 13), ("q3", 99), ("q4", 1)], "query_id string, index_id long")
    scores = validation.retrieval_eval(hits, truth, k=2).first()
    assert (scores.queries, scores.recall_at_k, scores.mrr) == (4, 0.5, (1 + 0.5) / 4)
    assert validation.retrieval_eval(hits, truth, k=1).first().recall_at_k == 0.25
