"""Time the headline jobs and print one line of JSON.

Each job is run once to warm up and then `BENCH_RUNS` times; the best time counts. The
result is consumed by a `noop` write, so nothing is left out by the optimizer.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from catalog.tables import KEY, MODEL, chunk_index, corpus, questions, table, wide_documents  # noqa: E402
from lexspan.operators import ann, knn, metrics  # noqa: E402
from lexspan.operators.chunking import NaiveChunker, TopicChunker, chunk  # noqa: E402
from lexspan.operators.similarity import corpus_similarities  # noqa: E402
from lexspan.plans import indexing  # noqa: E402
from lexspan.plans.embedding import embed_dataset  # noqa: E402
from lexspan.plans.retrieval import embed_query, retrieve  # noqa: E402
from lexspan.session import build_session, pin, scratch_path  # noqa: E402

# Small enough to cut the questions of the bench into several slices.
BROADCAST_SLICE = 64 * 1024


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    texts = wide_documents(spark, sf).select("doc_id", "text")
    index = pin(chunk_index(spark, sf).select("index_id", "embedding"), "bench-index")
    asked = pin(embed_query(questions(spark, sf), MODEL), "bench-questions")
    centres = ann.train_centres(index, cells=64)
    celled = pin(ann.assign_cells(index, centres), "bench-cells")
    vectors = table(spark, sf, "embeddings")
    folder = scratch_path(spark, "bench-index")
    indexing.write_index(indexing.with_search_columns(chunk_index(spark, sf), centres), folder)
    records = indexing.read_index(spark, folder)
    written = records.select("index_id", "embedding", "cell")
    ids = knn.Columns("vec_id", "embedding", "vec_id", "embedding")

    jobs: dict[str, Callable[[], DataFrame]] = {
        "naive_chunk": lambda: chunk(texts, NaiveChunker()),
        "topic_chunk": lambda: chunk(texts, TopicChunker(MODEL)),
        "corpus_similarities": lambda: corpus_similarities(texts, MODEL),
        "avg_doc_words": lambda: metrics.avg_doc_words(corpus(spark, sf, wide=True)),
        "embed_dataset": lambda: embed_dataset(corpus(spark, sf, wide=True), KEY, MODEL),
        "create_index": lambda: chunk_index(spark, sf),
        "token_budget": lambda: indexing.numbered_chunks(
            corpus(spark, sf, wide=True).drop("unofficial_text_fr"), KEY, max_tokens=indexing.MAX_TOKENS
        ),
        "knn_batch": lambda: knn.knn_batch(index, asked),
        "knn_batch_slices": lambda: knn.knn_batch(index, asked, broadcast_bytes=BROADCAST_SLICE),
        "knn_written_cells": lambda: ann.knn_approx(written, asked, centres, nprobe=4),
        "retrieve": lambda: retrieve(records, questions(spark, sf), MODEL),
        "knn_cosine": lambda: knn.knn_batch(index, asked, metric=knn.COSINE),
        "knn_all_vectors": lambda: knn.knn_batch(vectors, vectors, columns=ids),
        "knn_approx": lambda: ann.knn_approx(celled, asked, centres, nprobe=8),
    }
    times: dict[str, float] = {}
    for name, job in jobs.items():
        consume(job())
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            consume(job())
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)

    found = ann.recall(ann.knn_approx(celled, asked, centres, nprobe=8), knn.knn_batch(index, asked))
    chunks, n_topic = index.count(), chunk(texts, TopicChunker(MODEL)).count()
    n_questions = asked.count()
    rates = {
        "naive_chunks_per_sec": round(chunk(texts, NaiveChunker()).count() / times["naive_chunk"]),
        "topic_chunks_per_sec": round(n_topic / times["topic_chunk"]),
        "indexed_chunks_per_sec": round(chunks / times["create_index"]),
        "exact_queries_per_sec": round(n_questions / times["knn_batch"]),
        "approx_queries_per_sec": round(n_questions / times["knn_approx"]),
        "approx_recall_at_5": round(found.agg(F.first("recall")).first()[0], 4),
    }
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rates": rates,
                "sf": Path(sf).name,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
