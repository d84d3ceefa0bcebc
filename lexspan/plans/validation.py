"""Build a retrieval-validation set and score retrieval with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexspan.functions.text import parse_json_list, render_template, sample_key
from lexspan.operators.explode import explode_once
from lexspan.operators.sampling import VALIDATION_SAMPLE, VALIDATION_SEED, sample_documents

# Fixed value: questions asked for per chunk.
QUERIES_PER_CHUNK = 5

# The wording is ours; a caller may pass any template with the same placeholders.
PROMPT = """You write test questions for a search engine over court decisions.

Read the passage between the lines. Write {num_queries} questions that a person who has
never seen it might ask, and that it answers. Give away no names, dates, citations or
quotations, and vary the kind of question: a situation, a concept, an outcome.

----------
{document_text}
----------

Reply with a JSON list of {num_queries} strings and nothing else.
"""


def validation_sample(
    chunks: DataFrame, keys: list[str], n: int = VALIDATION_SAMPLE, seed: int = VALIDATION_SEED
) -> DataFrame:
    """`n` chunks, numbered anew from zero in `sample_idx`."""
    order = W.orderBy(sample_key(seed, *[F.col(k) for k in keys]), *keys)  # over n rows
    sample = sample_documents(chunks, keys, n, seed)
    return sample.withColumn("sample_idx", F.row_number().over(order) - 1)


def validation_prompts(
    sample: DataFrame,
    text_col: str,
    template: str = PROMPT,
    num_queries: int = QUERIES_PER_CHUNK,
) -> DataFrame:
    """Add the `prompt` for each chunk."""
    prompt = render_template(
        template, document_text=F.col(text_col), num_queries=F.lit(num_queries)
    )
    return sample.withColumn("prompt", prompt)


def validation_queries(
    replies: DataFrame, keys: list[str], reply_col: str = "reply"
) -> tuple[DataFrame, DataFrame]:
    """Query-chunk pairs from model replies, and the replies that are not JSON lists."""
    parsed = replies.withColumn("_queries", parse_json_list(F.col(reply_col)))
    good = explode_once(parsed.select(*keys, "_queries"), "_queries", "query_pos", "query")
    bad = parsed.where(F.col("_queries").isNull()).select(
        *keys, reply_col, F.lit("Reply is not a JSON list").alias("error_message")
    )
    return good, bad


def retrieval_eval(hits: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """Recall at `k` and mean reciprocal rank of the source chunk of each query.

    `truth` has `query_id` and the `index_id` the query was made from; a query whose
    chunk was not found counts as zero.
    """
    found = hits.select("query_id", "index_id", (F.col("rank") + 1).alias("place"))
    scored = truth.join(found, ["query_id", "index_id"], "left")
    hit = (F.coalesce("place", F.lit(k + 1)) <= k).cast("double")
    return scored.agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg(hit).alias("recall_at_k"),
        F.avg(F.when(F.col("place") <= k, 1.0 / F.col("place")).otherwise(0.0)).alias("mrr"),
    )
