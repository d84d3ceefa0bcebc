"""SQL building blocks of the oracles."""

from __future__ import annotations

from lexspan.functions.splitters import ABBREVIATIONS

WS = r"\t-\r\x1c-\x20\x{85}\p{Z}"
STEP, SIZE, DIM = 448, 512, 64


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"


def words(text: str) -> str:
    return f"regexp_extract_all({text}, '[^{WS}]+')"


def blank(text: str) -> str:
    return f"NOT regexp_matches({text}, '[^{WS}]')"


def naive_chunks(name: str, source: str, text: str = "text", cols: str = "*") -> str:
    """Fixed-size chunks of `source` as `chunk_idx`, `chunk`."""
    return f"""{name} AS (
  SELECT {cols}, CAST(i // {STEP} AS BIGINT) AS chunk_idx, substring({text}, i + 1, {SIZE}) AS chunk
  FROM {source}, unnest(range(0, CAST(length({text}) AS BIGINT), {STEP})) AS t(i))"""


def hash_vectors(name: str, source: str, key: str, text: str) -> str:
    """`{name}_n(key, b, c)`: word counts per bucket. `{name}(key, v, sq)`: vectors."""
    return f"""{name}_n AS (
  SELECT {key}, CAST(CAST('0x' || md5(w)[1:8] AS BIGINT) % {DIM} AS INT) AS b, count(*) AS c
  FROM (SELECT {key}, unnest({words(text)}) AS w FROM {source}) GROUP BY ALL),
{name} AS (
  SELECT {key}, list(coalesce(c, 0) ORDER BY b) AS v, CAST(sum(coalesce(c * c, 0)) AS BIGINT) AS sq
  FROM (SELECT {key}, CAST(b AS INT) AS b FROM {source}, unnest(range(0, {DIM})) AS t(b))
  LEFT JOIN {name}_n USING ({key}, b) GROUP BY {key})"""


def vector_text(v: str = "v") -> str:
    return f"array_to_string({v}, ',')"


def sentences(name: str, source: str, key: str, text: str) -> str:
    """Sentences by the splitting rule, as `pos` and `sentence`.

    Stops of abbreviations are masked, boundaries marked, and the mask undone.
    """
    abbreviations = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    mask = rf"(^|[^\p{{L}}\p{{N}}.])({abbreviations}|\p{{Lu}})\.([{WS}])"
    closers = r"""["''”’»)\]}]"""
    trimmed = rf"regexp_replace({text}, '^[{WS}]+|[{WS}]+\z', '', 'g')"
    once = rf"regexp_replace({trimmed}, '{mask}', '\1\2' || chr(1) || '\3', 'g')"
    twice = rf"regexp_replace({once}, '{mask}', '\1\2' || chr(1) || '\3', 'g')"
    marked = (
        rf"regexp_replace({twice}, '([.!?]{closers}{{0,4}})[{WS}]+', '\1' || chr(2), 'g')"
    )
    return f"""{name} AS (
  SELECT {key}, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS pos, unnest(parts) AS sentence
  FROM (SELECT {key}, list_filter(list_transform(string_split({marked}, chr(2)),
          lambda s: replace(s, chr(1), '.')), lambda s: s <> '') AS parts FROM {source}))"""


def adjacent(name: str, sentences_: str, key: str, wrap: bool) -> str:
    """Cosine of each sentence with the next of its text (`sim`)."""
    nxt = (
        f"coalesce(lead(v) OVER w, first(v) OVER p) AS nv, "
        f"coalesce(lead(sq) OVER w, first(sq) OVER p) AS nsq"
        if wrap
        else "lead(v) OVER w AS nv, lead(sq) OVER w AS nsq"
    )
    return (
        f"{name}_keyed AS (SELECT *, {key} || '/' || pos AS sid FROM {sentences_}),\n"
        + hash_vectors(f"{name}_vec", f"{name}_keyed", "sid", "sentence")
        + f""",
{name} AS (
  SELECT {key}, pos, sentence, list_dot_product(CAST(v AS DOUBLE[]), CAST(nv AS DOUBLE[]))
    / greatest(sqrt(sq) * sqrt(nsq), 1e-8) AS sim
  FROM (SELECT {key}, pos, sentence, v, sq, {nxt}
        FROM {name}_keyed JOIN {name}_vec USING (sid)
        WINDOW w AS (PARTITION BY {key} ORDER BY pos),
               p AS (PARTITION BY {key} ORDER BY pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
  WHERE nv IS NOT NULL)"""
    )


INDEX_SQL = (
    naive_chunks("ix_chunks", "documents", cols="doc_id, source")
    + """,
ix_docs AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents WHERE text <> ''),
ix AS (
  SELECT row_number() OVER (ORDER BY doc_id, chunk_idx) - 1 AS index_id,
    source || '_doc-' || ordinal || '_chunk-' || chunk_idx AS document_id,
    doc_id, source AS dataset, chunk_idx, chunk,
    'https://example.org/' || doc_id AS url_en,
    len("""
    + words("chunk")
    + """) AS num_tokens
  FROM ix_chunks JOIN ix_docs USING (doc_id)),
"""
    + hash_vectors("ix_vec", "ix", "index_id", "chunk")
)


def nearest(name: str, queries: str, metric: str = "l2", k: int = 5, index: str = "ix_vec") -> str:
    """The `k` nearest index rows of each query vector; `queries(query_id, v, sq)`."""
    score = (
        "q.sq + i.sq - 2 * d"
        if metric == "l2"
        else "1 - d / greatest(sqrt(q.sq) * sqrt(i.sq), 1e-8)"
    )
    return f"""{name} AS (
  SELECT query_id, index_id, CAST(distance AS DOUBLE) AS distance, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, index_id) - 1 AS rank
    FROM (SELECT q.query_id, i.index_id, {score} AS distance
          FROM {queries} q JOIN {index} i ON TRUE
          JOIN LATERAL (SELECT list_dot_product(CAST(q.v AS DOUBLE[]), CAST(i.v AS DOUBLE[])) AS d)
            ON TRUE))
  WHERE rank < {k})"""


QUESTIONS_SQL = (
    "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark),\n"
    + hash_vectors("asked_vec", "asked", "query_id", "query")
)
