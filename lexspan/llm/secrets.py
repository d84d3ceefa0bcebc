"""Secret scan: fixed patterns, and entropy within a sliding window of key-like strings.

Only built-in functions: a text is searched within its own row, nothing is shuffled. Positions
come from cutting the text at the matches: the lengths of the parts and matches add up to them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions.folds import scan

# Fixed patterns of the base scan. Of an assignment, the value is looked at after the match, as a
# short one uses up its text; runs of one class may ask for their length at once.
ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
BASE = (("assign", ASSIGN), ("access", "AKIA[A-Z0-9]{14,}"), ("hex", "[0-9a-f]{16,}"))
ASSIGNED = 12

# What looks like a key to a program, but is none: worked examples and fill-ins, runs of one
# character, counting or the alphabet, and paths of several steps. These last must be made of words:
# base64 holds slashes, too.
STEPS = r"/[^/]*/"
_WORD = r"^(?:[A-Za-z]|[A-Z]*+|[A-Z]?[a-z]++|(?:[A-Z]?[a-z]{2,}+)++)[0-9]*+$"
ALLOWED = (
    r"(?i)example|sample|placeholder|dummy|change_?me|your[_-]|xxxx|lorem",
    r"(.)\1{5}",
    r"(?i)0123456|1234567|abcdefg",
    STEPS,
)
_FIRST, _LAST = ord("+"), ord("z")


@dataclass(frozen=True)
class Entropy:
    """Parameters of the entropy scan.

    A candidate is a run of at least `window` characters of keys, with a digit and a letter. It is
    reported if the entropy of some window of it reaches the limit of its character class, in bits:
    `hex_bits` if all its letters are a to f, else `key_bits`. Windows that overlap a match of a
    pattern in `allowed` do not count. With `STEPS` among the patterns, a run of several steps is judged by each step, as a string
    of its own class, and as a whole only if some step is not made of words and numbers.
    """

    window: int = 20
    hex_bits: float = 3.0
    key_bits: float = 3.7
    allowed: tuple[str, ...] = ALLOWED

    def limit(self, bits: float) -> int:
        """The largest sum of c*log2(c) over character counts c that keeps the entropy at `bits`."""
        return math.floor((math.log2(self.window) - bits) * self.window * self.scale)

    @property
    def scale(self) -> int:
        return 1 << 20

    def terms(self) -> list[int]:
        """c*log2(c) for counts 0 to `window`, in fixed point: sums are exact in any order."""
        return [round(c * math.log2(c) * self.scale) if c else 0 for c in range(self.window + 2)]


def least_sum(codes: Column, how: Entropy) -> Column:
    """The least sum of c*log2(c) over all windows of `codes` (character numbers from 0).

    The window moves by one character at a time; only the counts of the characters that enter and
    leave change, and so do their two terms.
    """
    terms = F.lit(how.terms())
    size = _LAST - _FIRST + 1
    start = F.struct(
        F.array_repeat(F.lit(0), size).alias("counts"),
        F.lit(0).cast("bigint").alias("sum"),
        F.lit(None).cast("bigint").alias("least"),
    )

    def move(acc: Column, step: Column) -> Column:
        counts, enters, leaves = acc["counts"], step["enters"], step["leaves"]
        before = counts[enters]
        grown = acc["sum"] + terms[before + 1] - terms[before]
        held = counts[leaves] + F.when(leaves == enters, 1).otherwise(0)
        total = F.when(leaves.isNull(), grown).otherwise(grown - terms[held] + terms[held - 1]).cast("bigint")
        shifted = F.transform(
            counts,
            lambda c, i: c
            + F.when(i == enters, 1).otherwise(0)
            - F.when(F.coalesce(i == leaves, F.lit(False)), 1).otherwise(0),
        )
        least = F.when(step["at"] >= how.window - 1, F.least(acc["least"], total)).otherwise(acc["least"])
        return F.struct(shifted.alias("counts"), total.alias("sum"), least.alias("least"))

    steps = F.transform(
        codes,
        lambda c, i: F.struct(
            c.alias("enters"),
            F.when(i >= how.window, codes[F.greatest(i - how.window, F.lit(0))]).alias("leaves"),
            i.alias("at"),
        ),
    )
    return F.aggregate(steps, start, move, lambda acc: acc["least"])


def has_entropy(candidate: Column, how: Entropy) -> Column:
    """Whether a window of the string reaches the limit of its class. Null if it is no candidate."""
    rest = candidate  # with a blank for every allowed match
    for pattern in how.allowed:
        if pattern != STEPS:
            rest = F.regexp_replace(rest, pattern, " ")

    def mixed(x: Column) -> Column:
        return x.rlike("[0-9]") & x.rlike("[A-Za-z]")

    def limit(x: Column) -> Column:
        return F.when(x.rlike("^[0-9a-fA-F ]+$"), how.limit(how.hex_bits)).otherwise(how.limit(how.key_bits))

    def reaches(string: Column, most: Column) -> Column:
        def piece(x: Column) -> Column:
            codes = F.transform(
                F.sequence(F.lit(1), F.length(x)), lambda i: F.ascii(F.substr(x, i, F.lit(1))) - _FIRST
            )
            return F.when(F.length(x) >= how.window, least_sum(codes, how) <= most).otherwise(False)

        return F.exists(F.split(string, " "), piece)

    whole = F.when(candidate.rlike("^[0-9a-fA-F]+$"), how.limit(how.hex_bits)).otherwise(how.limit(how.key_bits))
    found = reaches(rest, whole)
    if STEPS in how.allowed:
        steps = F.exists(F.split(rest, "/"), lambda x: mixed(x) & reaches(x, limit(x)))
        worded = F.forall(F.split(candidate, "[-_+/]+"), lambda x: x.rlike(_WORD))
        found = F.when(candidate.rlike(STEPS), F.when(steps, True).when(worded, False).otherwise(found)).otherwise(found)
    return F.when(mixed(candidate), found).otherwise(False)


_SPAN = "struct<start:int,kind:int,end:int>"


def _located(df: DataFrame, text: str, pattern: str, kind: int, into: str) -> DataFrame:
    """Add `into`: all matches in order as (start, kind, end); and `{into}_hits`, their texts."""
    hits, parts = f"{into}_hits", f"{into}_parts"
    df = df.withColumn(hits, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn(parts, F.when(F.size(hits) > 0, F.split(text, pattern, -1)))

    def step(state: Column, i: Column) -> tuple[dict[str, Column], Column, Column]:
        start = (state["at"] + F.length(F.col(parts)[i])).cast("int")
        end = (start + F.length(F.col(hits)[i])).cast("int")
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return {"at": end}, span, F.lit(True)

    spans = scan(F.size(hits), lambda i: i, {"at": F.lit(0)}, step, _SPAN)
    return df.withColumn(into, spans).drop(parts)


def _chosen(spans: str, keep: Column) -> Column:
    """The spans whose place in the array `keep` is true."""
    return F.transform(
        F.filter(F.arrays_zip(F.col(spans).alias("s"), keep.alias("k")), lambda z: z["k"]), lambda z: z["s"]
    )


def _written(spans: Column, kinds: list[str]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


KINDS = [*(kind for kind, _ in BASE), "entropy"]


def find_secrets(docs: DataFrame, text: str = "text", how: Entropy | None = None) -> DataFrame:
    """Add the secrets of every row's text.

    Adds n_assign, n_access, n_hex, n_entropy (long), base_spans and secrets: arrays of (start,
    kind, end) in code points, by start, then kind, kind being a place in `KINDS`; the first without
    the entropy scan. A null text is empty. Rows are searched each for itself, repeated or not;
    columns of `docs` named like an added one are replaced.
    """
    how = how or Entropy()
    df = docs.withColumn("_text", F.coalesce(text, F.lit("")))
    for k, (kind, pattern) in enumerate(BASE):
        df = _located(df, "_text", pattern, k, f"_{kind}")
    values = F.when(
        F.size("_assign_hits") > 0, F.regexp_extract_all("_text", F.lit(ASSIGN), F.lit(2))
    ).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("_assign", _chosen("_assign", F.transform(values, lambda v: F.length(v) >= ASSIGNED)))
    df = df.withColumns({f"n_{kind}": F.size(f"_{kind}").cast("bigint") for kind, _ in BASE})
    df = _located(df, "_text", f"[A-Za-z0-9+/_-]{{{how.window},}}", len(BASE), "_entropy")
    keep = F.transform("_entropy_hits", lambda c: has_entropy(c, how))
    df = df.withColumn("_entropy", _chosen("_entropy", keep)).withColumn("n_entropy", F.size("_entropy").cast("bigint"))
    base = [F.col(f"_{kind}") for kind, _ in BASE]
    return (
        df.withColumn("base_spans", F.array_sort(F.concat(*base)))
        .withColumn("secrets", F.array_sort(F.concat(*base, F.col("_entropy"))))
        .drop("_text", "_entropy", "_entropy_hits", *[f"_{k}{x}" for k, _ in BASE for x in ("", "_hits")])
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping ones, replaced by `mark`."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        out = F.when(s["start"] >= acc["at"], F.array_append(acc["out"], piece)).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    whole = F.aggregate(
        spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1))
    )
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_secrets(docs).select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(_written(F.col("base_spans"), KINDS), 256).alias("base_sha256"),
        _written(F.col("secrets"), KINDS).alias("spans"),
        "n_entropy",
    )
