"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, so that a question asked again with other
values has the same template. Windows of template tokens are joined by hash; where they line up,
every placeholder must stand for one value throughout, or the match does not count. Windows of the
lower-case words and numbers as they stand find copies in another case, and of values only.

Only built-in functions. Document windows are made and probed within the scan: only windows that
are found in the benchmark are shuffled, by document and item.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm.text import places
from lexspan.session import pin

NUMBER, NAME, UNIT, END = "\x01", "\x02", "\x03", "\x04"

# Tokens of a text that are cut off as one block.
BLOCK = 512

# Units of measure and currency in English, German, French and Spanish.
UNITS = (
    "km m cm mm mi miles mile ft feet foot inches inch yards yard kg g mg lb lbs oz pounds pound tons ton "
    "l ml liters liter litres litre gallons gallon s sec seconds second min minutes minute h hours hour days day "
    "weeks week months month years year dollars dollar euros euro cents cent usd eur percent degrees "
    "meter metros litros horas stunden tage jahre heures jours ans"
).split()

# A capitalised word inside a sentence: behind a letter, comma or semicolon and one blank.
_NAME = r"\p{Lu}(?<=[\p{L},;]\x20.)[\p{L}\p{M}'’-]+"
_NUMBER = r"\d+(?:[.,:]\d+)*"
_UNIT = rf"({NUMBER}[^{END}]*{END})\s*({'|'.join(sorted(UNITS, key=len, reverse=True))})(?!\p{{L}})"
_WORD = r"[\p{L}\p{M}\p{N}]+"


@dataclass(frozen=True)
class Templates:
    """Parameters.

    width: tokens of a window; an item shorter than that is one window of its own length. For an item
    none of whose windows has enough literals it is doubled until one has.
    literals: least tokens of a window that are no placeholders.
    coverage: least share of an item's windows found in a document.
    consistency: least share of placeholder values that stand for one value.
    broadcast_rows: most benchmark windows that are sent to the tasks; more are joined by shuffle.
    """

    width: int = 8
    literals: int = 5
    coverage: float = 0.5
    consistency: float = 0.8
    broadcast_rows: int = 1_000_000


def _is_slot(token: Column) -> Column:
    """Placeholders begin with the three least characters."""
    return token < END


def add_template(df: DataFrame, text: str = "text") -> DataFrame:
    """Add `_raw`, the tokens of a text's template; a placeholder holds its value between its kind and `END`."""
    bare = F.translate(F.coalesce(text, F.lit("")), f"{NUMBER}{NAME}{UNIT}{END}", "   \x05")
    df = df.withColumn("_bare", bare)
    df = df.withColumn("_t1", F.regexp_replace("_bare", _NAME, f"{NAME}$0{END}"))
    df = df.withColumn("_t2", F.regexp_replace("_t1", _NUMBER, f" {NUMBER}$0{END} "))
    units = F.regexp_replace("_t2", _UNIT, f"$1 {UNIT}$2{END} ")
    df = df.withColumn("_t3", F.when(F.col("_t2") != F.col("_t1"), units).otherwise(F.col("_t2")))
    slot = f"[{NUMBER}-{UNIT}][^{END}]*{END}"
    df = df.withColumn("_raw", F.regexp_extract_all("_t3", F.lit(rf"{_WORD}|{slot}"), F.lit(0)))
    return df.drop("_bare", "_t1", "_t2", "_t3")


def _template(raw: Column) -> Column:
    return F.transform(raw, lambda t: F.when(_is_slot(t), F.left(t, F.lit(1))).otherwise(F.lower(t)))


def _plain(raw: Column) -> Column:
    """The lower-case tokens, with the values of placeholders in place of their kinds."""
    return F.transform(raw, lambda t: F.lower(F.when(_is_slot(t), _value(t)).otherwise(t)))


def _value(token: Column) -> Column:
    return F.substr(token, F.lit(2), F.length(token) - 2)


def _values(raw: Column) -> Column:
    return F.transform(F.filter(raw, _is_slot), _value)


def _windows(df: DataFrame, keep: list[str], width: Column, plain: Column, last: Column | None = None) -> DataFrame:
    """One row for every window of `_tokens`, up to the one that begins at `last`: `keep`, its place `pos` and `hash`.

    The kind of window is part of the hash, so that the join has one long for its key.
    """
    size = F.size("_tokens")
    at = places(size if last is None else F.least(size, last + width), width)
    hashes = F.transform(at, lambda i: F.xxhash64(F.slice("_tokens", i + 1, width), plain))
    return df.select(*keep, F.posexplode(hashes).alias("pos", "hash"))


def _wide_enough(how: Templates) -> Column:
    """The width of an item's windows: that of `how`, doubled until some window has its literals."""
    size = F.size("_raw")
    widths = F.transform(
        F.sequence(F.lit(0), F.lit(24)), lambda k: F.least(size, F.lit(how.width) * F.pow(F.lit(2), k)).cast("int")
    )

    def fits(width: Column) -> Column:
        def literals(i: Column) -> Column:
            return width - F.size(F.filter(F.slice("_raw", i + 1, width), _is_slot))

        return F.exists(places(size, width), lambda i: literals(i) >= how.literals)

    first = F.aggregate(
        F.array_distinct(widths), F.lit(None).cast("int"), lambda acc, w: F.coalesce(acc, F.when(fits(w), w))
    )
    return F.coalesce(first, F.least(size, F.lit(how.width)))


def benchmark_windows(items: DataFrame, how: Templates) -> DataFrame:
    """hash, width, plain, item_id, item_pos, item_values and first of all windows that may be searched.

    `plain` windows are of lower-case words and numbers as they stand, the others of the template.
    Behind other text, the first word of an item may be a name. An item with a single window, at its
    start, has a second one with that name in front; `first` is the value that it must have there.
    """
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    made = add_template(items).withColumn("width", _wide_enough(how)).withColumn("_tokens", _template(F.col("_raw")))
    columns = ["item_id", "width", "item_values", "hash", "pos"]
    width = F.col("width")

    def within(df: DataFrame) -> DataFrame:
        return df.withColumn("item_values", _values(F.slice("_raw", F.col("pos") + 1, width)))

    own = within(_windows(made.filter(width >= how.literals), ["item_id", "text", "width", "_raw"], width, F.lit(False)))
    own = own.filter(width - F.size("item_values") >= how.literals)
    alone = own.groupBy("item_id", "text").agg(F.max("pos").alias("pos"), F.max("width").alias("width"))
    behind = add_template(
        alone.filter("pos = 0").select("item_id", "width", F.concat(F.lit("a "), F.ltrim("text")).alias("text"))
    )
    behind = behind.filter(F.startswith(F.get("_raw", F.lit(1)), F.lit(NAME))).select(
        "item_id", F.least("width", F.size("_raw") - 1).alias("width"), F.slice("_raw", 2, F.size("_raw")).alias("_raw")
    )
    behind = behind.withColumn("_tokens", _template(F.col("_raw")))
    named = within(_windows(behind, ["item_id", "width", "_raw"], width, F.lit(False)).filter("pos = 0"))
    words = made.select(
        "item_id", _plain(F.col("_raw")).alias("_tokens"), F.least(F.size("_raw"), F.lit(how.width)).alias("width")
    )
    words = _windows(words.filter(width >= how.literals), ["item_id", "width"], width, F.lit(True))
    words = words.withColumn("item_values", F.array().cast("array<string>"))
    no_first, plain = F.lit(None).cast("string").alias("first"), F.lit(True).alias("plain")
    every = own.select(*columns, no_first, (~plain).alias("plain"))
    every = every.unionByName(named.select(*columns, F.get("item_values", F.lit(0)).alias("first"), (~plain).alias("plain")))
    every = every.unionByName(words.select(*columns, no_first, plain))
    return every.withColumnRenamed("pos", "item_pos").distinct()


def _blocks(plain: bool, width: int) -> Column:
    """The tokens in blocks that overlap; a block has the windows that begin at its first `step` places."""
    step = max(BLOCK, width)

    def block(i: Column) -> Column:
        raw = F.slice("_raw", i + 1, step + width - 1)
        fields = {"plain": F.lit(plain), "width": F.lit(width), "base": i, "step": F.lit(step), "raw": raw}
        return F.struct(*[c.alias(n) for n, c in fields.items()])

    made = F.transform(F.sequence(F.lit(0), F.size("_raw") - 1, F.lit(step)), block)
    none = F.array().cast("array<struct<plain:boolean,width:int,base:int,step:int,raw:array<string>>>")
    return F.when(F.size("_raw") > 0, made).otherwise(none)


def _document_windows(docs: DataFrame, kinds: list[tuple[bool, int]]) -> DataFrame:
    """`hash` of all windows of the given kinds (plain, width), with doc_id, plain, width and their place.

    One pass over the texts. A text is cut into blocks, so that what goes along with a window stays
    short however long the text is: `base`, the block's place, `raw`, its tokens, and `pos` there.
    """
    cut = docs.select("doc_id", F.explode(F.concat(*[_blocks(*k) for k in kinds])).alias("_b")).select("doc_id", "_b.*")
    tokens = F.when(F.col("plain"), _plain(F.col("raw"))).otherwise(_template(F.col("raw")))
    keep = ["doc_id", "plain", "width", "base", "raw"]
    return _windows(cut.withColumn("_tokens", tokens), keep, F.col("width"), F.col("plain"), F.col("step") - 1)


def find_leaks(docs: DataFrame, items: DataFrame, how: Templates | None = None) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds.

    Returns doc_id, item_id, matched (windows of the item found), windows (of the item that may be
    searched), coverage, and reparameterised (whether some placeholder has another value than in
    the item). `docs` needs doc_id and text, `items` item_id and text; other columns are not read.
    An item is held if enough windows of its template are found, or else of its plain words and
    numbers, in any case; then the counts are of the plain windows, and nothing has another value.

    Null texts hold nothing, and rows without an id have one null id in common. Rows of one id are
    taken together; repeated items are one. An item with fewer than `literals` words and numbers
    is not searched.
    """
    how = how or Templates()
    known = pin(benchmark_windows(items, how), "benchmark-windows")
    size = known.count()
    sizes = known.groupBy("item_id", "plain").agg(F.countDistinct("item_pos").alias("windows"))
    # Up to `width` of either kind, and a few doubled.
    kinds = [(r.plain, r.width) for r in known.select("plain", "width").distinct().orderBy("plain", "width").collect()]
    if not size:
        return docs.sparkSession.createDataFrame(
            [], "doc_id bigint, item_id bigint, matched bigint, windows bigint, coverage double, reparameterised boolean"
        )
    made = add_template(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    small = size <= how.broadcast_rows
    windows = _document_windows(made, kinds)
    own = known.drop("plain", "width")
    hits = windows.join(F.broadcast(own) if small else own, "hash").select(
        "doc_id",
        "item_id",
        "plain",
        "item_pos",
        (F.col("base") + F.col("pos") - F.col("item_pos")).alias("shift"),
        "first",
        F.when(F.col("plain"), F.array().cast("array<struct<x:string,y:string>>")).otherwise(F.transform(
            F.arrays_zip(
                F.col("item_values").alias("x"), _values(F.slice("raw", F.col("pos") + 1, F.col("width"))).alias("y")
            ),
            lambda z: F.struct(z["x"].alias("x"), z["y"].alias("y")),
        )).alias("pairs"),
    )
    # A first word that is a name only by what stands before it is none of the values.
    named = F.col("first").isNotNull()
    hits = hits.filter(~named | (F.get("pairs", F.lit(0))["y"] == F.col("first")))
    hits = hits.withColumn("pairs", F.when(named, F.slice("pairs", 2, F.size("pairs"))).otherwise(F.col("pairs")))
    runs = (
        hits.groupBy("doc_id", "item_id", "plain", "shift")
        .agg(
            F.collect_set("item_pos").alias("positions"),
            F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
        )
        .withColumn("values", F.size(F.array_distinct(F.transform("pairs", lambda p: p["x"]))))
        .filter(F.col("values") >= how.consistency * F.size("pairs"))
        .withColumn("changed", F.exists("pairs", lambda p: p["x"] != p["y"]))
    )
    whole = runs.groupBy("doc_id", "item_id", "plain").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("positions")))).cast("bigint").alias("matched"),
        F.every("changed").alias("reparameterised"),
    )
    held = (
        whole.join(F.broadcast(sizes) if small else sizes, ["item_id", "plain"])
        .withColumn("coverage", F.col("matched") / F.col("windows"))
        .filter(F.col("coverage") >= how.coverage)
    )
    best = F.min(F.struct("plain", "matched", "windows", "coverage", "reparameterised")).alias("best")
    return held.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "best.matched", "best.windows", "best.coverage", "best.reparameterised"
    )


def op7_benchmark_leaks(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
