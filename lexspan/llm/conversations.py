"""Conversation repair by the auction algorithm for shortest paths.

A conversation and the role patterns it may have span a lattice: one layer for every row, four
states in each (nothing yet, after system, after user, after assistant), and an arc with an integer
cost for every edit. The auction keeps a price for every node and one path that is extended along a
tight arc, or contracted while the price of its last node rises, until it meets an exit. Prices are
then distances wherever a path has been settled, so that tight arcs are those of the cheapest edits,
and the ASCII-least of these are traced node by node.

Long conversations are cut into segments of a few rows. Auctions over a segment give its cost
between any two states; these are folded from the end to the exit prices of every segment, for
which each segment is traced by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.llm.joins import salted_join
from lexspan.session import pin, shuffle_partitions

NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
WORD = r"[^\x20\x09-\x0D]"
SALTS = 16
# Rows of a segment, as a power of two: bounds the work of an auction, not what is repaired.
SEGMENT_BITS = 6

# A row in one letter: its role's initial (x: any other), in capitals if its text is cut off; - if
# it must go.
_GONE = "-"


@dataclass(frozen=True)
class Edits:
    """What an edit costs; `truncated` is added for a cut-off row that stays."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


Arc = tuple[str, int, int, int]


@lru_cache(maxsize=None)
def arcs(row: str, state: int, how: Edits) -> tuple[Arc, ...]:
    """(edit, cost, layers forward, next state) of the edits at a row, by ASCII."""
    turn = ASSISTANT if state == USER else USER
    out: list[Arc] = [("D", how.delete, 1, state), ("I", how.insert, 0, turn)]
    if row != _GONE:
        extra = how.truncated if row.isupper() else 0
        own = row.lower()
        if own == "s" and state == NOTHING:
            out.append(("K", extra, 1, SYSTEM))
        elif own == "ua"[turn == ASSISTANT]:
            out.append(("K", extra, 1, turn))
        out.append(("R", how.rerole + extra, 1, turn))
    return tuple(out)


class Auction:
    """Prices of the nodes of one segment, for given prices of its exits."""

    def __init__(self, rows: str, exits: tuple[float, ...], how: Edits):
        self.rows, self.how = rows, how
        self.prices: list[list[float]] = [[inf] * 4 for _ in rows] + [list(exits)]
        self.settled: set[tuple[int, int]] = set()
        # A node that reaches no exit would be priced up for ever; all others start at 0.
        for layer in reversed(range(len(rows))):
            for _ in range(3):  # inserts lead to a state of the same layer, two in a row at most
                for state in STATES:
                    if any(self._at(layer, a) < inf for a in arcs(rows[layer], state, how)):
                        self.prices[layer][state] = 0

    def _at(self, layer: int, arc: Arc) -> float:
        return self.prices[layer + arc[2]][arc[3]]

    def settle(self, layer: int, state: int) -> float:
        """Auction from a node until its path meets an exit; its price is then its distance."""
        path = [(layer, state)]
        while True:
            at, now = path[-1]
            price = self.prices[at][now]
            if at == len(self.rows) or (at, now) in self.settled or price == inf:
                break
            best = min(arcs(self.rows[at], now, self.how), key=lambda a: a[1] + self._at(at, a))
            offer = best[1] + self._at(at, best)
            if price < offer:
                self.prices[at][now] = offer
                if len(path) > 1:
                    path.pop()
            else:
                path.append((at + best[2], best[3]))
        self.settled.update(path)
        return self.prices[layer][state]

    def trace(self, state: int) -> tuple[int, str]:
        """The exit and the edits of the ASCII-least cheapest path; -1 if there is none."""
        if self.settle(0, state) == inf:
            return -1, ""
        layer, edits = 0, []
        while layer < len(self.rows):
            for arc in arcs(self.rows[layer], state, self.how):
                price = self.prices[layer][state]
                # Prices not settled yet may be too low: an arc that looks tight is tried first.
                if price == arc[1] + self._at(layer, arc) and price == arc[1] + self.settle(layer + arc[2], arc[3]):
                    edits.append(arc[0])
                    layer, state = layer + arc[2], arc[3]
                    break
        return state, "".join(edits)


@lru_cache(maxsize=1 << 14)
def segment_costs(rows: str, how: Edits) -> tuple[tuple[int, ...], ...]:
    """The least cost from every state to every other over a segment; -1 where there is no way."""
    columns = []
    for end in STATES:
        auction = Auction(rows, tuple(0 if s == end else inf for s in STATES), how)
        columns.append([auction.settle(0, s) for s in STATES])
    return tuple(tuple(int(c[s]) if c[s] < inf else -1 for c in columns) for s in STATES)


@lru_cache(maxsize=1 << 14)
def segment_traces(rows: str, exits: tuple[int, ...], how: Edits) -> tuple[tuple[int, str], ...]:
    """For every state at the start: the state at the end, and the edits."""
    auction = Auction(rows, tuple(e if e >= 0 else inf for e in exits), how)
    return tuple(auction.trace(s) for s in STATES)


def closing(how: Edits) -> dict[int, str]:
    """The edits behind the last row, by the state there."""
    return {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def numbered_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `place`: rows in the order of conversation, turn (nulls first),
    role and text, written once. Null roles and texts become one space.

    Range partitions cut even one conversation that holds most of the rows.
    """
    order = ["conv_id", "turn", "role", "text"]
    narrow = rows.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    ordered = narrow.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return pin(ordered.withColumn("place", F.monotonically_increasing_id()), "turns")


def _faults(numbered: DataFrame) -> DataFrame:
    """conv_id, place, initial and fault (blank, duplicate, truncated or null) of every row."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    parts = [x for c in (conv, F.col("role")) for x in (F.length(c).cast("string"), F.lit(":"), c)]
    last = F.regexp_extract("text", rf"({WORD})[\x20\x09-\x0D]*\z", 1)
    blank = ~F.col("text").rlike(WORD)
    narrow = numbered.select(
        "conv_id",
        "place",
        _initial(F.col("role")).alias("initial"),
        # Only equal rows of one conversation share a key; blank rows need none.
        F.when(~blank, F.unhex(F.sha2(F.concat(*parts, "text"), 256))).alias("key"),
        F.when(blank, "blank").when(~last.isin(".", "!", "?"), "truncated").alias("fault"),
        F.pmod("place", F.lit(SALTS)).cast("int").alias("_salt"),
    )
    firsts = narrow.dropna(subset=["key"]).groupBy("key").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    seen = salted_join(narrow, firsts.filter("n > 1").drop("n"), ["key"], SALTS)
    fault = F.when(F.col("place") > F.col("first"), "duplicate").otherwise(F.col("fault"))
    return seen.select("conv_id", "place", "initial", fault.alias("fault"))


def _segments(numbered: DataFrame) -> DataFrame:
    """conv_id, segment, its rows as letters, initials, and counts of faults."""
    fault, initial = F.col("fault"), F.col("initial")
    letter = (
        F.when(fault.isin("blank", "duplicate"), _GONE).when(fault == "truncated", F.upper(initial)).otherwise(initial)
    )
    in_order = F.array_sort(F.collect_list(F.struct("place", letter.alias("letter"), "initial")))
    return (
        _faults(numbered)
        .groupBy("conv_id", F.shiftright("place", SEGMENT_BITS).alias("segment"))
        .agg(
            in_order.alias("own"),
            *[F.count_if(fault == kind).alias(kind) for kind in ("blank", "duplicate", "truncated")],
        )
        .withColumn("rows", F.array_join(F.transform("own", lambda x: x["letter"]), ""))
        .withColumn("initials", F.array_join(F.transform("own", lambda x: x["initial"]), ""))
        .drop("own")
    )


def _rowwise(fn: Callable[..., tuple], inputs: list[str], out: pa.Schema, keep: list[str]):
    """An Arrow function that adds what `fn` returns for each row's `inputs` to the columns `keep`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fn(*x) for x in zip(*(batch.column(c).to_pylist() for c in inputs), strict=True)]
            columns = list(zip(*made, strict=True)) or [[] for _ in out]
            arrays = [pa.array(list(c), f.type) for c, f in zip(columns, out, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays], [*keep, *out.names])

    return run


_LONGS = pa.list_(pa.int64())


def _costs(how: Edits):
    def one(rows: str) -> tuple:
        return ([x for line in segment_costs(rows, how) for x in line],)

    return one


def _folded(how: Edits):
    """From the segments of a conversation: cost, illegal pairs, exit prices of every segment."""

    def one(segments: list[dict]) -> tuple:
        segments = sorted(segments, key=lambda s: s["segment"])
        initials = "".join(s["initials"][0] + s["initials"][-1] for s in segments)
        between = sum(a + b not in LEGAL for a, b in zip(initials[1::2], initials[2::2], strict=False))
        exits = [len(closing(how)[s]) * how.insert for s in STATES]
        out = []
        for s in reversed(segments):
            out.append({"segment": s["segment"], "exits": exits})
            ways = [[(s["costs"][4 * a + b], exits[b]) for b in STATES] for a in STATES]
            exits = [min((x + e for x, e in w if x >= 0 and e >= 0), default=-1) for w in ways]
        inside = sum(s["illegal"] for s in segments)
        return exits[NOTHING], inside + between, out

    return one


def _traced(how: Edits):
    def one(rows: str, exits: list[int]) -> tuple:
        # Only differences decide: shifted to zero, far fewer segments are unlike.
        least = min(e for e in exits if e >= 0)
        found = segment_traces(rows, tuple(e - least if e >= 0 else -1 for e in exits), how)
        return [end for end, _ in found], [edits for _, edits in found]

    return one


def _chained(how: Edits):
    """From the traces of a conversation's segments: its edits, and each segment's with its entry."""

    def one(segments: list[dict]) -> tuple:
        state, out = NOTHING, []
        for s in sorted(segments, key=lambda s: s["segment"]):
            out.append({"segment": s["segment"], "entry": state, "edits": s["edits"][state]})
            state = s["ends"][state]
        out[-1]["edits"] += closing(how)[state]
        return "".join(s["edits"] for s in out), out

    return one


def _sql_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


@dataclass(frozen=True)
class Repairs:
    """What `find_repairs` found: the rows in order, each segment's edits, and one row per conversation."""

    numbered: DataFrame
    edits: DataFrame
    conversations: DataFrame


def find_repairs(rows: DataFrame, how: Edits | None = None) -> Repairs:
    """The cheapest edits that give every conversation the roles `(system? (user assistant)+)?`.

    `rows` needs conv_id, turn, role and text; others are not read. Rows are taken by turn, nulls
    first, rows of one turn by role and text. A null conv_id is a conversation of its own; null roles
    and texts are one space. Blank rows and repeats of an earlier role and text must go. Among
    edits of one cost the ASCII-least stand. An empty table gives no rows.

    `conversations`: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. `edits`:
    conv_id, segment, entry, edits. `numbered`: see `numbered_rows`.
    """
    how = how or Edits()
    numbered = numbered_rows(rows)
    conv = f"conv_id {_sql_type(numbered, 'conv_id')}"
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("initials") - 1, F.lit(1))),
        lambda i: F.substring(F.col("initials"), i, F.lit(2)),
    )
    illegal = F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin(*LEGAL))).cast("bigint")
    segments = pin(_segments(numbered).withColumn("illegal", illegal), "segments")
    made = segments.select("conv_id", "segment", "rows").mapInArrow(
        _rowwise(_costs(how), ["rows"], pa.schema([("costs", _LONGS)]), ["conv_id", "segment"]),
        f"{conv}, segment bigint, costs array<bigint>",
    )
    same = ["conv_id", "segment"]

    def both(left: DataFrame, right: DataFrame) -> DataFrame:
        """Join by conversation (null is one, too) and segment."""
        other = right.select(*[F.col(c).alias(f"_{c}") if c in same else F.col(c) for c in right.columns])
        match = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("segment") == F.col("_segment"))
        return left.join(other, match).drop("_conv_id", "_segment")

    priced = both(segments.select(*same, "initials", "illegal"), made)
    gathered = priced.groupBy("conv_id").agg(
        F.collect_list(F.struct("segment", "initials", "illegal", "costs")).alias("segments")
    )
    exit_list = pa.list_(pa.struct([("segment", pa.int64()), ("exits", _LONGS)]))
    folded = pin(
        gathered.mapInArrow(
            _rowwise(
                _folded(how),
                ["segments"],
                pa.schema([("cost", pa.int64()), ("illegal", pa.int64()), ("own", exit_list)]),
                ["conv_id"],
            ),
            f"{conv}, cost bigint, illegal bigint, own array<struct<segment: bigint, exits: array<bigint>>>",
        ),
        "folded",
    )
    exits = folded.select("conv_id", F.explode("own").alias("own")).select("conv_id", "own.segment", "own.exits")
    traced = both(segments.select(*same, "rows"), exits).mapInArrow(
        _rowwise(
            _traced(how),
            ["rows", "exits"],
            pa.schema([("ends", _LONGS), ("edits", pa.list_(pa.string()))]),
            same,
        ),
        f"{conv}, segment bigint, ends array<bigint>, edits array<string>",
    )
    edit_list = pa.list_(pa.struct([("segment", pa.int64()), ("entry", pa.int64()), ("edits", pa.string())]))
    chained = pin(
        traced.groupBy("conv_id")
        .agg(F.collect_list(F.struct("segment", "ends", "edits")).alias("segments"))
        .mapInArrow(
            _rowwise(_chained(how), ["segments"], pa.schema([("audit", pa.string()), ("own", edit_list)]), ["conv_id"]),
            f"{conv}, audit string, own array<struct<segment: bigint, entry: bigint, edits: string>>",
        ),
        "chained",
    )
    turn = F.col("turn").cast("bigint")
    gaps = numbered.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).alias("gaps")
    )
    faults = segments.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    # One row a conversation in each; a union lets the null id meet its like.
    parts = [gaps, faults, folded.drop("own"), chained.drop("own")]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    conversations = whole.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in [*numbers, "audit"]])
    edits = chained.select("conv_id", F.explode("own").alias("own")).select("conv_id", "own.*")
    return Repairs(numbered, edits, conversations)


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """For every batch, (conv_id, segment, number, edit, role, text) of the rows that stay or are new.

    Rows come by conversation, segment and place, those of a segment behind a row with its edits.
    """
    names = ("conv_id", "segment", "entry", "edits", "role", "text")
    state, edits, at, number = NOTHING, "", 0, 0
    for batch in batches:
        out = []
        for conv_id, segment, entry, own, role, text in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if own is not None:
                state, edits, at, number = entry, own, 0, 0
            else:
                edit = edits[at]
                at += 1
                if edit == "R":
                    role = NAMES[ASSISTANT if state == USER else USER]
                if edit != "D":
                    state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                    out.append((conv_id, segment, number, edit, role, text))
                    number += 1
            while at < len(edits) and edits[at] == "I":
                state = ASSISTANT if state == USER else USER
                out.append((conv_id, segment, number, "I", NAMES[state], ""))
                at, number = at + 1, number + 1
        yield out


def _beside_edits(found: Repairs, *keys: str) -> DataFrame:
    rows = found.numbered.select("conv_id", F.shiftright("place", SEGMENT_BITS).alias("segment"), "place", "role", "text")
    marks = found.edits.withColumn("place", F.lit(-1).cast("bigint"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    return both.repartition(*keys).sortWithinPartitions("conv_id", "segment", "place").drop("place")


def repaired_rows(found: Repairs) -> DataFrame:
    """The repaired conversations: conv_id, segment, number (of the row within it), edit, role, text.

    Rows move by segment, so that a long conversation is no hot key.
    """

    def repair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, out in _with_output(batches):
            columns = list(zip(*out, strict=True)) or [[] for _ in range(6)]
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), *[pa.string()] * 3]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                ["conv_id", "segment", "number", "edit", "role", "text"],
            )

    conv = f"conv_id {_sql_type(found.numbered, 'conv_id')}"
    return _beside_edits(found, "conv_id", "segment").mapInArrow(
        repair, f"{conv}, segment bigint, number bigint, edit string, role string, text string"
    )


def _with_output(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    last: list[pa.RecordBatch] = []

    def kept() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last[:] = [batch]
            yield batch

    for out in _edited(kept()):
        yield last[0], out


def digests(found: Repairs) -> DataFrame:
    """conv_id and `repaired_sha256` of the rows `role:text`, joined by newlines.

    A digest reads a conversation's text in one order, so one task streams it; it holds a batch
    at a time. A conversation of which no row stays has the digest of nothing.
    """

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, running, first = None, None, True
        kind = None

        def made(pairs: list[tuple]) -> pa.RecordBatch:
            ids, hashes = list(zip(*pairs, strict=True)) or ([], [])
            return pa.RecordBatch.from_arrays(
                [pa.array(list(ids), kind), pa.array(list(hashes), pa.string())], ["conv_id", "repaired_sha256"]
            )

        for batch, out in _with_output(batches):
            kind = batch.schema.field("conv_id").type
            done = []
            for conv_id, _, _, _, role, text in out:
                if running is None or conv_id != own:
                    if running is not None:
                        done.append((own, running.hexdigest()))
                    own, running, first = conv_id, hashlib.sha256(), True
                running.update((("" if first else "\n") + role + ":" + text).encode())
                first = False
            if done:
                yield made(done)
        if running is not None:
            yield made([(own, running.hexdigest())])

    conv = f"conv_id {_sql_type(found.numbered, 'conv_id')}"
    return _beside_edits(found, "conv_id").mapInArrow(digest, f"{conv}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """`rows` with faults planted by the CRC-32 of `conv_id:turn`, modulo 20.

    0 drops the row, 1 empties its text, 2 takes the marks .!? out, 3 repeats it, 4 makes it the
    user's. Nulls count as one space, in that key, too.
    """

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.col("_kind")
    planted = rows.select(
        "conv_id",
        "turn",
        filled("role").alias("role"),
        filled("text").alias("text"),
        (F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20).alias("_kind"),
    ).filter(kind != 0)
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return planted.withColumn("_copy", F.explode(copies)).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text")
    )


def repair_report(originals: DataFrame, found: Repairs) -> DataFrame:
    """One row for every conv_id of `originals`; zeros where no row was left to repair."""
    parts = originals.select("conv_id").distinct()
    for part in (found.conversations, digests(found)):
        parts = parts.unionByName(part, allowMissingColumns=True)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = hashlib.sha256().hexdigest()
    return parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in numbers],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(nothing)).alias("repaired_sha256"),
    )


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_report(rows, find_repairs(damaged(rows)))
