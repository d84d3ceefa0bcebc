"""Conversation repair against all edits by plain dynamic programming."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from lexspan.llm.conversations import (
    STATES,
    Edits,
    damaged,
    find_repairs,
    op11_conversation_repair,
    repair_report,
    repaired_rows,
    segment_costs,
    segment_traces,
)

HOW = Edits()
ROWS = "conv_id long, turn long, role string, text string, segment string, place string, edits string"


def cheapest(rows):
    """(cost, edits) of the ASCII-least cheapest repair; `rows` are (initial, must go, cut off)."""
    best = {"": (0, "")}  # by the last role: nothing, s, u, a

    def better(table, role, cost, edits):
        if role not in table or (cost, edits) < table[role]:
            table[role] = (cost, edits)

    def with_inserts(table):
        for _ in range(3):
            for role, (cost, edits) in list(table.items()):
                better(table, "a" if role == "u" else "u", cost + 5, edits + "I")
        return table

    for initial, gone, cut in rows:
        after = {}
        for role, (cost, edits) in with_inserts(best).items():
            better(after, role, cost + 2, edits + "D")
            if not gone:
                turn = "a" if role == "u" else "u"
                extra = 5 if cut else 0
                if initial == turn or (initial == "s" and role == ""):
                    better(after, initial, cost + extra, edits + "K")
                better(after, turn, cost + extra + 1, edits + "R")
        best = after
    with_inserts(best)
    return min(best[r] for r in ("", "a") if r in best)


WORD = re.compile(r"[^\x20\x09-\x0D]")


def plain(rows):
    """The report of one conversation from its rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, shapes, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        letters = WORD.findall(text)
        kind = None
        if not letters:
            kind = "blank"
        elif (role, text) in seen:
            kind = "duplicate"
        elif letters[-1] not in ".!?":
            kind = "truncated"
        seen.add((role, text))
        if kind:
            counts[kind] += 1
        shapes.append((role[:1], kind in ("blank", "duplicate"), kind == "truncated"))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(shapes, shapes[1:]))
    cost, audit = cheapest(shapes)
    out, at = [], 0
    for edit in audit:
        before = out[-1][0][0] if out else ""
        turn = "assistant" if before == "u" else "user"
        if edit == "I":
            out.append((turn, ""))
            continue
        _, role, text = rows[at]
        at += 1
        if edit != "D":
            out.append((role if edit == "K" else turn, text))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0][0] for r in out))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (gaps, *counts.values(), illegal, cost, audit, digest), out


def hurt(rows):
    """Rows (conv_id, turn, role, text) after damage, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else str(x)
        own = out.setdefault(conv, [])
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def expected(rows):
    return sorted(((c, *plain(own)[0]) for c, own in hurt(rows).items()), key=repr)


def test_traces_of_all_short_segments():
    letters = "suaUx-"
    for n in range(5):
        for rows in map("".join, product(letters, repeat=n)):
            exits = (0, 10, 5, 0)
            shapes = [("" if c == "-" else c.lower(), c == "-", c.isupper()) for c in rows]
            end, edits = segment_traces(rows, exits, HOW)[0]
            edits += {0: "", 1: "II", 2: "I", 3: ""}[end]
            assert edits == cheapest(shapes)[1], rows


def test_costs_add_up_over_segments():
    rng = random.Random(3)
    for _ in range(60):
        rows = "".join(rng.choice("suaUSAx-") for _ in range(rng.randrange(2, 40)))
        cut = rng.randrange(len(rows) + 1)
        whole, a, b = (segment_costs(r, HOW) for r in (rows, rows[:cut], rows[cut:]))
        for s, e in product(STATES, STATES):
            ways = [a[s][m] + b[m][e] for m in STATES if a[s][m] >= 0 and b[m][e] >= 0]
            assert whole[s][e] == min(ways, default=-1)


def test_other_costs():
    # Cheap inserts: a lone assistant row is given its user; dear ones: it goes.
    assert segment_traces("a", (0, 4, 2, 0), Edits(insert=1))[0] == (3, "IK")
    assert segment_traces("a", (0, 40, 20, 0), Edits(insert=20))[0] == (0, "D")


def edge_rows():
    rng = random.Random(8)
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"),
        (2, 0, "assistant", "Alone."),
        (3, None, "user", "No turn."), (3, 5, None, "No role."), (3, 9, "assistant", None),
        (None, 1, "user", "No id."), (None, None, None, None), (None, 2, "assistant", "Here."),
        (4, 7, "tool", "x\x0b"), (4, 7, "", "."), (4, 7, "tool", "x\x0b"), (4, 7, "tool", "x\x0b"),
        (5, 0, "system", "Be short."), (6, -5, "user", "é "), (6, 10**12, "system", "Late."),
        (7, 0, "user", "long " * 200_000 + "."), (7, 1, "assistant", "x" * 1_000_000),
    ]
    words = ["Yes.", "No!", "cut", "", " \n", "Why?", "So it is."]
    for conv in range(100, 160):
        for turn in range(rng.randrange(1, 12)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "user", "assistant"]), rng.choice(words)))
    for turn in range(900):  # over several segments, with repeats all over
        rows.append((200, turn, rng.choice(["user", "assistant", "bot"]), rng.choice([*words, f"row {turn}."])))
    return rows


def test_edges(spark):
    rows = edge_rows()
    frame = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], ROWS).repartition(5)
    found = find_repairs(damaged(frame))
    got = sorted(map(tuple, repair_report(frame, found).collect()), key=repr)
    want = expected(rows)
    assert got == want
    # The repaired rows themselves.
    made = {}
    for r in repaired_rows(found).orderBy("conv_id", "segment", "number").collect():
        made.setdefault(r.conv_id, []).append((r.role, r.text))
    for conv, own in hurt(rows).items():
        assert made.get(conv, []) == plain(own)[1]


def test_all_rows_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    rows = [(9, turn, "user", "Gone.")]
    frame = spark.createDataFrame([(*r, "", "", "") for r in rows], ROWS)
    got = repair_report(frame, find_repairs(damaged(frame))).collect()
    assert list(map(tuple, got)) == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_text_ids(spark):
    frame = spark.createDataFrame([("a", 0, "user", "Hi."), (None, 0, "user", "Hi.")], "conv_id string, turn int, role string, text string")
    got = {r.conv_id: r.audit for r in find_repairs(frame).conversations.collect()}
    assert got == {"a": "D", None: "D"}


def test_empty_table(spark):
    frame = spark.createDataFrame([], ROWS)
    assert repair_report(frame, find_repairs(frame)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, op11_conversation_repair(spark, sf).collect()), key=repr) == expected(rows)
