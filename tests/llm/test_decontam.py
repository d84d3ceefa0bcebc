"""Decontamination against a plain search for template windows."""

import regex

from lexspan.llm.decontam import UNITS, Templates, find_leaks, op7_benchmark_leaks

DOCS = "doc_id long, text string, item_id string, hash string"
ITEMS = "item_id long, text string, doc_id string"
NAME = regex.compile(r"(?<=[\p{L},;]\x20)\p{Lu}[\p{L}\p{M}'’-]+")
NUMBER = regex.compile(r"[0-9]+(?:[.,:][0-9]+)*")
UNIT = regex.compile(rf"\x01\s*({'|'.join(sorted(UNITS, key=len, reverse=True))})(?!\p{{L}})")


def template(text):
    t0 = regex.sub("[\x01-\x03]", " ", text or "")
    values = {"\x02": NAME.findall(t0)}
    t1 = NAME.sub("\x02", t0)
    values["\x01"] = NUMBER.findall(t1)
    t2 = NUMBER.sub(" \x01 ", t1)
    values["\x03"] = UNIT.findall(t2)
    tokens = regex.findall(r"[\p{L}\p{M}\p{N}]+|[\x01-\x03]", UNIT.sub("\x01 \x03 ", t2).lower())
    left = {k: iter(v) for k, v in values.items()}
    return tokens, [next(left[t]) if t in left else None for t in tokens]


def plain_words(text):
    return [t if v is None else v.lower() for t, v in zip(*template(text), strict=True)]


def widest_needed(values, how):
    """The width of an item's windows: doubled until one has enough literals."""
    size, width = len(values), how.width
    while True:
        w = min(size, width)
        fits = any(sum(v is None for v in values[p : p + w]) >= how.literals for p in range(size - w + 1))
        if fits or w == size:
            return w if fits else min(size, how.width)
        width *= 2


def brute(docs, items, how=None):
    how = how or Templates()
    out = []
    made, plain = {}, {}
    for i, text in items:
        tokens, values = template(text)
        width = widest_needed(values, how)
        made[i] = (width, {
            p: (tokens[p : p + width], [v for v in values[p : p + width] if v is not None])
            for p in range(len(tokens) - width + 1)
            if sum(v is None for v in values[p : p + width]) >= how.literals
        }, [])
        if set(made[i][1]) == {0}:  # once more with a name in front
            tokens, values = template("a " + (text or "").lstrip(" "))
            if tokens[1] == "\x02":
                width = min(width, len(tokens) - 1)
                made[i][2].append((tokens[1 : width + 1], [v for v in values[1 : width + 1] if v is not None]))
        words = plain_words(text)
        width = min(len(words), how.width)
        if width >= how.literals:
            plain[i] = width, [words[p : p + width] for p in range(len(words) - width + 1)]
    for d, text in docs:
        tokens, values = template(text)
        words, where = plain_words(text), {}

        def places(window, among):
            n, kind = len(window), among is words
            if (kind, n) not in where:
                where[kind, n] = index = {}
                for q in range(len(among) - n + 1):
                    index.setdefault(tuple(among[q : q + n]), []).append(q)
            return where[kind, n].get(tuple(window), ())

        for i, (width, windows, named) in made.items():
            runs = {}
            for p, (w, own) in windows.items():
                for q in places(w, tokens):
                    there = [v for v in values[q : q + len(w)] if v is not None]
                    run = runs.setdefault(q - p, (set(), set()))
                    run[0].add(p)
                    run[1].update(zip(own, there, strict=True))
            for w, own in named:
                for q in places(w, tokens):
                    there = [v for v in values[q : q + len(w)] if v is not None]
                    if there[0] == own[0]:
                        run = runs.setdefault(q, (set(), set()))
                        run[0].add(0)
                        run[1].update(zip(own[1:], there[1:], strict=True))
            good = [r for r in runs.values() if len({x for x, _ in r[1]}) >= how.consistency * len(r[1])]
            matched = len(set().union(*[r[0] for r in good])) if good else 0
            if matched and matched >= how.coverage * len(windows):
                changed = all(any(x != y for x, y in r[1]) for r in good)
                out.append((d, i, matched, len(windows), changed))
            elif i in plain:
                width, own = plain[i]
                matched = sum(bool(places(w, words)) for w in own)
                if matched and matched >= how.coverage * len(own):
                    out.append((d, i, matched, len(own), False))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.item_id, r.matched, r.windows, r.reparameterised) for r in df.collect()), key=repr)


PUZZLE = "Every morning Alice walks 5 km to the market, where Alice buys 12 apples and sells 5 km of rope to the baker."
AGAIN = "Every morning Robert walks 8 miles to the market, where Robert buys 40 apples and sells 8 miles of rope to the baker."
MIXED = "Every morning Robert walks 8 miles to the market, where Susan buys 40 apples and sells 9 cm of rope to the baker."


def test_edges(spark):
    items = [
        (1, PUZZLE), (2, "five short literal words here"), (3, None), (4, ""), (5, "1 2 3 4 5 6 7 8 9 10 11"), (6, "too short"),
        (7, "a passage without any value that runs over a good dozen of plain words"),
        (7, "a passage without any value that runs over a good dozen of plain words"),
        (8, "a passage without any value that runs over a good dozen of other words"),
    ]
    texts = [
        None, "", PUZZLE, f"Before. {AGAIN} After.", MIXED, "x five, short; literal\nwords here y", "1 2 3 4 5 6 7 8 9 10 11 12 " * 30,
        "A passage without any value that runs over a good dozen of plain words. " * 40, "clean text " * 300,
        "a passage without any value that runs elsewhere and never comes back to where it began at all",
        PUZZLE.upper(), "see: 1 2 3 4 5 6 7 8 9 10 11.", "é\U0001f600 " + PUZZLE, " ".join(f"w{i}" for i in range(20000)) + " . " + AGAIN, "tie " + PUZZLE, "tie " + PUZZLE,
    ]
    docs = list(enumerate(texts))
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs] + [(None, PUZZLE, "", "")], DOCS).repartition(3)
    own = spark.createDataFrame([(*i, "z") for i in items], ITEMS)
    want = brute([*docs, (None, PUZZLE)], items)
    for how in (Templates(), Templates(broadcast_rows=0)):
        assert rows_of(find_leaks(frame, own, how)) == want
    found = {(d, i): changed for d, i, _, _, changed in want}
    assert found[2, 1] is False and found[3, 1] is True and (4, 1) not in found and (5, 2) in found
    assert found[10, 1] is False and (11, 5) in found and (6, 5) in found  # other case; values only
    assert not any(i in (3, 4, 6) for _, i in found)


DENSE = "add 1 2 3 4 5 6 7 to 8 9 10 11 12 13 14 then 15 16 17 18 19 take 20 21 22 23 24 off 25 26 27"


def test_items_without_a_plain_window(spark):
    items = [(1, "What is the capital of France", ""), (2, DENSE, ""), (3, "Which river flows through the old town", "")]
    texts = [
        "so they asked, and What is the capital of France then", "What is the capital of France?", "and Who is the capital of France",
        f"before. {DENSE} after.", "and What is the capital of Spain", "they said; Which river flows through the old town",
        DENSE.replace("take", "give"),
    ]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS)
    for how in (Templates(), Templates(broadcast_rows=0)):
        found = {(r.doc_id, r.item_id): r.reparameterised for r in find_leaks(docs, spark.createDataFrame(items, ITEMS), how).collect()}
        assert found == {(0, 1): False, (1, 1): False, (3, 2): False, (4, 1): True, (5, 3): False, (6, 2): False}
        rows = [(d, i, matched, windows, x) for d, i, matched, windows, x in brute(list(enumerate(texts)), [x[:2] for x in items])]
        assert rows_of(find_leaks(docs, spark.createDataFrame(items, ITEMS), how)) == rows


def test_windows_across_blocks(spark):
    """Items at, before and behind the places where a long text is cut."""
    dense = " ".join(f"{i} {i + 1} {i + 2} or" for i in range(300))  # windows wider than a plain one
    items = [(1, PUZZLE), (2, DENSE), (3, dense)]
    texts = [" ".join(["w"] * n) + f". {t} " + " ".join(["v"] * 600) for n in range(490, 520, 3) for t in (AGAIN, DENSE)]
    texts += [dense, "x " * 700 + dense, PUZZLE * 100]
    docs = list(enumerate(texts))
    want = brute(docs, items)
    assert {d for d, *_ in want} == set(range(len(texts)))
    frame = spark.createDataFrame([(*d, "x", "y") for d in docs], DOCS)
    assert rows_of(find_leaks(frame, spark.createDataFrame([(*i, "z") for i in items], ITEMS))) == want


def test_very_long_text(spark):
    text = " ".join(f"w{i} Alice, Bob {i} km" for i in range(50_000)) + " . " + AGAIN
    docs = spark.createDataFrame([(1, text, "", "")], DOCS)
    assert [r.reparameterised for r in find_leaks(docs, spark.createDataFrame([(1, PUZZLE, "")], ITEMS)).collect()] == [True]


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, PUZZLE, "")], ITEMS)
    assert find_leaks(none, items).count() == 0
    docs = spark.createDataFrame([(1, PUZZLE, "", "")], DOCS)
    assert find_leaks(docs, spark.createDataFrame([], ITEMS)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute(docs, items)
    assert want and rows_of(op7_benchmark_leaks(spark, sf)) == want
    held = {(d, i) for d, t in docs for i, x in items if x in t}
    assert held <= {(d, i) for d, i, *_ in want}
