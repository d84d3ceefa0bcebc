"""The pipeline against a plain run of its stages."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_decontam import brute as plain_leaks  # noqa: E402
from test_neardup import brute as plain_groups  # noqa: E402
from test_packing import check as check_windows  # noqa: E402
from test_quality import recount  # noqa: E402
from test_secrets import spans_of  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402
from lexspan.llm.neardup import NearDup  # noqa: E402
from lexspan.llm.quality import judge, trusted_documents  # noqa: E402
from lexspan.session import shared_dir  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_redaction(text):
    out, at = [], 0
    for start, _, end in spans_of(text)[1]:
        if start >= at:
            out.append(text[at:start] + "[SECRET]")
        at = max(at, end)
    return "".join(out) + text[at:]


def test_stages_and_columns():
    assert 4 <= len(pipeline.STAGES) <= 5
    assert [n for n, _ in pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "benchmark_decontamination", "secret_scan", "packing",
    ]


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    verdict = {r.doc_id: r for r in judge(docs, trusted_documents(spark, SF)).collect()}
    for r in verdict.values():
        assert r.base_failed == recount(r.text)[5]
    rows = [(d, r.text) for d, r in verdict.items() if r.kept]
    kept = {d for d, _, _, stays in plain_groups(rows, NearDup()) if stays}
    rows = [r for r in rows if r[0] in kept]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {d for d, *_ in plain_leaks(rows, items)}
    assert gone and len(kept) < len(verdict)
    rows = [(d, plain_redaction(t)) for d, t in rows if d not in gone]
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    pieces = pipeline.run(spark, SF)
    check_windows(rows, [r.asDict() for r in pieces.collect()])
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert left == {f"stage-{name}" for name, _ in pipeline.STAGES}  # the rest is deleted


def test_stages_on_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(None, long, "en", "s", 1), (1, long, None, None, None), (1, long, "en", "s", 1), (2, None, "en", "s", None),
            (3, "", "en", "s", 0), (4, "password=abcdef0123456789 " + long, "en", "s", 9)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], DOCS + ", kept string")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == pipeline.COLUMNS
        assert stage(spark, docs.limit(0), SF).count() == 0
    # The copies of document 1, one of them without an id, go.
    ids = [r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(ids) in ([1, 2, 3], [1, 2, 3, 4])
    clean = {r.doc_id: r for r in pipeline.redact_secrets(spark, docs, SF).collect()}
    assert clean[2].text is None and clean[4].text == "[SECRET] " + long and clean[4].n_chars == len(clean[4].text)
    check_windows([(r[0], r[1]) for r in rows[1:]], [p.asDict() for p in pipeline.pack(spark, docs.filter("doc_id is not null"), SF).collect()])
    assert pipeline.pack(spark, docs.limit(0), SF).count() == 0


def test_ids_that_are_null_or_repeat(spark):
    def text(k, n=60):
        return " ".join(f"t{k}x{i}" for i in range(n))

    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(7, text(1)), (7, text(2)), (7, text(1)), (None, text(3)), (None, text(3)), (None, text(4)), (9, text(4)),
            (None, item), (None, text(5) + ". " + item + " " + text(6)), (5, text(7, 20_000)), (6, text(7, 20_000) + " end")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], DOCS).repartition(4)
    stay = [(7, text(1)), (7, text(2)), (None, text(3)), (9, text(4)), (None, item), rows[8], rows[9]]
    got = pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(stay, key=repr)
    got = pipeline.drop_leaks(spark, docs, SF).collect()
    stay = [r for r in rows if r[1] not in (rows[7][1], rows[8][1])]
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted(stay, key=repr)
