import random

from pyspark.sql import functions as F

from veilspan.sources import versions
from veilspan.sources.pages import assemble_pages, assemble_segments, page_blocks


def brute(rows):
    out = {}
    for doc, page, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, r[2] is not None, r[2] or "")):
        pages = out.setdefault(doc, [])
        n = len(pages) + 1
        pages.append(f"\n--- Page {n} ---\n{text}" if text else f"\n--- Page {n} (No text extracted or error) ---\n")
    return out


def test_pages_of_any_number(spark):
    rng = random.Random(2)
    # Document 0 holds most pages; some page numbers and document ids are null, some numbers far apart.
    rows = [(0, p, f"text {p}") for p in rng.sample(range(5000), 900)]
    rows += [(d, p, rng.choice(["x", "", None])) for d in range(1, 30) for p in range(rng.randrange(1, 12))]
    rows += [(30, 1, "a"), (30, 1000, "b"), (30, None, "c"), (30, None, None), (31, 5000, "d"), (None, 1, "e"), (None, None, "f"), (32, -7, "g")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc int, page int, text string")
    want = brute(rows)
    for span in (1, 7, 100, 100000):
        blocks = page_blocks(df, "doc", "page", span=span)
        got = {}
        for r in sorted(blocks.collect(), key=lambda r: r["n"]):
            got.setdefault(r["doc"], []).append(r["block"])
            assert len(got[r["doc"]]) == r["n"]
        assert got == want
    assert {r["doc"]: r["text"] for r in assemble_pages(blocks, "doc").collect()} == {d: "".join(p) for d, p in want.items()}
    parts = {(r["doc"], r["segment"]): r["text"] for r in assemble_segments(blocks, "doc", 4).collect()}
    assert parts[0, 3] == "".join(want[0][12:16])


def test_versions_are_published_whole(spark, tmp_path):
    root = str(tmp_path / "v")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "path int, text string")
    first = versions.write_version(df, root)
    second = versions.write_version(df.withColumn("text", F.upper("text")), root)
    assert versions.current_version(spark, root) == second != first
    assert {r["text"] for r in versions.read_current(spark, root).collect()} == {"A", "B"}
    versions.publish(spark, root, first)
    assert {r["text"] for r in versions.read_current(spark, root).collect()} == {"a", "b"}


def test_latest_backup_wins_by_exact_key(spark):
    rows = [("a.txt", "20250101_000000", "1"), ("a.txt", "20250102_000000", "2"), ("a.txt2", "20250103_000000", "3")]
    backups = spark.createDataFrame(rows, "path string, ts string, text string")
    latest = {r["path"]: r["text"] for r in versions.latest_backup(backups, "path").collect()}
    assert latest == {"a.txt": "2", "a.txt2": "3"}


def test_one_bad_row_does_not_stop_the_others(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "a", None), (3, " a", "a\n")], "path int, text string, redacted string")
    rows = {r["path"]: (r["status"], r["error"]) for r in versions.scrub_status(df).collect()}
    assert rows == {1: ("modified", None), 2: ("errors", "Failed modifying 2: no redacted text"), 3: ("skipped", None)}


def test_unmatched_both_ways(spark):
    left = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    right = spark.createDataFrame([(2,), (3,)], "k int")
    rows = {(r["k"], r["problem"]) for r in versions.unmatched(left, right, "k").collect()}
    assert rows == {(1, "no redacted result"), (3, "no source document")}
