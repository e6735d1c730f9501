"""Findings of the fourth round: whole tables are read, and short ranges are dealt by their bytes."""

import os

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from veilspan.functions.words import listed_names
from veilspan.plans.catalogue import QUERIES
from veilspan.sources import manifest, ranges, tree
from veilspan.streaming import scrub


def documents_table(spark, path, rows):
    """Rows (doc_id, text, times): the text repeated so often."""
    df = spark.createDataFrame(rows, "doc_id long, text string, times int").select("doc_id", F.expr("repeat(text, times)").alias("text"))
    df.coalesce(1).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_scan_tree_gives_documents_of_any_size(spark, tmp_path):
    """a document of more than ``tree.WHOLE`` bytes is a row, and so is one without an id."""
    long = tree.WHOLE + 10
    rows = [(1, "a", 1), (2, "x", long), (None, "no id", 1)]
    found = QUERIES["scan_tree"](spark, documents_table(spark, tmp_path, rows)).select("doc_id", F.length("text").alias("n")).collect()
    assert {(r.doc_id, r.n) for r in found} == {(1, 2), (2, long + 1), (None, 6)}


def test_texts_that_cannot_be_read_are_not_left_out(spark, tmp_path, monkeypatch):
    """reading fails with the reason, where rows were missing without a word."""
    (tmp_path / "a.txt").write_text("a")
    assert [r.text for r in tree.read_texts(spark, str(tmp_path)).collect()] == ["a"]
    (tmp_path / "b.txt").write_text("b" * 40)
    read = tree.read_texts(spark, str(tmp_path))
    os.remove(tmp_path / "b.txt")
    with pytest.raises(PySparkException, match="b.txt: No such file"):
        read.collect()
    os.symlink(tmp_path / "nowhere", tmp_path / "b.txt")
    with pytest.raises(PySparkException, match="cannot read .*b.txt"):
        tree.read_texts(spark, str(tmp_path)).collect()
    os.remove(tmp_path / "b.txt")
    (tmp_path / "b.txt").write_text("b" * 40)
    monkeypatch.setattr(tree, "MAX_BYTES", 30)
    with pytest.raises(PySparkException, match="b.txt: larger than 30 bytes"):
        tree.read_texts(spark, str(tmp_path)).collect()


def test_scrub_unreadable_scrubs_every_document(spark, tmp_path, monkeypatch):
    """no document is lost unread, be it of a third id, without an id or larger than what is read whole."""
    from veilspan.plans import scan

    rows = [(k, f"to u{k}@mail.example.com " if k % 2 else "none ", 1 + 20 * (k == 3)) for k in range(7)] + [(None, "plain", 1)]
    d = documents_table(spark, tmp_path, rows)
    monkeypatch.setattr(scan.tree, "WHOLE", 100)
    monkeypatch.setattr(scan.units_of_files, "__defaults__", ("line", 50, None))
    found = sorted(QUERIES["scrub_unreadable"](spark, d).select("doc_id", "status", "error").collect(), key=str)
    documents = [(k, "modified" if k is not None and k % 2 else "skipped", None) for k, _, _ in rows]
    lost = [(k, "errors", "Failed modifying : No such file or directory") for k in (0, 3, 6)]
    assert sorted(map(tuple, found), key=str) == sorted(documents + lost, key=str)


def test_short_ranges_are_dealt_by_their_bytes(spark):
    """a task for every 16 ranges was a thousand tasks for 34 MB of files; large ranges are as many tasks as before."""
    wide = 4 * spark.sparkContext.defaultParallelism
    rows = spark.range(100 * wide).selectExpr("cast(id as string) as path", "0L as low", "2000L as high")
    assert ranges._spread(rows, F.col("high") - F.col("low")).rdd.getNumPartitions() == wide
    assert ranges._spread(rows, F.lit(ranges.SIZE).cast("long")).rdd.getNumPartitions() == 100 * wide * ranges.SIZE // ranges.SPLIT


def test_short_ranges_are_read_many_at_a_time(tmp_path, monkeypatch):
    """and long ones still a few at a time."""
    (tmp_path / "f").write_bytes(bytes(range(100)))
    path = [str(tmp_path / "f"), str(tmp_path / "none")]
    low = [10 * k for k in range(10)]
    given = pa.RecordBatch.from_pydict({"path": path[:1] * 9 + path[1:], "segment": list(range(10)), "low": low, "high": [n + 10 for n in low]})
    for most, batches in ((tree.BYTES, [10]), (40, [4, 4, 2]), (1, [1] * 10)):
        monkeypatch.setattr(ranges, "BYTES", most)
        out = list(ranges._reads(given.schema.names, [given]))
        assert [b.num_rows for b in out] == batches
        rows = [r for b in out for r in b.to_pylist()]
        assert [{k: r[k] for k in given.schema.names} for r in rows] == given.to_pylist()
        assert [r["content"] for r in rows] == [bytes(range(n, n + 10)) for n in low[:9]] + [None]
        assert "No such file" in rows[9]["unread"]


def test_a_batch_of_one_split_is_matched_in_many_tasks(spark, tmp_path, monkeypatch):
    """a batch is often one file, and one task matched all its texts."""
    wide = 4 * spark.sparkContext.defaultParallelism
    rows = spark.range(20 * wide).selectExpr("id as doc_id", "concat('mail u', id, '@mail.example.com') as text")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    used, scan = [], scrub.scan

    def watched(documents, *args, **options):
        used.append(documents.select(F.spark_partition_id().alias("p")).distinct().count())
        return scan(documents, *args, **options)

    monkeypatch.setattr(scrub, "scan", watched)
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    scrub.start_scrub(stream, f"{tmp_path}/out", f"{tmp_path}/progress", key="doc_id").awaitTermination()
    assert used == [wide]
    assert manifest.read_merged(spark, f"{tmp_path}/out", "doc_id").where("text like 'mail **%'").count() == rows.count()
    # What many tasks read stays there.
    many = spark.range(0, 100, 1, wide)
    assert scrub._dealt(many) is many


def test_names_are_cut_where_they_are_dealt(spark, tmp_path):
    """the test of their keys does not go below the exchange, with all the cutting."""
    spark.range(9).selectExpr("if(id % 4 = 0, null, concat('Ann  B', id % 3)) as name").coalesce(1).write.parquet(f"{tmp_path}/names")
    listed = listed_names(spark.read.parquet(f"{tmp_path}/names").repartition(5, "name"))
    plan = listed._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("RoundRobin" if "RoundRobin" in plan else "hashpartitioning(name") :]
    assert "regexp_replace" in plan and "regexp_replace" not in scan
    assert sorted(r.key for r in listed.collect()) == ["Ann B0", "Ann B1", "Ann B2"]
