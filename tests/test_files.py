import os

import pytest
from pyspark.sql import functions as F

from veilspan import check
from veilspan.functions.text import extension
from veilspan.sources import versions
from veilspan.sources.files import (
    check_directory,
    coverage,
    decode,
    documents_of,
    file_kind,
    list_files,
    read_documents,
    text_files,
)

TREE = {
    "a.txt": "héllo\r\nx".encode(),
    "b.LOG": "café".encode("latin-1"),
    "cp.txt": b"\x93q\x94",
    "bom.txt": b"\xef\xbb\xbfz",
    "README": b"noext",
    "sub/x.tar.json": b"{}",
    "sub/x.yaml": b"y",
    "sub/i.png": b"\x89PNG",
    "sub/d.PDF": b"%PDF",
    "a.txt.backup_20250101_000000": b"old",
    "sub/e.txt": b"",
    ".hid.txt": b"h",
    "_us.txt": b"u",
    "_d/q.md": b"q",
    ".git/HEAD": b"ref",
    "sub/with space.md": b"s p",
}
TEXTS = {
    "a.txt": "héllo\nx", "b.LOG": "café", "cp.txt": "\x93q\x94", "bom.txt": "﻿z", "README": "noext",
    "x.tar.json": "{}", "with space.md": "s p",
}


@pytest.fixture
def tree(tmp_path):
    for name, content in TREE.items():
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(tmp_path / "in")


def test_documents(spark, tree):
    rows = read_documents(spark, tree).collect()
    assert {os.path.basename(r["path"]): r["text"] for r in rows} == TEXTS


def test_other_files_are_not_even_read(spark, tree):
    """Extension tests prune the file listing: the scan covers the text files only."""
    scan = text_files(list_files(spark, tree))
    assert sum(1 for _ in scan.collect()) == len(TEXTS)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "_metadata" in plan or "file_name" in plan
    os.chmod(os.path.join(tree, "sub", "i.png"), 0)
    # With corrupt files not ignored, reading the image would fail for a normal user.
    strict = text_files(list_files(spark, tree, ignore_corrupt=False))
    assert documents_of(strict).count() == len(TEXTS)


def test_several_roots(spark, tree, tmp_path):
    other = tmp_path / "two"
    other.mkdir()
    (other / "z.md").write_text("zed")
    assert read_documents(spark, [tree, str(other)]).count() == len(TEXTS) + 1


def test_kinds(spark, tree):
    rows = coverage(list_files(spark, tree).select("path")).collect()
    assert {r["kind"]: r["n"] for r in rows} == {"text": 7, "image": 1, "pdf": 1, "other": 2}


def test_extension_rules(spark):
    cases = {"x.tar.json": ".json", "README": "", ".bashrc": "", "a.": ".", "..a": "", "/d.d/f": "", "/p/A.TxT": ".txt", "a.b\nc.md": ".md"}
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    got = {r["path"]: r["e"] for r in df.select("path", extension(F.col("path")).alias("e")).collect()}
    assert got == cases == {p: os.path.splitext(p)[1].lower() for p in cases}
    assert df.where(file_kind(F.col("path")) == "text").count() == 7


def test_decode_every_byte(spark):
    cases = [bytes([b]) for b in range(256)] + [b"\xc3\xa9", b"\xed\xa0\x80", b"\xf0\x9f\x98\x80", b"a\rb\r\nc\n"]

    def python(raw):
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            text = raw.decode("latin-1")
        return text.replace("\r\n", "\n").replace("\r", "\n")

    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, content binary")
    rows = df.select(decode(F.col("content")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in rows] == [python(c) for c in cases]


@pytest.mark.parametrize("bad", ["", "  ", "/no/such/place", __file__, "https://example.org/r.git"])
def test_bad_paths(spark, bad):
    with pytest.raises(ValueError):
        check_directory(spark, bad)


@pytest.fixture
def secrets(tmp_path):
    root = tmp_path / "src"
    root.mkdir()
    (root / "a.txt").write_text("mail someone@example.com now")
    (root / "b.ini").write_text("plain words")
    (root / "c.log").write_text("ssn 123-45-6789\n")
    return str(root)


def by_name(df, column):
    return {os.path.basename(r["path"]): r[column] for r in df.collect()}


def test_check_scrubs_with_backup_and_restores(spark, secrets, tmp_path):
    out = str(tmp_path / "out")
    result = check(spark, secrets, out)
    assert by_name(versions.read_current(spark, out), "text") == {
        "a.txt": "mail **********ample.com now", "b.ini": "plain words", "c.log": "ssn *******6789\n",
    }
    assert by_name(result.scrub_status, "status") == {"a.txt": "modified", "b.ini": "skipped", "c.log": "modified"}
    backup = by_name(result.scrub_status, "backup_path")
    folder, _, key = backup["a.txt"].partition("#")
    assert backup["b.ini"] is None and os.path.basename(key) == "a.txt"
    kept = spark.read.parquet(folder).where(F.col("path") == key).collect()
    assert [r["text"] for r in kept] == ["mail someone@example.com now"]
    summary = {r["status"]: (r["n_files"], r["n_backups"]) for r in result.scrub_summary.collect()}
    assert summary == {"modified": (2, 2), "skipped": (1, 0)}
    assert by_name(versions.read_backups(spark, out), "text") == {
        "a.txt": "mail someone@example.com now", "c.log": "ssn 123-45-6789\n",
    }
    assert open(os.path.join(secrets, "a.txt")).read() == "mail someone@example.com now"

    version = versions.rollback(spark, out)
    assert versions.current_version(spark, out) == version
    assert by_name(versions.read_current(spark, out), "text") == {
        "a.txt": "mail someone@example.com now", "b.ini": "plain words", "c.log": "ssn 123-45-6789\n",
    }


def test_check_append_and_no_backup(spark, secrets, tmp_path):
    out = str(tmp_path / "out")
    result = check(spark, secrets, out, create_backup=False, append_to_files=True)
    texts = by_name(versions.read_current(spark, out), "text")
    assert texts["b.ini"] == "plain words\nplain words"
    assert texts["a.txt"] == "mail someone@example.com now\nmail **********ample.com now"
    assert set(by_name(result.scrub_status, "status").values()) == {"modified"}
    assert set(by_name(result.scrub_status, "backup_path").values()) == {None}
    assert not os.path.exists(f"{out}/data/version={versions.current_version(spark, out)}/kind=original")


def test_check_without_scrubbing(spark, secrets):
    result = check(spark, secrets, scrub_files=False)
    assert result.scrub_summary is None and result.scrub_status is None
    assert [r["entry"] for r in result.entries.collect()] == [
        "EMAIL_ADDRESS=someone@example.com:0.96", "US_SSN=123-45-6789:0.9",
    ]
    with pytest.raises(ValueError):
        check(spark, secrets)


def test_check_with_classifier(spark, secrets, tmp_path):
    out = str(tmp_path / "out")
    check(spark, secrets, out, classifier=lambda b: ["True" if e == "US_SSN" else "no" for e in b["entity"]])
    assert by_name(versions.read_current(spark, out), "text") == {
        "a.txt": "mail someone@example.com now", "b.ini": "plain words", "c.log": "ssn *******6789\n",
    }


def test_empty_directory(spark, tmp_path):
    (tmp_path / "none").mkdir()
    result = check(spark, str(tmp_path / "none"), str(tmp_path / "out"))
    rows = result.scrub_status.collect()
    assert [(r["status"], r["error"]) for r in rows] == [("errors", "No text files found.")]


def test_written_report(spark, secrets, tmp_path):
    from veilspan.operators.report import write_report

    result = check(spark, secrets, scrub_files=False)
    write_report(result.findings, str(tmp_path / "report"), "path")
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert sorted(lines) == ["EMAIL_ADDRESS=someone@example.com:0.96", "US_SSN=123-45-6789:0.9"]


def test_second_run_restores_the_newest_backup(spark, secrets, tmp_path):
    out = str(tmp_path / "out")
    check(spark, secrets, out)
    with open(os.path.join(secrets, "c.log"), "w") as f:
        f.write("ssn 999-99-9999")
    check(spark, secrets, out)
    current = versions.read_current(spark, out).select("path", "text")
    restored = versions.restore(current, versions.read_backups(spark, out), "path")
    assert restored.count() == 3
    assert by_name(restored, "text")["c.log"] == "ssn 999-99-9999"


def test_too_large_files_are_errors_where_only_spark_lists(spark, secrets, tmp_path, monkeypatch):
    from veilspan.sources import files, tree

    monkeypatch.setattr(tree, "listable", lambda path: False)
    monkeypatch.setattr(files.documents_of, "__defaults__", (False, 20))
    monkeypatch.setattr(files.oversized, "__defaults__", (20,))
    result = check(spark, secrets, str(tmp_path / "out"))
    assert by_name(result.scrub_status, "status") == {"a.txt": "errors", "b.ini": "skipped", "c.log": "modified"}
    assert "larger than 20 bytes" in by_name(result.scrub_status, "error")["a.txt"]


def test_form_of_files_is_known(spark, tmp_path):
    from veilspan.sources.files import documents_of, list_files, text_files

    (tmp_path / "w.txt").write_bytes("é\r\n".encode("latin-1"))
    (tmp_path / "u.txt").write_bytes("é\n".encode())
    rows = documents_of(text_files(list_files(spark, str(tmp_path))), details=True)
    assert by_name(rows, "encoding") == {"w.txt": "latin-1", "u.txt": "utf-8"}
    assert by_name(rows, "had_crlf") == {"w.txt": True, "u.txt": False}


def test_reports_of_nothing_hold_one_line(spark, tmp_path):
    from veilspan.operators.report import NOTHING_FOUND, NOTHING_REDACTED, redacted_in_order, write_report

    (tmp_path / "plain.txt").write_text("plain words")
    result = check(spark, str(tmp_path), scrub_files=False)
    write_report(result.findings, str(tmp_path / "report"), "path")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()] == [NOTHING_FOUND]
    assert [r["redacted"] for r in redacted_in_order(result.redacted, "path").collect()] == ["plain words"]
    assert [r["redacted"] for r in redacted_in_order(result.redacted.limit(0), "path").collect()] == [NOTHING_REDACTED]
