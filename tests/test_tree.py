"""Files listed and read in tasks: hidden directories, broken files, files of any size by byte ranges."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tests.test_files import TEXTS, TREE, by_name
from tests.test_segments import FRAGMENTS
from veilspan import check
from veilspan.operators.detect import detect, explode_findings
from veilspan.operators.segments import detect_units, findings_of_units
from veilspan.sources import ranges, tree, versions


@pytest.fixture
def given_tree(tmp_path):
    root = tmp_path / "in"
    for name, content in {**TREE, "a/b/c/d/e.txt": b"deep", "a/.x/_y/z.log": b"hidden way", "100%/50%25 é.md": b"odd"}.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    os.symlink(root / "a", root / "link")
    os.symlink(root / "a.txt", root / "to_file.txt")
    os.symlink(root / "nowhere", root / "broken.txt")
    os.mkfifo(root / "pipe.txt")
    return str(root)


def walked(root):
    """What the walk should see, by the standard library's."""
    found = {}
    for folder, _, names in os.walk(root):
        for name in names:
            path = os.path.join(folder, name)
            if not name.startswith(".") and os.path.isfile(path):
                found[path] = os.path.getsize(path)
    return found


@pytest.mark.parametrize("budget", [1, 3, 10_000])
@pytest.mark.parametrize("front", ["", "file:", "file://"])
def test_walk_sees_hidden_directories(spark, given_tree, budget, front):
    rows = tree.walk(spark, front + given_tree, budget=budget).collect()
    assert {r.path: r.length for r in rows if r.error is None} == {front + p: n for p, n in walked(given_tree).items()}
    assert len(rows) == len({r.path for r in rows})
    assert [(os.path.basename(r.path), bool(r.error)) for r in rows if r.error] == [("broken.txt", True)]
    assert all(r.modified is not None for r in rows if r.error is None)


def test_stores_are_listed_like_mounted_folders(spark, given_tree, monkeypatch):
    """The way of other stores, over the mounted one: the same files and contents."""
    expected = sorted((p, n, None, False, None) for p, n in walked(given_tree).items())
    monkeypatch.setattr(tree, "local_path", lambda path: None)
    seen, waiting = [], ["file://" + given_tree]
    while waiting:
        for path, length, _, is_directory, error in tree._entries(waiting.pop()):
            if is_directory and "/link" not in path:
                waiting.append(path)
            elif not is_directory and not path.endswith("pipe.txt"):
                seen.append((path.removeprefix("file://"), length, None, False, error))
    assert sorted(x for x in seen if not x[0].endswith("broken.txt")) == expected
    assert tree.read_bytes(f"file://{given_tree}/a/b/c/d/e.txt", 1, 3) == b"ee"
    assert not tree.listable("viewfs://store/in") and not tree.listable("nothing")
    assert list(tree._entries(f"file://{given_tree}/none"))[0][4]


def test_directories_and_files_that_fail_are_rows(spark, given_tree):
    files = tree.text_files(tree.walk(spark, [given_tree, given_tree + "/none"]))
    gone = os.path.join(given_tree, "cp.txt")
    os.remove(gone)
    read = {r.path: r for r in tree.read_documents(files).collect()}
    assert "No such file" in read[gone].unread and read[gone].text is None
    assert "No such file" in read[given_tree + "/none"].unread
    texts = {os.path.basename(p): r.text for p, r in read.items() if r.unread is None}
    expected = {**TEXTS, "_us.txt": "u", "q.md": "q", "HEAD": "ref", "e.txt": "deep", "z.log": "hidden way", "50%25 é.md": "odd", "to_file.txt": "héllo\nx"}
    del expected["cp.txt"]
    assert texts == expected


def test_check_goes_on_past_broken_files(spark, tmp_path):
    root = tmp_path / "in"
    (root / ".git").mkdir(parents=True)
    (root / ".git" / "config").write_text("mail someone@example.com now")
    (root / "w.txt").write_bytes("é\r\nplain".encode("latin-1"))
    os.symlink(root / "nowhere", root / "broken.ini")
    out = str(tmp_path / "out")
    with check(spark, str(root), out) as result:
        status = {os.path.basename(r["path"]): r for r in result.scrub_status.collect()}
        assert {n: r["status"] for n, r in status.items()} == {"config": "modified", "w.txt": "skipped", "broken.ini": "errors"}
        assert status["broken.ini"]["error"].startswith("Failed modifying ") and "No such file" in status["broken.ini"]["error"]
        summary = {r["status"]: r["n_files"] for r in result.scrub_summary.collect()}
        assert summary == {"modified": 1, "skipped": 1, "errors": 1}
    current = versions.read_current(spark, out)
    assert by_name(current, "text") == {"config": "mail **********ample.com now", "w.txt": "é\nplain", "broken.ini": None}
    assert by_name(current, "encoding")["w.txt"] == "latin-1" and by_name(current, "had_crlf")["w.txt"] is True


def written_files(folder, rng, n=40):
    """Files of odd texts in both encodings, with every kind of line end, some of them invalid in the middle."""
    for i in range(n):
        text = rng.choice([" ", " ", "\n"]).join(rng.choice(FRAGMENTS) for _ in range(rng.choice([1, 30, 300])))
        text = text.replace("\n", rng.choice(["\n", "\r\n", "\r"]))
        encoded = [text.encode(), text.encode("latin-1", "replace"), text.encode() + b"\xff end \xe9 x " + text.encode()][i % 3]
        (folder / f"f{i}.txt").write_bytes(encoded)


@pytest.mark.parametrize("size", [1, 64, 1 << 20])
def test_ranges_give_the_texts_and_findings_of_whole_files(spark, tmp_path, size):
    written_files(tmp_path, random.Random(size), 12 if size == 1 else 40)
    files = tree.text_files(tree.walk(spark, str(tmp_path)))
    whole = tree.read_documents(files)
    units, unreadable = ranges.units_of_files(files, size=size)
    assert unreadable.count() == 0
    joined = {}
    for r in sorted(units.collect(), key=lambda r: (r.path, r.unit)):
        text, *form = joined.setdefault(r.path, ["", r.encoding, r.had_crlf])
        assert r.unit_start == len(text)
        joined[r.path] = [text + r.text, *form]
    assert joined == {r.path: [r.text, r.encoding, r.had_crlf] for r in whole.collect()}
    if size == 1:
        assert units.count() > 5 * len(joined)
    key = ["path", "start", "end", "entity", "value", "score"]
    found = findings_of_units(detect_units(units), "path").select(*key).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, explode_findings(detect(whole), "path").select(*key).collect()))


def test_cuts_stand_where_texts_may_be_cut(tmp_path):
    path = tmp_path / "f"
    path.write_bytes(b"ab cr\nx\r\nyz  end" + b"x" * 5000 + b" q")
    assert ranges.first_cut(str(path), 0, 20) == 2
    assert ranges.first_cut(str(path), 3, 20, 2) == 11
    assert ranges.first_cut(str(path), 12, 16) is None
    assert ranges.first_cut(str(path), 12, 6000, 7) == 5016
    assert ranges.first_cut(str(path), 2, 3) == 2


def test_check_of_large_files(spark, tmp_path, monkeypatch):
    root = tmp_path / "in"
    root.mkdir()
    rng = random.Random(9)
    written_files(root, rng, 15)
    os.symlink(root / "nowhere", root / "broken.ini")
    entries, outs = [], []
    for limit, size in ((tree.WHOLE, ranges.SIZE), (50, 30)):
        monkeypatch.setattr(tree, "WHOLE", limit)
        monkeypatch.setattr(ranges.units_of_files, "__defaults__", ("line", size, None))
        outs.append(str(tmp_path / f"out{limit}"))
        with check(spark, str(root), outs[-1]) as result:
            entries.append(sorted((r.path, r.start, r.end, r.entity, r.value) for r in result.findings.collect()))
            statuses = by_name(result.scrub_status, "status")
            outs[-1] = (outs[-1], statuses)
    assert entries[0] == entries[1]

    def texts(out):
        rows = versions.read_current(spark, out).select("path", "unit", "text").collect()
        assert out.endswith("50") == (len(rows) > 30)
        whole = {}
        for r in sorted(rows):
            whole[r.path] = whole.get(r.path, "") + (r.text or "")
        return whole

    assert texts(outs[0][0]) == texts(outs[1][0]) and outs[0][1] == outs[1][1]
    assert outs[0][1]["broken.ini"] == "errors"
    for out, _ in outs:
        versions.rollback(spark, out)
    assert texts(outs[0][0]) == texts(outs[1][0])
    originals = {r.path: r.text or "" for r in tree.read_documents(tree.text_files(tree.walk(spark, str(root)))).collect()}
    assert texts(outs[1][0]) == originals


def test_files_too_large_to_be_cut_are_errors(spark, tmp_path, monkeypatch):
    from veilspan.plans import scan
    from veilspan.recognizers import DEFAULT_RECOGNIZERS

    (tmp_path / "a.txt").write_text("id T-77 and mail someone@example.com " * 3)
    (tmp_path / "b.txt").write_text("id T-5")
    monkeypatch.setattr(scan, "MAX_BYTES", 30)
    own = DEFAULT_RECOGNIZERS.only(["EMAIL_ADDRESS"]).with_recognizer("TICKET", r"T-\d+", 0.9)
    result = check(spark, str(tmp_path), scrub_files=False, recognizers=own, policy={**scan.DEFAULT_POLICY, "TICKET": scan.DEFAULT_POLICY["ADDRESS"]})
    assert by_name(result.redacted, "unread") == {"a.txt": "larger than 30 bytes", "b.txt": None}
    assert [r.value for r in result.findings.collect()] == ["T-5"]
    monkeypatch.setattr(ranges, "LARGEST", 40)
    (tmp_path / "b.txt").write_text("x" * 90)
    (tmp_path / "c.txt").write_text("a word and one more")
    units, unreadable = ranges.units_of_files(tree.text_files(tree.walk(spark, str(tmp_path))), size=8)
    assert by_name(unreadable, "unread") == {"b.txt": "no place to cut within 40 bytes"}
    assert {os.path.basename(r.path) for r in units.select("path").distinct().collect()} == {"a.txt", "c.txt"}
    files = tree.text_files(tree.walk(spark, str(tmp_path))).where(F.col("path").endswith("c.txt")).cache()
    files.count()
    os.remove(tmp_path / "c.txt")
    units, unreadable = ranges.units_of_files(files, size=8)
    assert "No such file" in by_name(unreadable, "unread")["c.txt"] and units.count() == 0
