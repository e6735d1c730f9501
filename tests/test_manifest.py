"""Versions of changes against a dictionary, two writers, and streams that are cut off."""

import random

import pytest
from pyspark.sql import functions as F

from veilspan.operators.verdict_store import VerdictStore
from veilspan.operators.redact import redact, redact_one
from veilspan.operators.detect import detect
from veilspan.policy import DEFAULT_POLICY, Rule, custom_batch
from veilspan.recognizers import DEFAULT_RECOGNIZERS
from veilspan.sources import manifest
from veilspan.sources.manifest import Conflict, Entry, RepeatedKey
from veilspan.streaming import scrub
from veilspan.streaming.scrub import scrub_batch, start_scrub

DOC = "path string, text string"


def texts(spark, root, entry=None):
    return {r.path: r.text for r in manifest.read_merged(spark, root, entry=entry).collect()}


def scrubbed(spark, state, new):
    rows = [(k, state[k], v) for k, v in {**state, **new}.items()]
    return spark.createDataFrame(rows, DOC + ", redacted string")


def test_chain_of_changes_is_the_dictionary(spark, tmp_path):
    root, rng = str(tmp_path / "m"), random.Random(1)
    state = {**{f"d{k}": f"text {k}" for k in range(40)}, None: "without a key"}
    entry = manifest.write_full(spark.createDataFrame(list(state.items()), DOC), root, Entry())
    seen = [(entry, dict(state))]
    for step in range(4):
        new = {k: f"changed {step}" for k in rng.sample(list(state), [7, 0, 40, 3][step])}
        entry = manifest.write_changes(scrubbed(spark, state, new), root, entry)
        state.update(new)
        seen.append((entry, dict(state)))
        status = {r.path: r.status for r in manifest.read_status(spark, root, entry.chain[-1]).collect()}
        assert status == {k: "modified" if k in new else "skipped" for k in state}
        rows = spark.read.parquet(f"{root}/data/version={entry.chain[-1]}")
        kinds = {r.kind: r.n for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        # Only what changed is kept, once as new and once as it was.
        assert kinds == {"status": 41} | ({"new": len(new), "original": len(new)} if new else {})
        assert texts(spark, root) == state
    whole = manifest.compact(spark, root)
    assert whole.number == 6 and len(whole.chain) == 1 and texts(spark, root) == state
    for entry, then in seen:
        assert texts(spark, root, entry) == then


def test_only_one_of_two_writers_publishes(spark, tmp_path):
    root = str(tmp_path / "m")
    start = manifest.write_full(spark.createDataFrame([("a", "1"), ("b", "2")], DOC), root, Entry())
    first = manifest.write_changes(scrubbed(spark, {"a": "1", "b": "2"}, {"a": "x"}), root, start)
    with pytest.raises(Conflict):
        manifest.write_changes(scrubbed(spark, {"a": "1", "b": "2"}, {"b": "y"}), root, start)
    with pytest.raises(Conflict):
        manifest.write_full(spark.createDataFrame([("a", "1")], DOC), root, Entry())
    assert manifest.current(spark, root) == first and texts(spark, root) == {"a": "x", "b": "2"}
    again = manifest.write_changes(scrubbed(spark, {"a": "x", "b": "2"}, {"b": "y"}), root, manifest.current(spark, root))
    assert again.number == 3 and texts(spark, root) == {"a": "x", "b": "y"}
    assert not [p for p in (tmp_path / "m" / "log").iterdir() if "draft" in p.name and not p.name.endswith(".crc")]


def test_keys_name_one_document(spark, tmp_path):
    root = str(tmp_path / "m")
    assert manifest.current(spark, root) == Entry()
    with pytest.raises(RepeatedKey):
        manifest.write_full(spark.createDataFrame([("a", "1"), ("a", "2")], DOC), root, Entry())
    with pytest.raises(ValueError, match="nothing was published"):
        manifest.read_merged(spark, root)


def test_a_batch_is_published_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "m")
    df = spark.createDataFrame([("a", "mail a@b.com now"), ("b", "plain")], DOC)
    scrub_batch(df, 0, root)
    one = manifest.current(spark, root)
    scrub_batch(df, 0, root)
    assert manifest.current(spark, root) == one and one.batches == {"stream": 0}
    # A try that dies between writing and publishing is made good by the next one.
    commit = manifest.commit
    monkeypatch.setattr(manifest, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        scrub_batch(spark.createDataFrame([("b", "b@c.de"), ("c", "new")], DOC), 1, root)
    monkeypatch.setattr(manifest, "commit", commit)
    assert texts(spark, root) == {"a": "mail ******* now", "b": "plain"}
    scrub_batch(spark.createDataFrame([("b", "b@c.de"), ("c", "new")], DOC), 1, root)
    assert texts(spark, root) == {"a": "mail ******* now", "b": "******", "c": "new"}

    # Another writer between two batches is no conflict: the batch goes behind it.
    def late(spark_, root_, entry):
        monkeypatch.setattr(manifest, "commit", commit)
        manifest.write_batch(detect(spark.createDataFrame([("z", "other")], DOC)).withColumn("redacted", F.col("text")), root, "other", 5)
        return commit(spark_, root_, entry)

    monkeypatch.setattr(manifest, "commit", late)
    scrub_batch(spark.createDataFrame([("d", "d")], DOC), 2, root)
    entry = manifest.current(spark, root)
    assert entry.batches == {"stream": 2, "other": 5} and {"z", "d"} <= set(texts(spark, root))


def test_stream_with_names_verdicts_and_compaction(spark, tmp_path):
    folder, root, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    rows = [(f"d{k}", f"John Doe wrote u{k}@mail.org and Ann Lee") for k in range(6)]
    for k in range(0, 6, 2):
        spark.createDataFrame(rows[k : k + 2], DOC).coalesce(1).write.mode("append").parquet(folder)
    names = spark.createDataFrame([("John Doe",), ("Ann Lee",)], "name string")
    verdicts = spark.createDataFrame([("PERSON", "John Doe", "True")] + [("EMAIL_ADDRESS", f"u{k}@mail.org", "True") for k in range(3)], "entity string, value string, response string")
    stream = spark.readStream.schema(DOC).option("maxFilesPerTrigger", 1).parquet(folder)
    start_scrub(stream, root, mark, names=names, verdicts=verdicts, compact_every=2).awaitTermination()
    expected = {f"d{k}": f"[REDACTED] wrote {'**********g' if k < 3 else f'u{k}@mail.org'} and Ann Lee" for k in range(6)}
    assert texts(spark, root) == expected
    entry = manifest.current(spark, root)
    assert entry.batches["stream"] == 2 and len(entry.chain) == 1
    start_scrub(stream, root, mark, names=names, verdicts=verdicts).awaitTermination()
    assert manifest.current(spark, root) == entry
    assert scrub.manifest is manifest


# Verdicts


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def findings(spark, values):
    return spark.createDataFrame([(k, "US_SSN", v, 0.9) for k, v in enumerate(values)], "doc_id int, entity string, value string, score double")


def test_only_new_values_are_asked(spark, tmp_path):
    def classifier(batch):
        return [None if v == "none" else str(v.startswith("t")) for v in batch["value"]]

    store = VerdictStore(spark, str(tmp_path / "s"), 4)
    first = store.ask(findings(spark, ["t1", "f1", "t1", "none"]), classifier)
    assert sorted((r.value, r.response) for r in first.collect() if r.response) == [("f1", "False"), ("t1", "True")]
    later = VerdictStore(spark, str(tmp_path / "s") + "/", 4)
    assert later.name == store.name
    second = later.ask(findings(spark, ["t1", "t2", "f1", "none"]), classifier)
    assert sorted(r.value for r in second.collect()) == ["none", "t2"]
    found = findings(spark, ["t1", "f1", "t2", "new", "none"])
    assert sorted(r.value for r in later.confirm(found).collect()) == ["t1", "t2"]
    assert sorted(r.value for r in later.confirm(found, on_missing="keep").collect()) == ["new", "none", "t1", "t2"]
    # Another session, which does not know the table yet.
    other = VerdictStore(spark.newSession(), str(tmp_path / "s"), 4)
    assert other.table().count() == 3


@pytest.mark.parametrize("partitions", ["8", "32"])
def test_the_store_is_not_shuffled(spark, tmp_path, partitions):
    store = VerdictStore(spark, str(tmp_path / "s"), 8)
    rows = "concat('E', id % 3) as entity", "cast(id as string) as value"
    store.add(spark.range(1000).selectExpr(*rows, "'True' as response"))
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": partitions}
    before = {name: spark.conf.get(name) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        found = spark.range(100).selectExpr("cast(id as int) as doc_id", *rows, "0.9d as score")
        for df in (store.confirm(found), store.unknown(found)):
            plan = plan_of(df)
            # The findings have the only exchange; none stands above the store's scan.
            assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("Range") < plan.index("Bucketed: true")
            assert df.count() in (0, 100)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


# Batch rules


def test_batch_rules_see_each_value_once_a_batch(spark):
    def batch(values):
        if any("fail" in v for v in values):
            raise RuntimeError("no answer")
        assert len(set(values)) == len(values)
        return [None if v.startswith("n") else v.upper() for v in values]

    rows = [(k, "a@b.com n@b.com a@b.com 123-45-6789") for k in range(50)] + [(99, "fail@b.com z@b.com"), (100, None), (101, "")]
    df = spark.createDataFrame(rows, "doc_id int, text string").coalesce(2)
    chosen = DEFAULT_RECOGNIZERS.only(["EMAIL_ADDRESS", "US_SSN"])
    for on_null, masked in (("mask", "A@B.COM ******* A@B.COM *******6789"), ("error", None)):
        policy = {**DEFAULT_POLICY, "EMAIL_ADDRESS": custom_batch(batch, on_null)}
        done = redact(detect(df, recognizers=chosen), policy=policy)
        got = {r.doc_id: r.redacted for r in done.collect()}
        assert got[7] == masked and got[100] is None and got[101] == "" and "_replaced" not in done.columns
        assert got[99] == ("********** Z@B.COM" if on_null == "mask" else None)
    with pytest.raises(ValueError):
        Rule("batch")
    with pytest.raises(ValueError, match="use redact"):
        redact_one(F.col("text"), next(iter(chosen)), chosen, custom_batch(batch))
