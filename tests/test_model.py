"""The model hook: offsets, labels, failures, and that a worker loads a model once."""

import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from veilspan import scan
from veilspan.operators import model as module
from veilspan.operators.detect import detect, explode_findings
from veilspan.operators.model import ModelHook, characters, model_spans, with_model
from veilspan.sources import versions


def test_byte_offsets_become_characters():
    text = "aé日🙂b"
    for start in range(-1, len(text.encode()) + 3):
        down, up = characters(text, [start], False)[0], characters(text, [start], True)[0]
        inside = len(text.encode()[: max(start, 0)].decode(errors="ignore"))
        assert down == min(inside, len(text))
        assert up == inside + (0 < start < len(text.encode()) and text.encode()[start] & 0xC0 == 0x80)
    assert characters("", [0, 4], True) == [0, 0]


def load():
    """Spans of every capital letter's word; fails on texts that say so."""

    def capitals(texts):
        out = []
        for text in texts:
            if "fail" in text:
                raise RuntimeError("no answer")
            at, spans = 0, []
            for word in text.split(" "):
                if word[:1].isupper():
                    spans.append((at, at + len(word), "PER"))
                at += len(word) + 1
            out.append(spans + [(-5, 2, "ORG"), (3, 3, "PER"), (0, 999, "ORG", None)] * ("odd" in text))
        return out

    return capitals


# Workers cannot import the tests: what they run goes to them by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HOOK = ModelHook("capitals", load, {"PER": "PERSON", "ORG": "ADDRESS"})
ROWS = [(1, "now John Doe called a@b.com"), (2, "please fail Ann"), (3, None), (4, ""), (5, "odd one"), (6, "mail x@y.org")]


def test_spans_are_cut_and_labels_mapped(spark):
    df = spark.createDataFrame(ROWS, "doc_id int, text string")
    found = {r.doc_id: r.s for r in df.select("doc_id", model_spans(F.col("text"), HOOK).alias("s")).collect()}
    assert [(s.start, s.end, s.entity, s.score) for s in found[1]] == [(4, 8, "PERSON", 0.85), (9, 12, "PERSON", 0.85)]
    assert found[2] is None and found[3] is None and found[4] == []
    assert [(s.start, s.end, s.entity) for s in found[5]] == [(0, 2, "ADDRESS"), (0, 7, "ADDRESS")]


@pytest.mark.parametrize("batch", [1, 1 << 20])
def test_findings_join_the_others_and_failures_are_marked(spark, batch):
    df = spark.createDataFrame(ROWS, "doc_id int, text string").coalesce(1)
    detected = with_model(detect(df), HOOK, batch=batch)
    rows = sorted((r.doc_id, r.start, r.end, r.entity, r.value) for r in explode_findings(detected, "doc_id").collect())
    assert rows == [
        (1, 4, 8, "PERSON", "John"), (1, 9, 12, "PERSON", "Doe"), (1, 20, 27, "EMAIL_ADDRESS", "a@b.com"),
        (5, 0, 2, "ADDRESS", "od"), (5, 0, 7, "ADDRESS", "odd one"), (6, 5, 12, "EMAIL_ADDRESS", "x@y.org"),
    ]
    assert {r.doc_id: r.model_failed for r in detected.collect()} == {1: False, 2: True, 3: False, 4: False, 5: False, 6: False}
    with pytest.raises(ValueError, match="unknown entities"):
        with_model(detect(df), ModelHook("x", load, {"PER": "NOBODY"}))


def test_a_text_without_an_answer_is_an_error(spark):
    df = spark.createDataFrame(ROWS, "doc_id int, text string")
    with scan(df, "doc_id", "text", model=HOOK) as result:
        redacted = {r.doc_id: r.redacted for r in result.redacted.collect()}
        assert redacted == {1: "now [REDACTED] [REDACTED] called *******", 2: None, 3: None, 4: "", 5: "[REDACTED]", 6: "mail *******"}
        status = {r.doc_id: r.status for r in versions.scrub_status(result.redacted, "doc_id").collect()}
        assert status[2] == "errors" and status[1] == "modified" and status[4] == "skipped"
    verdicts = spark.createDataFrame([("PERSON", "John", "True"), ("EMAIL_ADDRESS", "a@b.com", "no")], "entity string, value string, response string")
    with scan(df, "doc_id", "text", model=HOOK, verdicts=verdicts) as result:
        redacted = {r.doc_id: r.redacted for r in result.redacted.collect()}
    assert redacted[1] == "now [REDACTED] Doe called a@b.com" and redacted[2] is None


def test_a_worker_loads_a_model_once(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        # A file for every load, named by its worker.
        open(os.path.join(folder, f"{os.getpid()}-{len(os.listdir(folder))}"), "w").close()
        return lambda texts: [[] for _ in texts]

    df = spark.range(2000).select(F.lit("some text").alias("text")).repartition(40)
    hook = ModelHook("counted", load)
    for _ in range(2):
        df.select(model_spans(F.col("text"), hook).alias("s")).write.format("noop").mode("overwrite").save()
    pids = [name.split("-")[0] for name in os.listdir(folder)]
    assert len(pids) == len(set(pids)) <= 16
    assert "counted" not in module._LOADED
