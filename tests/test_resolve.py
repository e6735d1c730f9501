"""Overlap resolution against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from veilspan import schemas
from veilspan.functions.text import blocks, slice_blocks, slice_text
from veilspan.operators.redact import rebuild
from veilspan.operators.resolve import clip_overlaps, dedupe, drop_contained, merge_same_entity, resolve
from veilspan.policy import DEFAULT_POLICY, mask_with, require_rules

ENTITIES = ["EMAIL_ADDRESS", "PHONE_NUMBER", "PERSON"]


def make(rng, text, n, longest):
    rows = []
    for _ in range(n):
        start = rng.randrange(len(text) - 1)
        end = min(len(text), start + 1 + rng.randrange(longest))
        p = rng.randrange(3)
        rows.append((start, -end, -rng.choice([0.5, 0.9]), p, ENTITIES[p], "p", text[start:end]))
    return sorted(rows)


def brute_dedupe(rows):
    best = {}
    for r in rows:
        k = (r[0], r[1], r[4])
        if k not in best or r[2] < best[k][2]:
            best[k] = r
    return sorted(best.values())


def brute_merge(rows, text):
    out = []
    for e in ENTITIES:
        spans = [list(r) for r in rows if r[4] == e]
        again = True
        while again:
            again = False
            for i in range(len(spans)):
                for j in range(i + 1, len(spans)):
                    a, b = spans[i], spans[j]
                    if a[0] < -b[1] and b[0] < -a[1]:
                        s, t = min(a[0], b[0]), max(-a[1], -b[1])
                        spans[i] = [s, -t, min(a[2], b[2]), a[3], e, "p", text[s:t]]
                        del spans[j]
                        again = True
                        break
                if again:
                    break
        out += [tuple(s) for s in spans]
    return sorted(out)


def brute_contained(rows):
    keep = []
    for i, r in enumerate(rows):
        inside = False
        for j, q in enumerate(rows):
            if i == j:
                continue
            if q[0] <= r[0] and -q[1] >= -r[1] and ((q[0], q[1]) != (r[0], r[1]) or j < i):
                inside = True
        if not inside:
            keep.append(r)
    return keep


def brute_clip(rows):
    out = []
    for i, r in enumerate(rows):
        end = -r[1] if i + 1 == len(rows) else min(-r[1], rows[i + 1][0])
        out.append((r[0], -end, *r[2:6], r[6][: end - r[0]]))
    return out


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(11)
    text = "".join(rng.choice("abcé 😀\n") for _ in range(400))
    return text, [make(rng, text, n, longest) for n in (0, 1, 2, 5, 40, 150) for longest in (2, 9, 60) for _ in range(3)]


def test_every_step(spark, cases):
    text, arrays = cases
    df = spark.createDataFrame([(i, text, a) for i, a in enumerate(arrays)], f"k int, text string, raw {schemas.FINDINGS.simpleString()}")
    t, raw = F.col("text"), F.col("raw")
    rows = (
        df.withColumn("d", dedupe(raw, ENTITIES))
        .withColumn("m", merge_same_entity(t, F.col("d"), ENTITIES))
        .withColumn("c", drop_contained(F.col("m")))
        .withColumn("o", clip_overlaps(F.col("c")))
        .withColumn("all", resolve(t, raw, ENTITIES))
        .orderBy("k")
        .collect()
    )
    for row, a in zip(rows, arrays):
        d = brute_dedupe(a)
        assert [tuple(x) for x in row["d"]] == d
        m = brute_merge(d, text)
        assert [tuple(x) for x in row["m"]] == m
        c = brute_contained(m)
        assert [tuple(x) for x in row["c"]] == c
        o = brute_clip(c)
        assert [tuple(x) for x in row["o"]] == o == [tuple(x) for x in row["all"]]


def test_many_findings(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefg ") for _ in range(20000))
    a = make(rng, text, 1500, 12)
    df = spark.createDataFrame([(text, a)], f"text string, raw {schemas.FINDINGS.simpleString()}")
    kept = df.select(clip_overlaps(drop_contained(F.col("raw"))).alias("o")).first()["o"]
    assert [tuple(x) for x in kept] == brute_clip(brute_contained(a))


def brute_rebuild(text, rows):
    out, at = [], 0
    for r in rows:
        value = r[6]
        n = {"EMAIL_ADDRESS": 10, "PHONE_NUMBER": 7}.get(r[4])
        out += [text[at : r[0]], "[REDACTED]" if n is None else "*" * min(n, len(value)) + value[n:]]
        at = -r[1]
    return "".join(out) + text[at:]


def test_rebuild_both_ways(spark, monkeypatch, cases):
    text, arrays = cases
    kept = [brute_clip(brute_contained(a)) for a in arrays]
    df = spark.createDataFrame([(i, text * 30, k) for i, k in enumerate(kept)], f"k int, text string, kept {schemas.FINDINGS.simpleString()}")
    import veilspan.functions.text as text_module

    for steps in (10**9, 0):
        monkeypatch.setattr(text_module, "DIRECT_STEPS", steps)
        rows = df.select("k", rebuild(F.col("text"), F.col("kept")).alias("r")).orderBy("k").collect()
        assert [r["r"] for r in rows] == [brute_rebuild(text * 30, k) for k in kept]


def test_block_slices(spark):
    text = "aé😀\n" * 5000
    cuts = [(0, 0), (0, 1), (4095, 4097), (4096, 8192), (100, 19999), (19999, 20000), (0, 20000), (20000, 20000)]
    df = spark.createDataFrame([(text, s, e) for s, e in cuts], "text string, s int, e int")
    rows = df.select(
        "s", "e", slice_blocks(blocks(F.col("text")), F.col("s"), F.col("e")).alias("b"), slice_text(F.col("text"), F.col("s"), F.col("e")).alias("d")
    ).collect()
    for r in rows:
        assert r["b"] == r["d"] == text[r["s"] : r["e"]]


def test_policy_checks():
    require_rules(DEFAULT_POLICY, ["PERSON", "API_KEY"])
    with pytest.raises(ValueError, match="NEW_THING"):
        require_rules(DEFAULT_POLICY, ["PERSON", "NEW_THING"])
    with pytest.raises(ValueError):
        mask_with("**", 3)


def test_policy_and_recognizers_as_tables(spark):
    from veilspan import DEFAULT_RECOGNIZERS
    from veilspan.policy import policy_df, policy_from_df
    from veilspan.recognizers import RecognizerSet

    assert policy_from_df(policy_df(spark)) == DEFAULT_POLICY
    rows = spark.createDataFrame([("TICKET", "ticket", r"T-\d+", 0.7)], "entity string, pattern_name string, regex string, score double")
    more = DEFAULT_RECOGNIZERS.with_recognizers_from(rows)
    assert [r.entity for r in more][-1] == "TICKET" and more.priority("TICKET") == 11
    many = spark.range(1001).selectExpr("'A' entity", "'p' pattern_name", "'x' regex", "0.5 score")
    assert len(RecognizerSet(()).with_recognizers_from(many)) == 1001


def test_custom_operation(spark):
    from veilspan import scan
    from veilspan.policy import custom

    df = spark.createDataFrame([("k", "mail a@b.co")], "path string, text string")
    policy = {**DEFAULT_POLICY, "EMAIL_ADDRESS": custom(lambda v: F.concat(F.lit("<"), F.upper(v), F.lit(">")))}
    assert scan(df, policy=policy).redacted.first()["redacted"] == "mail <A@B.CO>"
