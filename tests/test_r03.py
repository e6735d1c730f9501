"""Findings of the third round: work is dealt out, and nothing whole passes through the driver."""

import random

import pytest
from pyspark.sql import functions as F

from veilspan.functions.words import listed_names
from veilspan.operators import names, pattern_table, score
from veilspan.operators.detect import detect, explode_findings
from veilspan.plans import derived
from veilspan.recognizers import DEFAULT_RECOGNIZERS, RecognizerSet
from veilspan.sources import tree


def customers(spark, path, n):
    rows = spark.range(n).select(F.col("id").alias("c_custkey"), F.format_string("Customer#%09d", "id").alias("c_name"))
    rows.coalesce(1).write.parquet(f"{path}/customer.parquet")
    return str(path)


def test_texts_made_of_one_split_are_matched_in_many_tasks(spark, tmp_path):
    """F9 to F21: millions of customers can be one scan split."""
    d = customers(spark, tmp_path, 500)
    for make in (derived.notes, derived.accented_notes, derived.letters, derived.customer_names):
        df = make(spark, d)
        used = df.select(F.spark_partition_id().alias("p")).distinct().count()
        assert used > spark.sparkContext.defaultParallelism, make.__name__


def test_scoring_needs_no_window(spark):
    """one exchange for the spans of both sides, merged in the row as before."""
    rows = [(k % 7, "AB"[k % 2], k * 7919 % 90, k * 7919 % 90 + 1 + k % 13) for k in range(300)]
    found = spark.createDataFrame(rows, "doc_id int, entity string, start int, end int")
    true = spark.createDataFrame([(d, e, s + 2, t + 2) for d, e, s, t in rows[::3]], found.schema)
    df = score.scores(found, true, "doc_id")
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()

    def merged(side):
        out = []
        for d, e, s, t in sorted(side):
            if out and out[-1][:2] == [d, e] and s < out[-1][3]:
                out[-1][3] = max(out[-1][3], t)
            else:
                out.append([d, e, s, t])
        return sorted(map(tuple, out))

    assert sorted(map(tuple, score.merged_spans(found, "doc_id").collect())) == merged(rows)
    assert score.merged_spans(found, "doc_id").schema == found.schema
    counts = {r.entity: (r.n_found, r.n_true) for r in df.collect()}
    for e in "AB":
        assert counts[e] == tuple(sum(r[1] == e for r in merged(side)) for side in (rows, [tuple(r) for r in true.collect()]))


def test_files_are_written_in_tasks(spark, tmp_path):
    """F3, F5 to F8: one file a document, by the tasks; rows of one key are lines of one file, a null is an empty line."""
    rows = [(1, "a"), (2, None), (1, "b"), (-3, "x\ny"), (4, "é")]
    df = spark.createDataFrame(rows, "doc_id long, value string")
    root = f"{tmp_path}/out"
    tree.write_lines(df.coalesce(1), root, "doc_id", F.lit(".a/_b"))
    assert not [p for p in (tmp_path / "out").rglob("*") if p.name == "_SUCCESS" or p.suffix == ".crc"]
    texts = {p.parent.name: p.read_bytes() for p in (tmp_path / "out").rglob("*.txt")}
    assert texts == {"doc_id=1": b"a\nb\n", "doc_id=2": b"\n", "doc_id=-3": b"x\ny\n", "doc_id=4": "é\n".encode()}
    read = tree.read_texts(spark, root).collect()
    assert sorted(r.text for r in read) == sorted(t.decode() for t in texts.values())
    # A task that runs again leaves the same files.
    tree.write_lines(df.coalesce(1), root, "doc_id", F.lit(".a/_b"))
    assert len([p for p in (tmp_path / "out").rglob("*") if p.is_file()]) == 4


def test_the_map_of_names_is_not_in_the_plan(spark, tmp_path):
    """a plan that held the bits would fill the driver with copies of them."""
    d = customers(spark, tmp_path, 20_000)
    df = names.person_findings(derived.letters(spark, d), derived.customer_names(spark, d), "doc_id")
    assert len(df._jdf.queryExecution().toString()) < 1 << 20
    assert df.count() == 20_000
    listed = listed_names(derived.customer_names(spark, d))
    bits, words = names.bit_map(listed, 20_000)
    assert names.held_map(listed, bits).first()["held"] == words


def test_digests_are_dealt_out_once(spark):
    """pipeline, repeated_passages: the digests' own exchange, the marks' and the texts'; no second one of the digests."""
    from veilspan.llm import chunk_dedup

    passage = " ".join(f"word{k * 7919 % 1009}" for k in range(120))
    docs = [(3, f"alpha beta {passage} omega"), (1, f"gamma {passage} delta"), (1, passage), (2, "short"), (None, passage), (4, None), (5, f"{passage} end")]
    df = chunk_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(digest") == 1
    cut = {(r.doc_id, len(r.text or "")): r.n_removed for r in df.collect()}
    assert len(cut) == len(docs) and {d for (d, _), n in cut.items() if n} == {3, 5} and all(n > 90 for n in cut.values() if n)


def test_a_table_of_patterns_stays_off_the_driver(spark, monkeypatch):
    """the same findings as with the patterns in the plan, which a table of millions does not fit."""
    rng = random.Random(4)
    words = ["abcd", "bcde", "abcdef", "xyz", "日本語", "key=", "T-1", "T-22", "é", "￿", " ", "\n", "$0", "\\", "u17@mail.example.com", "u170@mail.example.org"]
    texts = ["".join(rng.choices(words, k=rng.randrange(14))) for _ in range(300)] + [None, "", "abcd" * 90, "x" * 300 + "u17@mail.example.com"]
    patterns = ["abcd", "bcde", "abcdef", "cdab", r"\bT-\d+", r"T-\d\d", "(?:xyz)+", "key=.", "日本", "[a-c]+", "é|xyz", r"(abc)d\b", r"\$0abc", "b.d", "abcd", "x{3}"]
    patterns += [rf"\bu{k}@mail[.]example[.](?:com|org)" for k in (1, 17, 17, 170, 1700)] + ["(?:abcdabcd){4}"]
    table = [(f"E{k % 7}", f"p{k}", regex, 0.5 + k % 5 / 10) for k, regex in enumerate(patterns)]
    df = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc_id int, text string").repartition(4)
    some = spark.createDataFrame(table, "entity string, pattern_name string, regex string, score double")
    known = DEFAULT_RECOGNIZERS.only(["EMAIL_ADDRESS", "US_SSN"])
    rows = lambda found: sorted(map(tuple, explode_findings(found, "doc_id").collect()))
    monkeypatch.setattr(pattern_table, "BLOCK", 50)
    for recognizers in (known, known.with_flags("i")):
        expected = rows(detect(df, recognizers=recognizers.with_recognizers_from(some)))
        monkeypatch.setattr(RecognizerSet, "with_recognizers_from", None)
        assert rows(pattern_table.detect_with_table(df, some, recognizers)) == expected and len(expected) > 500
        monkeypatch.undo()
    for wrong in (("A", "x", "a*", 0.5), ("A", "x", "a(", 0.5), ("A", "x", "abc", 1.5), ("A", "x", None, 0.5)):
        with pytest.raises(ValueError):
            pattern_table.detect_with_table(df, spark.createDataFrame([wrong], some.schema), known)


def test_the_query_of_many_patterns_collects_no_table(spark, tmp_path, monkeypatch):
    """findings_many held a recognizer of every customer on the driver and in the plan."""
    from veilspan.plans.catalogue import findings_many

    monkeypatch.setattr(RecognizerSet, "with_recognizers_from", None)
    found = findings_many(spark, customers(spark, tmp_path, 300)).where("entity = 'ACCOUNT'").collect()
    assert sorted((r.doc_id, r.pattern_name) for r in found) == [(k, f"account_{k}") for k in range(300)]


def test_true_spans_are_dealt_out_and_summed_from_lengths(spark, tmp_path):
    """one task made every part of a note anew for each of its spans."""
    d = customers(spark, tmp_path, 500)
    found = derived.true_spans(spark, d)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > spark.sparkContext.defaultParallelism
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == sum("md5(" in part for _, part in derived.NOTE_PARTS)
    plain = " union all ".join(f"select c_custkey as doc_id, '{e}' as entity, int({a}) as start, int({b}) as end from customer" for e, a, b in derived.note_spans())
    derived.table(spark, d, "customer").createOrReplaceTempView("customer")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, spark.sql(plain).collect()))


def test_single_spans_are_paired_without_a_fold(spark):
    """most entities have a span on each side."""
    spans = [[], [(0, 3)], [(3, 5)], [(2, 4), (4, 9)], [(5, 5)], [(1, 8)]]
    rows = [(a, b) for a in spans for b in spans]
    df = spark.createDataFrame(rows, "l array<struct<start:long,end:long>>, r array<struct<start:long,end:long>>")

    def pairs(left, right):
        i = j = n = 0
        while i < len(left) and j < len(right):
            (a, b), (c, d) = left[i], right[j]
            meet, first = a < d and c < b, b <= d
            i, j, n = i + (meet or first), j + (meet or not first), n + meet
        return n

    got = [r.n for r in df.select(score.pairs(F.col("l"), F.col("r")).alias("n")).collect()]
    assert got == [pairs(a, b) for a, b in rows]


def test_short_ways_of_matching_agree_with_the_long_ones(spark, monkeypatch):
    """F11 to F16, F20: starts by running sums and passwords line by line cost as much as the patterns."""
    from veilspan.functions import spans

    rng = random.Random(11)
    words = ["Abcdefg1", "abcdefgh", "ABC12345x", "12345678", "\n", "\r", " ", ",", "é", "５", "￿", "sk-", "a@b.co", "123-45-6789", "ssh-rsa A=", "Pw000001@x", "́", "😀"]
    texts = ["".join(rng.choices(words, k=rng.randrange(40))) for _ in range(300)] + [None, "", "x1A " * 300 + "\nAbcdefg1 abcdefgh", "123-45-6789 " * 40, " 123-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    rows = lambda found: sorted(map(tuple, explode_findings(found, "doc_id").collect()))
    chosen = {flags: DEFAULT_RECOGNIZERS.with_flags(flags) for flags in ("", "im")}
    quick = {}
    for flags, recognizers in chosen.items():
        found = detect(df, recognizers=recognizers)
        assert "array_sort(" not in found._jdf.queryExecution().optimizedPlan().toString()
        quick[flags] = rows(found)
    monkeypatch.setattr(spans, "SHORT_TEXT", -1)
    monkeypatch.setattr(spans, "FEW_PARTS", 0)
    for flags, recognizers in chosen.items():
        # Another column, as the expression of one is kept.
        slow = rows(detect(df.withColumnRenamed("text", "long"), "long", recognizers))
        assert quick[flags] == slow and len(slow) > 300


def test_notes_of_one_split_are_settled_in_many_tasks(spark, tmp_path):
    """drop_contained matched and settled all notes in one task; each task now has its share of them, and the rest is no exchange."""
    from veilspan.plans.catalogue import QUERIES

    df = QUERIES["drop_contained"](spark, customers(spark, tmp_path, 960))
    shares = [r["count"] for r in df.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
    assert sum(shares) == 13 * 960
    assert len(shares) > spark.sparkContext.defaultParallelism and max(shares) < 2 * sum(shares) / len(shares)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
