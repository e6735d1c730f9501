import pytest
from pyspark.sql import functions as F

from veilspan import DEFAULT_RECOGNIZERS, scan
from veilspan.operators import verify
from veilspan.operators.detect import detect, explode_findings
from veilspan.operators.names import person_findings
from veilspan.policy import DEFAULT_POLICY, custom


def test_only_the_word_true_counts(spark):
    cases = [(" true ", True), ("TRUE", True), ("True\n", True), ("True.", False), ("yes", False), ("", False), (None, False)]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, response string")
    rows = df.select("i", verify.is_true(F.col("response")).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in rows] == [v for _, v in cases]


def test_labelled_examples(spark):
    table = verify.verdict_table(verify.seed_verdicts(spark)).collect()
    assert len(table) == 12 and sum(r["verdict"] for r in table) == 6


TEXTS = [(1, "a@b.co and 123-45-6789"), (2, "a@b.co twice a@b.co"), (3, "c@d.org"), (4, "nothing")]
VERDICTS = [("EMAIL_ADDRESS", "a@b.co", "True"), ("US_SSN", "123-45-6789", "no"), ("EMAIL_ADDRESS", "a@b.co", " true")]


def docs(spark):
    return spark.createDataFrame(TEXTS, "path int, text string")


def verdicts(spark):
    return spark.createDataFrame(VERDICTS, "entity string, value string, response string")


R = DEFAULT_RECOGNIZERS.only(["EMAIL_ADDRESS", "US_SSN"])


@pytest.mark.parametrize("on_missing, third", [("drop", "c@d.org"), ("keep", "*******")])
def test_scan_with_verdicts(spark, on_missing, third):
    result = scan(docs(spark), recognizers=R, verdicts=verdicts(spark), on_missing=on_missing)
    texts = {r["path"]: r["redacted"] for r in result.redacted.collect()}
    assert texts == {1: "****** and 123-45-6789", 2: "****** twice ******", 3: third, 4: "nothing"}
    assert all(r["entry"].endswith(" (confirmed)") for r in result.entries.collect())


def test_staged_scan_is_the_same(spark):
    direct = scan(docs(spark), recognizers=R).redacted
    staged = scan(docs(spark), recognizers=R, staged=True).redacted
    columns = ["path", "redacted"]
    assert sorted(direct.select(columns).collect()) == sorted(staged.select(columns).collect())


def test_score_gate(spark):
    low = R.with_recognizer("WORD", "twice", 0.5)
    found = explode_findings(detect(docs(spark), recognizers=low), "path")
    assert found.where("entity = 'WORD'").count() == 1
    yes = found.select("entity", "value", F.lit("true").alias("response"))
    assert verify.confirm(found, yes).where("entity = 'WORD'").count() == 0
    assert verify.confirm(found, yes, min_score=0.5).where("entity = 'WORD'").count() == 1


def test_hot_value_is_whole_and_split(spark):
    """One value makes up most findings: every finding keeps its verdict, and verdicts are not copied."""
    hot = spark.range(5000).select(F.col("id").alias("path"), F.lit("hot@mail.org").alias("text"))
    cold = spark.range(5000, 6000).select(F.col("id").alias("path"), F.concat(F.lit("u"), "id", F.lit("@m.org")).alias("text"))
    found = explode_findings(detect(hot.unionByName(cold), recognizers=R), "path")
    yes = spark.createDataFrame([("EMAIL_ADDRESS", "hot@mail.org", "true")], "entity string, value string, response string")
    joined = verify.join_verdicts(found, yes)
    assert joined.count() == 6000
    assert joined.where("verdict").count() == 5000
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan


def test_classifier_over_distinct_values(spark):
    found = explode_findings(detect(docs(spark), recognizers=R), "path")
    values = verify.distinct_values(found)
    assert {(r["value"], r["n_findings"]) for r in values.collect()} == {("a@b.co", 3), ("123-45-6789", 1), ("c@d.org", 1)}
    answers = verify.classify(values, lambda batch: batch["value"].str.endswith("co").map({True: "True", False: "False"}))
    assert {(r["value"], r["response"]) for r in answers.collect()} == {
        ("a@b.co", "True"), ("123-45-6789", "False"), ("c@d.org", "False"),
    }
    result = scan(docs(spark), recognizers=R, classifier=lambda batch: ["True"] * len(batch))
    assert result.findings.count() == 5


@pytest.mark.parametrize("on_missing", ["drop", "keep"])
def test_failing_classifier_gives_no_verdict(spark, on_missing):
    def broken(batch):
        raise RuntimeError("no service")

    with scan(docs(spark), recognizers=R, classifier=broken, on_missing=on_missing) as result:
        texts = {r["redacted"] for r in result.redacted.collect()}
        count = result.findings.count()
    if on_missing == "drop":
        assert count == 0 and texts == {t for _, t in TEXTS}
    else:
        assert count == 5 and not any("@" in t or "123-45" in t for t in texts)


def test_one_failing_value_does_not_fail_its_batch(spark):
    def picky(batch):
        if batch["value"].str.startswith("c@").any():
            raise RuntimeError("not this one")
        return ["True"] * len(batch)

    found = explode_findings(detect(docs(spark), recognizers=R), "path")
    answers = verify.classify(verify.distinct_values(found), picky).collect()
    assert {(r["value"], r["response"]) for r in answers} == {("a@b.co", "True"), ("123-45-6789", "True"), ("c@d.org", None)}


def test_each_value_is_asked_once_for_all_results(spark, tmp_path):
    log = str(tmp_path)

    def counting(batch):
        import uuid

        for value in batch["value"]:
            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                f.write(value)
        return ["True"] * len(batch)

    with scan(docs(spark), recognizers=R, classifier=counting) as result:
        assert result.findings.count() == 5
        assert result.redacted.count() == 4
        assert result.entries.count() == 5
        asked = sorted(open(f).read() for f in tmp_path.iterdir())
        assert asked == ["123-45-6789", "a@b.co", "c@d.org"]
        import os

        folders = [f.removeprefix("file:") for f in result.folders]
        assert folders and all(os.path.exists(f) for f in folders)
    assert not any(os.path.exists(f) for f in folders)


def test_repeated_keys_stay_apart(spark):
    df = spark.createDataFrame([("k", "a@b.com x"), ("k", "nothing long enough here"), ("k", "y c@d.org")], "path string, text string")
    yes = spark.createDataFrame([("EMAIL_ADDRESS", v, "true") for v in ("a@b.com", "c@d.org")], "entity string, value string, response string")
    texts = sorted(r["redacted"] for r in scan(df, recognizers=R, verdicts=yes).redacted.collect())
    assert texts == sorted(["******* x", "nothing long enough here", "y *******"])


def test_null_of_a_users_operation_never_loses_text(spark):
    none = custom(lambda value: F.lit(None).cast("string"))
    error = custom(lambda value: F.lit(None).cast("string"), on_null="error")
    df = spark.createDataFrame([(1, "mail someone@example.com now"), (2, "plain")], "path int, text string")
    for rule, want in ((none, "mail ******************* now"), (error, None)):
        done = scan(df, recognizers=R.only(["EMAIL_ADDRESS"]), policy={**DEFAULT_POLICY, "EMAIL_ADDRESS": rule}).redacted
        assert {r["path"]: r["redacted"] for r in done.collect()} == {1: want, 2: "plain"}


NAMES = ["John Doe", "Ann", "Mary Jane Watson"]
PEOPLE = [(1, "John Doe met Ann, not Anna"), (2, "Mary Jane\nWatson and John  Doe"), (3, "John, Doe")]


def people(spark):
    return spark.createDataFrame(PEOPLE, "path int, text string")


def name_table(spark):
    return spark.createDataFrame([(n,) for n in NAMES], "name string")


WANT = {(1, "John Doe", 0, 8), (1, "Ann", 13, 16), (2, "Mary Jane\nWatson", 0, 16), (2, "John  Doe", 21, 30)}


def test_names_by_join(spark):
    rows = person_findings(people(spark), name_table(spark), "path").collect()
    assert {(r["path"], r["value"], r["start"], r["end"]) for r in rows} == WANT


@pytest.mark.parametrize("more", [0, 3000])
def test_names_as_list_and_as_table_of_any_size(spark, more):
    extra = spark.range(more).select(F.concat(F.lit("Nobody Number "), "id").alias("name"))
    for names in (NAMES, name_table(spark).union(extra)):
        result = scan(people(spark), recognizers=R, names=names)
        found = {(r["path"], r["value"], r["start"], r["end"]) for r in result.findings.collect()}
        assert found == WANT
        texts = {r["path"]: r["redacted"] for r in result.redacted.collect()}
        assert texts == {
            1: "[REDACTED] met [REDACTED], not Anna", 2: "[REDACTED] and [REDACTED]", 3: "John, Doe",
        }
        result.close()


LONG_NAMES = ["J. Smith", "Maria del Carmen Lopez Ruiz", "Ann Lee", "O'Neil, Pat", "Smith Jr.", "  ", "...", None, "X Æ A-12"]


@pytest.mark.parametrize("more", [0, 30000])
def test_initials_and_names_of_any_length(spark, more):
    text = "J. Smith and J  Smith; Maria del\nCarmen Lopez Ruiz, Ann Lee. O'Neil, Pat / Smith Jr. X Æ A-12"
    names = spark.createDataFrame([(n,) for n in LONG_NAMES], "name string")
    names = names.union(spark.range(more).select(F.concat(F.lit("Q"), "id", F.lit(" Z")).alias("name")))
    found = person_findings(spark.createDataFrame([(1, text)], "path int, text string"), names, "path").collect()
    assert all(text[r["start"] : r["end"]] == r["value"] for r in found)
    assert {r["value"] for r in found} == {
        "J. Smith", "Maria del\nCarmen Lopez Ruiz", "Ann Lee", "O'Neil, Pat", "Smith Jr", "X Æ A-12",
    }


def test_texts_without_a_first_word_stay_out_of_the_join(spark):
    df = spark.createDataFrame([(1, "John Doe"), (2, "nobody here")], "path int, text string")
    result = scan(df, recognizers=R, names=name_table(spark))
    (folder,) = [f for f in result.folders if "/detected-" in f]
    assert [r["path"] for r in spark.read.parquet(folder).where("hit = 'no'").collect()] == [2]
    assert {r["path"]: r["redacted"] for r in result.redacted.collect()} == {1: "[REDACTED]", 2: "nobody here"}
