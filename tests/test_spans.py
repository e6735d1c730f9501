"""Spans against an independent regex engine with the same Unicode word rules."""

import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from tests.conftest import SF
from veilspan.functions.arrays import RUN, max_before, sums_before
from veilspan.functions.spans import MARK, match_spans
from veilspan.functions.words import word_runs
from veilspan.operators.detect import detect, explode_findings
from veilspan.plans.derived import notes
from veilspan.recognizers import DEFAULT_RECOGNIZERS, PASSWORD_NEEDS, PASSWORD_RUN, RecognizerSet

ALPHABET = list("aZ09_-.@ ,#'\n\r\t:/+=é²\u0301") + [
    "ssh-rsa ", "sk-", "a@b.co", "Bearer ", "4111111111111111", "555-123-4567", "123-45-6789", "1234 5678 9012",
    "ABCDE1234F", "12 Main St, Anytown, CA 90210", "Abcdefg1", "password", "x" * 21, "😀", "Str0ngP@ss",
]


def random_texts(n, seed, pieces=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(pieces))) for _ in range(n)]


def whole_pattern(recognizer):
    """The pattern as a lookahead regex where it has classes ahead."""
    if not recognizer.needs_ahead:
        return regex.compile(recognizer.regex)
    flag = regex.DOTALL if recognizer.scope == "text" else 0
    ahead = "".join(f"(?=.*{c})" for c in PASSWORD_NEEDS)
    return regex.compile(recognizer.regex.replace(r"\b", r"\b" + ahead, 1), flag)


def expected(texts, recognizers):
    out = set()
    for i, text in enumerate(texts):
        for r in recognizers:
            for m in whole_pattern(r).finditer(text):
                if r.scope == "token" and r.needs_ahead:
                    continue
                out.add((i, r.entity, m.start(), m.end(), m.group(), r.score))
    return out


def found(spark, texts, recognizers):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    rows = explode_findings(detect(df, recognizers=recognizers), "k").collect()
    got = [(r["k"], r["entity"], r["start"], r["end"], r["value"], r["score"]) for r in rows]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("scope", ["line", "text"])
def test_all_recognizers_equal_regex(spark, scope):
    recognizers = DEFAULT_RECOGNIZERS.with_scope(scope)
    texts = random_texts(1500, 7)
    want = expected(texts, recognizers)
    assert {w[1] for w in want} == {r.entity for r in recognizers}
    assert found(spark, texts, recognizers) == want


def test_given_tables_equal_regex(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += [r["text"] for r in notes(spark, SF).collect()]
    texts += [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert found(spark, texts, DEFAULT_RECOGNIZERS) == expected(texts, DEFAULT_RECOGNIZERS)


def test_token_scope(spark):
    texts = random_texts(400, 8)
    recognizers = DEFAULT_RECOGNIZERS.only(["PASSWORD"]).with_scope("token")
    want = {
        (i, "PASSWORD", m.start(), m.end(), m.group(), 0.95)
        for i, t in enumerate(texts)
        for m in regex.finditer(PASSWORD_RUN, t)
        if all(regex.search(c, m.group()) for c in PASSWORD_NEEDS)
    }
    assert want and found(spark, texts, recognizers) == want


def test_case_insensitive_and_dot_all_flags(spark):
    recognizers = DEFAULT_RECOGNIZERS.with_flags("ims")
    texts = random_texts(600, 9)
    want = set()
    for i, t in enumerate(texts):
        for r in recognizers:
            p = regex.compile(whole_pattern(r).pattern, regex.I | regex.M | regex.S)
            want |= {(i, r.entity, m.start(), m.end(), m.group(), r.score) for m in p.finditer(t)}
    # Java's Unicode case folding of non-ASCII letters differs from Python's; the classes here are ASCII.
    assert found(spark, texts, recognizers) == want


def test_text_with_the_marker_itself(spark):
    texts = [f"a{MARK}b x@y.org {MARK}{MARK} 123-45-6789 {MARK}", MARK, f"ssh-rsa AAA {MARK} u@h.org"]
    assert found(spark, texts, DEFAULT_RECOGNIZERS) == expected(texts, DEFAULT_RECOGNIZERS)


def test_empty_and_null_texts(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "\n\n")], "k int, text string")
    assert explode_findings(detect(df), "k").count() == 0
    assert [r["n"] for r in detect(df).select("k", F.size("raw").alias("n")).orderBy("k").collect()] == [0, 0, 0]


def test_long_arrays_take_two_levels(spark):
    rng = random.Random(3)
    for n in (0, 1, RUN, RUN + 1, 3 * RUN + 17, 5000):
        values = [rng.randrange(100) for _ in range(n)]
        row = (
            spark.createDataFrame([(values,)], "v array<int>")
            .select(sums_before(F.col("v")).alias("s"), max_before(F.col("v")).alias("m"))
            .first()
        )
        assert row["s"] == [sum(values[:i]) for i in range(n)]
        assert row["m"] == [max(values[:i], default=-1) for i in range(n)]


def test_dense_document(spark):
    text = "Pw000001@x é a@b.co 555-123-4567\n" * 3000
    assert found(spark, [text], DEFAULT_RECOGNIZERS) == expected([text], DEFAULT_RECOGNIZERS)


LONG_TEXTS = {
    "dotted run without at": "mail: x@y.org " + "a." * 400_000 + "a",
    "dotted run with a bad host": "x@y.org " + "a." * 20_000 + "@-",
    "number table with one address before": "12 Main St, Town, CA 90210: " + "12 34 " * 150_000,
    "number table with one address after a break": "12 34 " * 150_000 + "; 12 Main St, Town, CA 90210",
    "number table that runs into an address": "12 34 " * 50_000 + "12 Main St, Town, CA 90210",
    "street words without a ZIP": ("12 Main St, Town and " * 2_000) + "; 9 Oak Rd, Town, NY 10001",
}


@pytest.mark.parametrize("name", sorted(LONG_TEXTS))
def test_long_adversarial_texts_finish(spark, name):
    text = LONG_TEXTS[name]
    chosen = DEFAULT_RECOGNIZERS.only(["EMAIL_ADDRESS", "ADDRESS"])
    got = {(e, v) for _, e, _, _, v, _ in found(spark, [text], chosen)}
    emails = {("EMAIL_ADDRESS", m) for m in ["x@y.org"] if m in text}
    assert {g for g in got if g[0] == "EMAIL_ADDRESS"} == emails
    addresses = [v for e, v in got if e == "ADDRESS"]
    if "run" in name and "number" in name:
        assert addresses == [text]
    elif "number" in name:
        assert addresses == ["12 Main St, Town, CA 90210"]
    elif "street" in name:
        assert addresses == ["9 Oak Rd, Town, NY 10001"]


def test_skipping_changes_nothing(spark):
    """Texts made of the parts that are passed over, with the marker too."""
    rng = random.Random(21)
    parts = ["12 ", "7\n", "Main St", "Oak Rd. ", ", ", "Town", "CA ", "90210", "-1234", "é", "_", ";", "x" * 33, "a.b", "@"]
    parts += ["c.org", "@y.co", " ", "a." * 20, "12 Main St, Town, CA 90210"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)]
    texts += [MARK + t for t in texts[:500]]
    chosen = DEFAULT_RECOGNIZERS.only(["EMAIL_ADDRESS", "ADDRESS"])
    want = expected(texts, chosen)
    assert len(want) > 300
    assert found(spark, texts, chosen) == want


def test_ngrams(spark):
    text = "John  Doe-Smith, Ann\nLee #7 x"
    df = spark.createDataFrame([(text,)], "text string")
    any_word = lambda word: F.lit(True)
    grams = df.select(F.explode(word_runs(F.col("text"), [1, 2, 3], any_word)).alias("g")).select("g.*").collect()
    for g in grams:
        assert text[g["start"] : g["end"]] == g["value"]
        assert " ".join(g["value"].split()) == g["gram"]
    got = {g["gram"] for g in grams}
    assert {"John", "Doe-Smith", "John Doe-Smith", "Ann Lee", "Ann", "7 x", "Doe-Smith, Ann"} <= got
    assert "Doe-Smith Ann" not in got
    ann = df.select(F.explode(word_runs(F.col("text"), [2, 9], lambda word: word == "Ann")).alias("g")).select("g.*").collect()
    assert [g["gram"] for g in ann] == ["Ann Lee"]
    assert df.select(F.size(word_runs(F.col("text"), [], any_word)).alias("n")).first()["n"] == 0
    assert spark.createDataFrame([("",)], "text string").select(F.size(word_runs(F.col("text"), [1], any_word)).alias("n")).first()["n"] == 0


def test_recognizer_set_rules(spark):
    assert [r.entity for r in DEFAULT_RECOGNIZERS.only(["US_SSN"])] == ["US_SSN"]
    with pytest.raises(ValueError):
        DEFAULT_RECOGNIZERS.only(["NOPE"])
    with pytest.raises(ValueError):
        DEFAULT_RECOGNIZERS.with_recognizer("X", "(", 0.5)
    # Patterns are those of the engine that runs them.
    assert len(DEFAULT_RECOGNIZERS.with_recognizer("X", r"\p{L}++", 0.5)) == 11
    with pytest.raises(ValueError):
        DEFAULT_RECOGNIZERS.with_recognizer("X", "(?P<n>a)", 0.5)
    scoped = DEFAULT_RECOGNIZERS.with_scope("text").with_flags("i")
    assert {r.scope for r in scoped if r.needs_ahead} == {"text"}
    with pytest.raises(ValueError):
        DEFAULT_RECOGNIZERS.with_recognizer("X", "a*", 0.5)
    with pytest.raises(ValueError):
        RecognizerSet((), flags="q")
    more = DEFAULT_RECOGNIZERS.with_recognizer("X", "xx", 0.5)
    assert more.priority("X") == 11 and len(more) == 11


def test_recognizer_table(spark):
    rows = DEFAULT_RECOGNIZERS.to_df(spark).collect()
    assert len(rows) == 10 and {r["priority"] for r in rows} == {0, 1, 2, 3, 5, 6, 7, 8, 9, 10}


def test_match_spans_of_adjacent_matches(spark):
    df = spark.createDataFrame([("aaaa",)], "text string")
    row = df.select(match_spans(F.col("text"), "aa").alias("s")).first()
    assert [(x["start"], x["value"]) for x in row["s"]] == [(0, "aa"), (2, "aa")]


def test_words_of_any_length(spark):
    text = "a." * 300_000 + "a John"
    df = spark.createDataFrame([(text,)], "text string")
    grams = df.select(F.transform(word_runs(F.col("text"), [1, 2], lambda word: F.lit(True)), lambda g: F.length(g["gram"])).alias("n")).first()["n"]
    assert sorted(grams) == [4, 600_001, 600_006]


def test_strip_like_python(spark):
    from veilspan.functions.text import strip

    spaces = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    texts = [spaces + "a b" + spaces, spaces, "", "x", " \n x \t y\r\n", "a" + " " * 200_000 + "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    rows = df.select(strip(F.col("text")).alias("s")).orderBy("k").collect()
    assert [r["s"] for r in rows] == [t.strip() for t in texts]


STREETS = ["Main St", "Oak Rd.", "Ave", "Terrace", "Cir", "Street", "Pl"]
TAILS = [", CA 90210", ", CA90210-1234", ",CA 9021", ", ca 90210", ", CA 902101", ", CA  90210-12", ", NY 10001."]


def test_addresses_read_backwards_are_those_of_the_pattern(spark):
    rng = random.Random(11)
    parts = ["12 ", "7\n", "123456 ", "x1 ", "#", "'", "-", " ", "  ", ", ", "\n", ";", "Town", "A", "5", "é", *STREETS, *TAILS]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(2, 30))) for _ in range(6000)]
    texts += [f"{rng.choice(parts)}12 Main {rng.choice(STREETS)}{rng.choice([' ', ', ', ',,'])}Town{rng.choice(TAILS)}" * 2 for _ in range(300)]
    chosen = DEFAULT_RECOGNIZERS.only(["ADDRESS"])
    want = expected(texts, chosen)
    assert len(want) > 150
    assert found(spark, texts, chosen) == want


def test_addresses_take_linear_time(spark):
    import time

    street = "Main Street Oak Avenue "
    texts = ["12 " + street * 45_000, "12 " + street * 40_000 + "12345", "12 " + (street + "5 ") * 40_000 + ", CA 12345",
             "Oak St, a, CA 12345," * 50_000, "1 " * 300_000 + "Oak St, Town, CA 12345", "9 a St" + " " * 300_000 + "b, CA 12345"]
    for text in texts:
        df = spark.createDataFrame([(1, text)], "path int, text string")
        start = time.perf_counter()
        explode_findings(detect(df, recognizers=DEFAULT_RECOGNIZERS.only(["ADDRESS"])), "path").collect()
        assert time.perf_counter() - start < 10
