"""Very many patterns: the literals that are read off them, the same findings as one by one, and the cost."""

import random
import re
import time

import pytest

from veilspan.operators import many
from veilspan.operators.detect import detect, explode_findings
from veilspan.recognizers import DEFAULT_RECOGNIZERS, RecognizerSet


@pytest.mark.parametrize(
    "regex, expected",
    [
        ("abcdef", "abcdef"), (r"\bTICKET-\d+", "TICKET-"), ("ab(?:cde)f", "abcdef"), ("(abc|def)", None), ("abc?d", None), ("(?:abc)?defg", "defg"),
        ("x{3}yz", None), ("(?:long){2}yz", "long"), ("a[b]c[d]e", "abcde"), ("a.c", None), (r"a\.com", "a.com"), ("(?i)abcdef", None), (r"\Qabcd\E", None),
        ("(?=abc)defg", "defg"), ("(?!abcd)xyz", "xyz"), (r"\p{L}abcd", None), ("[", None), ("abc[^d]efghi", "efghi"), ("", None), (r"\vabc", None),
        (r"(a)\1bcd", None), ("(?:a(?:b(?:cd)))e+f", "abcd"), ("日本語", "日本語"), ("(?<=key=)[0-9]+", None), ("ab++cdef", "cdef"),
    ],
)
def test_literals(regex, expected):
    assert many.literal(regex) == expected


def recognizers_of(patterns):
    out = RecognizerSet(())
    for k, regex in enumerate(patterns):
        out = out.with_recognizer(f"E{k % 7}", regex, 0.5 + k % 5 / 10, f"p{k}")
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_findings_are_those_of_each_pattern(spark, monkeypatch):
    rng = random.Random(2)
    words = ["abcd", "bcde", "abcdef", "xyz", "日本語", "key=", "T-1", "T-22", "é", "￿", " ", "\n", "$0", "\\"]
    texts = ["".join(rng.choices(words, k=rng.randrange(14))) for _ in range(300)] + [None, ""]
    patterns = ["abcd", "bcde", "abcdef", "cdab", r"\bT-\d+", r"T-\d\d", "(?:xyz)+", "key=.", "日本", "[a-c]+", "é|xyz", r"(abc)d\b", r"\$0abc", "b.d", "(?i)XYZ"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    for recognizers in (recognizers_of(patterns), recognizers_of(patterns).with_flags("i")):
        monkeypatch.setattr(many, "MANY", 10**9)
        one_by_one = rows(explode_findings(detect(df, recognizers=recognizers), "doc_id"))
        monkeypatch.setattr(many, "MANY", 1)
        together = rows(explode_findings(detect(df, recognizers=recognizers), "doc_id"))
        assert sorted(together) == sorted(one_by_one) and len(together) > 500
        # Each text's findings come in the usual order.
        settled = detect(df, recognizers=recognizers).select("raw").collect()
        assert all(r.raw == sorted(r.raw) for r in settled)
    mixed = DEFAULT_RECOGNIZERS.with_recognizer("E0", "abcd", 0.5).with_scope("token")
    expected = {r for e in mixed for r in rows(explode_findings(detect(df, recognizers=RecognizerSet([e], "", mixed.entities)), "doc_id"))}
    assert set(rows(explode_findings(detect(df, recognizers=mixed), "doc_id"))) == expected


def test_a_thousand_patterns_cost_less_than_five_times_ten(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(8).cache()
    docs.count()

    def seconds(n):
        recognizers = recognizers_of([rf"\bSECRET{k * 7919 % 10007}-[A-Z]+\d*" for k in range(n)] + ["de[rn] [a-z]+ing"] * 10)
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            detect(docs, recognizers=recognizers).select("doc_id", "raw").write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(1000) < 5 * seconds(10)


def test_tables_of_patterns(spark):
    df = spark.createDataFrame([("A", "one", "abc", 0.5), ("B", "two", "def", 0.6), ("A", "three", "ghi", 0.7)], "entity string, pattern_name string, regex string, score double")
    own = DEFAULT_RECOGNIZERS.only(["US_SSN"]).with_recognizers_from(df)
    assert [r.pattern_name for r in own] == ["ssn_pattern", "one", "three", "two"] and own.entities[-2:] == ("A", "B")
    assert re.match(".*empty", str(pytest.raises(ValueError, own.with_recognizers_from, spark.createDataFrame([("A", "x", "a*", 0.5)], df.schema)).value))
