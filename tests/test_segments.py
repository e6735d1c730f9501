"""Long texts in pieces: findings and redacted texts equal to those of the whole text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilspan.operators import segments
from veilspan.operators.detect import detect, explode_findings
from veilspan.operators.redact import redact
from veilspan.operators.resolve import overlapping_entities
from veilspan.plans.derived import notes
from veilspan.recognizers import DEFAULT_RECOGNIZERS
from tests.conftest import SF

#: What matches are made of, to be met at every place of a piece.
FRAGMENTS = [
    "12 ", "7 Oak St", "9 Elm Avenue.", ", ", "Town", "Springfield, CA 90210", "NY 12345-6789", " TX", "54321", "\n", "\n\n", " \n ",
    "ssh-rsa AAAAB3 me@host", "ssh-rsa", "ssh-ed25519\nAAAA", "\nAAAA==\n", "Bearer", "Bearer tok", "sk-", "a@b.com", "x.y+z@host.example.org",
    "555-123-4567", "(555) 123 4567", "1 555 123 4567", "123-45-6789", "1234 5678 9012", "ABCDE1234F", "Passw0rdX", "passwordlong", "UPPERCASE9",
    "lowercaseonly", "words and words", "café", "日本語", "! ", "(", ": ", "\t", "\x85", " ", " ", "\xa0", "4111111111111111", "abc def ghi",
    "St", "Street", "٣ ", "０ ", "#5", "'s", "-", "zzz ", "the end", "A", "Q1", "ssh-rsa A B\n C",
]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    rows = []
    for i in range(700):
        pool = rng.sample(FRAGMENTS, rng.randrange(3, len(FRAGMENTS)))
        rows.append((i, rng.choice(["", " ", " ", "\n", ", "]).join(rng.choices(pool, k=rng.choice([3, 10, 40, 120])))))
    rows += [(9000, ""), (9001, None), (9002, " "), (9002, "a b"), (None, "mail a@b.com now")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(8).cache()


def found(df):
    key = ["doc_id", "start", "end", "entity", "value", "score", "priority", "pattern_name"]
    return sorted((tuple(r) for r in df.select(*key).collect()), key=str)


@pytest.mark.parametrize("scope", ["line", "text", "token"])
@pytest.mark.parametrize("size", [1, 25])
def test_findings_of_pieces_are_those_of_the_text(spark, texts, scope, size):
    recognizers = DEFAULT_RECOGNIZERS.with_scope(scope)
    mine = found(segments.segmented_findings(texts, "doc_id", recognizers=recognizers, size=size))
    assert mine == found(explode_findings(detect(texts, recognizers=recognizers), "doc_id"))
    assert {r[3] for r in mine} == {r.entity for r in recognizers}


def test_every_kind_of_note(spark):
    docs = notes(spark, SF)
    for size in (10, 200):
        assert found(segments.segmented_findings(docs, "doc_id", size=size)) == found(explode_findings(detect(docs), "doc_id"))


def test_redacted_texts(spark, texts):
    rows = texts.where("text is not null")
    mine = segments.segmented_texts(rows, "doc_id", size=12).collect()
    whole = redact(detect(rows), overlapping_entities(DEFAULT_RECOGNIZERS)).select("doc_id", "redacted").collect()
    assert sorted(map(tuple, mine), key=str) == sorted(map(tuple, whole), key=str)


def test_pieces_join_up_and_stand_where_texts_may_be_cut(spark, texts):
    rows = texts.where("text is not null").select("text", segments.pieces(F.col("text"), 5).alias("p")).collect()
    many = 0
    for r in rows:
        assert "".join(r.p) == r.text
        many += len(r.p) > 1
        for left, right in zip(r.p, r.p[1:]):
            assert len(left) >= 5 and re.match("[a-qs-z]", left[-1]) and right[0] in " \n\t"
    assert many > 300


def test_places_stay_closed_in_plain_prose(spark):
    """Only candidates glue pieces: prose with digits but without ZIP codes is cut everywhere."""
    prose = "The 3 men saw 12 ships, and a boat. " * 400 + "Mail a@b.com now. " + "It was 1999 when they left. " * 400
    docs = spark.createDataFrame([(1, prose), (2, "At 12 Main St " + "of the town " * 300 + ", CA 90210 and more of it " * 2)], "doc_id long, text string")
    pieces = segments.split(docs, "doc_id", size=100)
    units = {r.doc_id: r.n for r in segments.units_of(pieces, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    n_pieces = {r.doc_id: r.n for r in pieces.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert units[1] == n_pieces[1] > 200
    assert units[2] < 4 < n_pieces[2]


def test_other_patterns_are_refused(spark, texts):
    own = DEFAULT_RECOGNIZERS.with_recognizer("TICKET", r"T \d+", 0.5)
    for recognizers in (own, DEFAULT_RECOGNIZERS.with_flags("i")):
        with pytest.raises(ValueError, match="as written only"):
            segments.segmented_findings(texts, "doc_id", recognizers=recognizers)
