"""Names at any size: the bit map lets names through and hardly anything else."""

import pytest
from pyspark.sql import functions as F

from veilspan.functions.words import listed_names
from veilspan.operators.names import MOST, bit_map, candidates, matched, person_findings
from veilspan.session import materialise


def name(number, group):
    return F.concat(F.lit("Name"), group.cast("string"), F.lit(" von S"), number.cast("string"))


@pytest.mark.parametrize("n", [3, 300_000])
def test_rows_before_the_join_are_little_more_than_hits(spark, n):
    names = spark.range(n).select(name(F.col("id"), F.col("id") % 1000).alias("name"))
    # First words and first pairs of names are everywhere; one text in three has a listed name, if there are enough.
    number = F.when(F.col("id") % 3 == 0, F.col("id") * 40).otherwise(F.col("id") + 10_000_000)
    text = F.concat(F.lit("Dear "), name(number, number % 1000), F.lit(" and Name7 von Nobody, or Name8 von Name9, so many words."))
    texts = spark.range(6000).select(F.col("id").alias("doc_id"), text.alias("text"))
    listed = materialise(listed_names(names), "names")
    runs = materialise(texts.select("doc_id", candidates(F.col("text"), listed).alias("people")), "runs")
    hits = matched(runs, listed, "doc_id").collect()
    assert {r.doc_id for r in hits} == {i for i in range(0, 6000, 3) if i * 40 < n}
    assert len(hits) <= runs.agg(F.sum(F.size("people"))).first()[0] <= 2 * len(hits) + 2
    assert all(r.value == f"Name{r.doc_id * 40 % 1000} von S{r.doc_id * 40}" and r.start == 5 for r in hits)


def test_map_grows_with_the_names_up_to_a_bound(spark):
    listed = listed_names(spark.range(100).select(name(F.col("id"), F.col("id")).alias("name")))
    bits, words = bit_map(listed, 100)
    assert bits == 8192 and len(words) == 128 and sum(bin(w & (2**64 - 1)).count("1") for w in words) <= 900
    assert bit_map(listed.limit(0), 0) == (1024, [0] * 16)
    assert bit_map(listed, 10**9)[0] == MOST


def test_a_full_map_changes_no_result(spark, monkeypatch):
    from veilspan.operators import names as module

    monkeypatch.setattr(module, "MOST", 64)
    monkeypatch.setattr(module, "LEAST", 64)
    names = spark.createDataFrame([("John Doe",), ("J. Smith",), ("Cher",), ("Maria del Carmen Ruiz",)], "name string")
    texts = spark.createDataFrame([(1, "Cher met John  Doe and J. Smith, not John Smith or Maria del Carmen"), (2, "Maria del\nCarmen Ruiz")], "doc_id int, text string")
    found = person_findings(texts, names, "doc_id").collect()
    assert sorted((r.doc_id, r.value) for r in found) == [(1, "Cher"), (1, "J. Smith"), (1, "John  Doe"), (2, "Maria del\nCarmen Ruiz")]
