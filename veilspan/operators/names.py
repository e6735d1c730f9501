"""PERSON findings from a table of names of any size and length.

The names are put into one bit map (a Bloom filter): each by its first word, by its first two words with its length, and
whole. A text's runs of words pass these three tests inside the row, so what leaves it are the names that occur and
few others, whatever the table's size; a join with the table then decides. The map grows with the names, up to
``MOST`` bits; beyond that more runs are carried to the join, with the same result. The map is a scalar subquery: the plan
names it once and does not hold its bits, of which a plan's many copies and its text would fill the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.arrays import let
from veilspan.functions.words import listed_names, word_runs
from veilspan.recognizers import DEFAULT_RECOGNIZERS, PERSON_SCORE
from veilspan.session import materialise

#: Bits for each of a name's three entries, and in all: two megabytes, enough for some 400,000 names.
PER_ENTRY, LEAST, MOST = 14, 1 << 10, 1 << 24
#: Numbers of the map that are put together at once.
CHUNK = 1024
PROBES = 3


def _places(hashed: Column, bits: int) -> list[Column]:
    """Where the bits of an entry are: three stretches of its hash; the first test needs no shift."""
    mask = F.lit(bits - 1).cast("long")
    return [(F.shiftrightunsigned(hashed, 20 * k) if k else hashed).bitwiseAND(mask).cast("int") for k in range(PROBES)]


def _first(first: Column) -> Column:
    return F.xxhash64(first)


def _pair(first: Column, second: Column, words: Column) -> Column:
    return F.xxhash64(words, first, second)


def _whole(key: Column) -> Column:
    return F.xxhash64(key, F.lit(0))


def _size(names: int) -> int:
    wanted = 3 * PER_ENTRY * names
    return min(MOST, max(LEAST, 1 << (wanted - 1).bit_length() if wanted else LEAST))


def _set_bits(listed: DataFrame, bits: int) -> DataFrame:
    """word, bits: the 64-bit numbers of the map that are not zero."""
    entries = [_first(F.col("first")), _pair(F.col("first"), F.col("second"), F.col("words")), _whole(F.col("key"))]
    places = listed.select(F.explode(F.array(*[p for e in entries for p in _places(e, bits)])).alias("p"))
    return places.groupBy(F.floor(F.col("p") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, p % 64)")).alias("bits"))


def bit_map(listed: DataFrame, names: int) -> tuple[int, list[int]]:
    """The number of bits, and the bits in 64-bit numbers, on the driver: to look at."""
    bits = _size(names)
    out = [0] * (bits // 64)
    for row in _set_bits(listed, bits).collect():
        out[row["word"]] = row["bits"]
    return bits, out


def held_map(listed: DataFrame, bits: int) -> DataFrame:
    """One row with the map as array<bigint>, put together in tasks from chunks; ``MOST`` bounds it."""
    none = listed.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    chunk = F.floor(F.col("word") / CHUNK).alias("chunk")
    words = _set_bits(listed, bits).unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    chunks = words.groupBy(chunk).agg(F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"].alias("bits"))
    return chunks.agg(F.flatten(F.sort_array(F.collect_list(F.struct("chunk", "bits")))["bits"]).alias("held"))


def _runs(text: Column, counts: dict[int, int], bits: int, held: Column) -> Column:
    def runs(held: Column) -> Column:
        def known(hashed: Column) -> Column:
            tests = [F.getbit(F.get(held, F.floor(p / 64).cast("int")), p % 64) == 1 for p in _places(hashed, bits)]
            return tests[0] & tests[1] & tests[2]

        return word_runs(
            text, sorted(counts), lambda first: known(_first(first)), lambda first, second, n: known(_pair(first, second, n)), lambda gram: known(_whole(gram))
        )

    return let(held, runs)


def _counts(listed: DataFrame) -> dict[int, int]:
    return {r["words"]: r["n"] for r in listed.groupBy("words").agg(F.count("*").alias("n")).collect()}


def candidates(text: Column, listed: DataFrame) -> Column:
    """Word runs that are names, but for the few that the bit map cannot tell from one; the map is a literal, for small lists."""
    counts = _counts(listed)
    bits, words = bit_map(listed, sum(counts.values()))
    return _runs(text, counts, bits, F.from_json(F.lit(json.dumps(words)), "array<bigint>"))


def with_candidates(df: DataFrame, text: str, listed: DataFrame, column: str = "people") -> DataFrame:
    """``df`` with ``candidates`` of its texts beside them; the map is a subquery."""
    counts = _counts(listed)
    bits = _size(sum(counts.values()))
    # The map may be written beside each text on its way to the next projection: ``MOST`` keeps that at two megabytes.
    with_map = df.withColumn("_held", held_map(listed, bits).scalar())
    return with_map.withColumn(column, _runs(F.col(text), counts, bits, F.col("_held"))).drop("_held")


def matched(runs: DataFrame, listed: DataFrame, *keys: str, column: str = "people") -> DataFrame:
    """Findings of the candidate runs in ``column`` whose key is listed; keys and offsets move, texts do not."""
    rows = runs.select(*keys, F.explode_outer(column).alias("g")).where(F.col("g").isNotNull())
    # No salting here: where one name makes up a large share of all rows, the adaptive skew join divides them.
    hits = rows.join(listed.select("key").distinct(), F.col("g.gram") == F.col("key"), "left_semi")
    return hits.select(
        *keys,
        F.lit("PERSON").alias("entity"),
        F.lit("name_list").alias("pattern_name"),
        F.col("g.start").alias("start"),
        F.col("g.end").alias("end"),
        F.col("g.value").alias("value"),
        F.lit(PERSON_SCORE).alias("score"),
        F.lit(DEFAULT_RECOGNIZERS.priority("PERSON")).alias("priority"),
    )


def person_findings(documents: DataFrame, names: DataFrame, *keys: str, text: str = "text", folders: list[str] | None = None) -> DataFrame:
    """One row per occurrence of a name in the first column of ``names``; the names' parts are written once."""
    listed = materialise(listed_names(names), "names", folders=folders)
    return matched(with_candidates(documents.select(*keys, F.col(text).alias("_text")), "_text", listed), listed, *keys)
