"""Runs of words with offsets, for names given as a list or a table.

Names and texts are cut into words by the same pattern. Two runs are equal if their words and the gaps between them are,
white space of any kind and length counting as one space: ``J. Smith`` is found as written, also over a line break.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.arrays import let, sums_before
from veilspan.functions.spans import gaps_and_matches

# A word, its inner joiners included, so O'Neil and Anne-Marie stay whole. The loops are
# possessive: a greedy group loop recurses in the JVM and overflows on very long words.
WORD = r"(?Ud)\w[\w#]*+(?:['’.-][\w#]++)*+"

NO_RUNS = "cast(array() as array<struct<start:int,end:int,gram:string,value:string>>)"


def plain(piece: Column) -> Column:
    return F.regexp_replace(piece, r"(?U)\s+", " ")


def name_parts(name: Column) -> Column:
    """struct<key, words, first, second> of a name; key is null without words. What is outside the words does not count."""

    def build(parts: Column) -> Column:
        inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
        some = F.size(parts) > 1
        return F.struct(
            F.when(some, F.array_join(F.transform(inner, plain), "")).alias("key"),
            F.floor(F.size(parts) / 2).cast("int").alias("words"),
            F.get(parts, F.lit(1)).alias("first"),
            F.get(parts, F.lit(3)).alias("second"),
        )

    return let(gaps_and_matches(name, WORD), build)


def word_runs(
    text: Column, lengths: Sequence[int], may_begin: Callable[[Column], Column],
    may_go_on: Callable[[Column, Column, Column], Column] | None = None, may_be: Callable[[Column], Column] | None = None,
) -> Column:
    """array<struct<start, end, gram, value>>: runs of each of ``lengths`` words that pass three tests, each before the next one's work.

    ``may_begin`` of the first word; ``may_go_on`` of the first and second word (null for a run of one) and the length;
    ``may_be`` of the run as names are compared.
    """
    if not lengths:
        return F.expr(NO_RUNS)

    def build(parts: Column) -> Column:
        def heads(places: Column) -> Column:
            return F.filter(places, lambda i: F.coalesce(may_begin(F.get(parts, i)), F.lit(False)))

        def grams(i: Column) -> Column:
            def of_length(n: Column) -> Column:
                second = F.when(n > 1, F.get(parts, i + 2))
                within = i + 2 * (n - 1) < F.size(parts)
                if may_go_on is not None:
                    within = within & may_go_on(F.get(parts, i), second, n)
                gram = F.array_join(F.transform(F.slice(parts, i + 1, 2 * n - 1), plain), "")
                return F.when(within, F.struct(i.alias("i"), n.alias("n"), gram.alias("gram")))

            found = F.array_compact(F.transform(F.array(*[F.lit(n) for n in lengths]), of_length))
            return found if may_be is None else F.filter(found, lambda g: may_be(g["gram"]))

        def runs(found: Column) -> Column:
            # Offsets and values are worked out for what passed only.
            starts = sums_before(F.transform(parts, lambda p: F.length(p)))

            def placed(at: Column) -> Column:
                def run(g: Column) -> Column:
                    value = F.array_join(F.slice(parts, g["i"] + 1, 2 * g["n"] - 1), "")
                    start = F.get(at, g["i"])
                    return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), g["gram"].alias("gram"), value.alias("value"))

                return F.transform(found, run)

            return F.when(F.size(found) > 0, let(starts, placed)).otherwise(F.expr(NO_RUNS))

        # Odd places hold words, even places the gaps between them.
        places = F.sequence(F.lit(1), F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(2))
        return let(F.flatten(F.transform(heads(places), grams)), runs)

    return let(gaps_and_matches(text, WORD), build)


def listed_names(names: DataFrame) -> DataFrame:
    """Distinct key, words, first and second of the names in the first column."""
    # The generator keeps the test of the key behind names that are dealt out: it would cut them all in the scan's few tasks, and once more.
    parts = names.select(F.explode_outer(F.array(name_parts(F.col(names.columns[0])))).alias("n"))
    return parts.where("n.key is not null").select("n.key", "n.words", "n.first", "n.second").distinct()


def name_spans(text: Column, names: Sequence[str]) -> Column:
    """Spans of listed names; the list is a literal set, so this stays inside the row."""
    spark = SparkSession.builder.getOrCreate()
    rows = listed_names(spark.createDataFrame([(n,) for n in sorted(set(names))], "name string")).collect()
    firsts, keys = sorted({r["first"] for r in rows}), sorted({r["key"] for r in rows})
    runs = word_runs(text, sorted({r["words"] for r in rows}), lambda word: word.isin(firsts), may_be=lambda gram: gram.isin(keys))
    return F.transform(runs, lambda g: F.struct(g["start"].alias("start"), g["value"].alias("value")))
