"""How good recognizers are: found spans against true ones, entity by entity.

Spans of one side that overlap count as one (the rule that redaction follows too). Then, in each document and entity, both
sides are sorted and swept once: two spans that share a character are a pair, and each takes part in one pair at most. Since the
spans of a side are disjoint, pairing the two that come first wherever they meet gives as many pairs as there can be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.arrays import before_each, let


def merged(spans: Column) -> Column:
    """A sorted array<struct<start, end>> with overlapping spans in one; touching ones stay apart."""

    def join(heads: Column) -> Column:
        # A span that begins anew stands behind all before it: what was reached by then is the end of the one before.
        ends = F.concat(F.slice(F.transform(heads, lambda h: h["reached"]), F.lit(2), F.size(heads) - 1), F.array(F.array_max(F.transform(spans, lambda x: x["end"].cast("long")))))
        return F.zip_with(heads, ends, lambda h, end: F.struct(h["start"].alias("start"), end.alias("end")))

    reached = before_each(F.transform(spans, lambda x: x["end"].cast("long")), F.lit(-1).cast("long"), lambda a, b: F.greatest(a, b))
    placed = F.zip_with(spans, reached, lambda x, r: F.struct(x["start"].cast("long").alias("start"), r.alias("reached")))
    plain = spans.cast("array<struct<start:bigint,end:bigint>>")
    return F.when(F.size(spans) > 1, let(F.filter(placed, lambda h: h["start"] >= h["reached"]), join)).otherwise(plain)


def _sorted(start: str = "start", end: str = "end", where: Column | None = None) -> Column:
    span = F.struct(F.col(start).alias("start"), F.col(end).alias("end"))
    return F.sort_array(F.collect_list(span if where is None else F.when(where, span)))


def merged_spans(spans: DataFrame, *keys: str) -> DataFrame:
    """keys, entity, start and end with overlapping spans of one entity in one; touching ones stay apart."""
    types = [F.col(f"s.{n}").cast(spans.schema[n].dataType).alias(n) for n in ("start", "end")]
    gathered = spans.groupBy(*keys, "entity").agg(_sorted().alias("all"))
    return gathered.select(*keys, "entity", F.explode(merged(F.col("all"))).alias("s")).select(*keys, "entity", *types)


def pairs(left: Column, right: Column) -> Column:
    """How many spans of two sorted arrays of disjoint spans can be paired with one that they share a character with."""
    state = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("n"))

    def step(at: Column, _: Column) -> Column:
        a, b = F.get(left, at["i"]), F.get(right, at["j"])
        meet = (a["start"] < b["end"]) & (b["start"] < a["end"])
        # The one that ends first meets nothing that comes later.
        first = a["end"] <= b["end"]
        one, none = F.lit(1), F.lit(0)
        moved = F.struct(
            (at["i"] + F.when(meet | first, one).otherwise(none)).alias("i"),
            (at["j"] + F.when(meet | ~first, one).otherwise(none)).alias("j"),
            (at["n"] + F.when(meet, one).otherwise(none)).alias("n"),
        )
        return F.when((at["i"] < F.size(left)) & (at["j"] < F.size(right)), moved).otherwise(at)

    def one_each() -> Column:
        a, b = F.get(left, F.lit(0)), F.get(right, F.lit(0))
        return F.when((a["start"] < b["end"]) & (b["start"] < a["end"]), F.lit(1)).otherwise(F.lit(0))

    steps = F.sequence(F.lit(1), F.size(left) + F.size(right))
    none, single = (F.size(left) == 0) | (F.size(right) == 0), (F.size(left) == 1) & (F.size(right) == 1)
    return F.when(none, F.lit(0)).when(single, one_each()).otherwise(F.aggregate(steps, state, step)["n"])


def scores(found: DataFrame, true: DataFrame, *keys: str) -> DataFrame:
    """entity, n_true, n_found, tp, fp, fn, precision and recall; a share of nothing is null.

    Documents are independent; the spans of one document and entity are gathered, bounded by its text. Null keys are one document.
    """
    sides = [df.select(*keys, "entity", "start", "end", F.lit(side).alias("side")) for side, df in enumerate((found, true))]
    # Gathered once for both sides and merged in the row: a window over millions of groups of a span or two costs more than the matching.
    gathered = [_sorted(where=F.col("side") == side).alias(n) for side, n in enumerate(("f", "t"))]
    both = sides[0].unionByName(sides[1]).groupBy(*keys, "entity").agg(*gathered)
    documents = both.select("entity", merged(F.col("f")).alias("f"), merged(F.col("t")).alias("t"))
    counted = documents.select("entity", F.size("t").alias("n_true"), F.size("f").alias("n_found"), pairs(F.col("f"), F.col("t")).alias("tp"))
    total = counted.groupBy("entity").agg(*[F.sum(c).alias(c) for c in ("n_true", "n_found", "tp")])
    share = lambda of: F.when(F.col(of) > 0, F.col("tp") / F.col(of))
    return total.select(
        "entity", "n_true", "n_found", "tp", (F.col("n_found") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"),
        share("n_found").alias("precision"), share("n_true").alias("recall"),
    )
