"""Array helpers that keep work on one document linear and inside its row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefix folds copy their result at every step, so long arrays are folded in runs.
RUN = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def jvm_id() -> str:
    """Identifies the application whose JVM built columns belong to; no two have the same."""
    return SparkContext.getOrCreate().applicationId


def _fold(values: Column, first: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """[first, first+v0, first+v0+v1, ...]"""
    return F.aggregate(
        values,
        F.array(first),
        lambda acc, v: F.concat(acc, F.array(combine(F.element_at(acc, F.lit(-1)), v))),
    )


def before_each(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element, the combination of all elements before it.

    Long arrays go in two levels (runs, then run totals), which keeps a document
    with a million matches near n^1.5 cheap copies instead of n^2.
    """

    def long(v: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / F.lit(RUN)).cast("int")),
            lambda r: F.slice(v, r * RUN + 1, F.lit(RUN)),
        )

        def level_two(rs: Column) -> Column:
            totals = F.transform(rs, lambda r: F.aggregate(r, zero, combine))
            return F.flatten(
                F.zip_with(
                    rs,
                    F.slice(_fold(totals, zero, combine), F.lit(1), F.size(rs)),
                    lambda r, base: F.slice(_fold(r, base, combine), F.lit(1), F.size(r)),
                )
            )

        return let(runs, level_two)

    return let(
        values,
        lambda v: F.when(
            F.size(v) <= RUN, F.slice(_fold(v, zero, combine), F.lit(1), F.size(v))
        ).otherwise(long(v)),
    )


def sums_before(values: Column) -> Column:
    return before_each(values, F.lit(0), lambda a, b: a + b)


def max_before(values: Column) -> Column:
    """Running maximum of everything before; -1 at the first element."""
    return before_each(values, F.lit(-1), lambda a, b: F.greatest(a, b))
