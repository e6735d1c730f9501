"""Run recognizers over a text column."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan import schemas
from veilspan.functions.arrays import jvm_id
from veilspan.functions.spans import NO_SPANS, located, parts_of, spans_with_ahead
from veilspan.functions.words import name_spans
from veilspan.operators import many
from veilspan.recognizers import DEFAULT_RECOGNIZERS, PASSWORD_RUN, PERSON_SCORE, Recognizer, RecognizerSet

NO_PARTS = "cast(array() as array<string>)"
NO_FINDINGS = f"cast(array() as {schemas.FINDINGS.simpleString()})"


def worth_matching(text: Column, r: Recognizer, recognizers: RecognizerSet) -> Column | None:
    """The cheap test a text must pass before the full pattern runs."""
    if r.needs_text is not None and "i" not in recognizers.flags:
        return F.contains(text, F.lit(r.needs_text))
    needed = r.needs_regex or r.needs_text
    return None if needed is None else text.rlike(recognizers.prefix + needed)


def _tagged(r: Recognizer, priority: int, parts: Column | None = None, spans: Column | None = None) -> Column:
    """A recognizer's constants beside what it found: gaps and matches, or finished spans."""
    return F.struct(
        F.lit(-float(r.score)).alias("neg_score"),
        F.lit(priority).alias("priority"),
        F.lit(r.entity).alias("entity"),
        F.lit(r.pattern_name).alias("pattern_name"),
        (F.expr(NO_PARTS) if parts is None else parts).alias("parts"),
        (F.expr(NO_SPANS) if spans is None else spans).alias("spans"),
    )


def _findings(tag: Column, spans: Column) -> Column:
    return F.transform(
        spans,
        lambda x: F.struct(
            x["start"].alias("start"),
            (-(x["start"] + F.length(x["value"]))).alias("neg_end"),
            tag["neg_score"].alias("neg_score"),
            tag["priority"].alias("priority"),
            tag["entity"].alias("entity"),
            tag["pattern_name"].alias("pattern_name"),
            x["value"].alias("value"),
        ),
    )


def _by_test(text: Column, recognizers: RecognizerSet, build) -> Column:
    """build(recognizer) for all, with recognizers that share a test behind one CASE."""
    groups: dict[tuple, list[Recognizer]] = {}
    for r in recognizers:
        groups.setdefault((r.needs_text, r.needs_regex), []).append(r)
    arrays = []
    for members in groups.values():
        worth = worth_matching(text, members[0], recognizers)
        tagged = F.array(*[build(r) for r in members])
        arrays.append(tagged if worth is None else F.when(worth, tagged))
    return F.flatten(F.array_compact(F.array(*arrays)))


def _build(text: Column, recognizers: RecognizerSet, names: Sequence[str]) -> Column:
    def one(r: Recognizer) -> Column:
        pattern = recognizers.prefix + r.regex
        priority = recognizers.priority(r.entity)
        if r.needs_ahead:
            return _tagged(
                r, priority, spans=spans_with_ahead(text, pattern, r.needs_ahead, recognizers.prefix, r.scope, r.regex == PASSWORD_RUN)
            )
        parts = parts_of(text, r, recognizers.prefix)
        if r.needs_also is not None:
            also = text.rlike(recognizers.prefix + r.needs_also)
            parts = F.when(also, parts).otherwise(F.expr(NO_PARTS))
        return _tagged(r, priority, parts=parts)

    groups = [_by_test(text, recognizers, one)] if len(recognizers) else []
    if names:
        person = Recognizer("PERSON", "name_list", "", PERSON_SCORE)
        groups.append(F.array(_tagged(person, recognizers.priority("PERSON"), spans=name_spans(text, names))))
    if not groups:
        return F.expr(NO_FINDINGS)
    tagged = F.filter(F.concat(*groups), lambda p: (F.size(p["parts"]) > 1) | (F.size(p["spans"]) > 0))
    # Offsets are worked out by one expression over whichever patterns matched.
    found = F.transform(
        tagged, lambda p: _findings(p, F.when(F.size(p["parts"]) > 1, located(p["parts"])).otherwise(p["spans"]))
    )
    # No finding is null; array_sort compares by an expression, this natively.
    return F.sort_array(F.flatten(found))


@lru_cache(maxsize=128)
def _cached(jvm: str, text: str, recognizers: RecognizerSet, names: tuple[str, ...]) -> Column:
    return _build(F.col(text), recognizers, names)


def findings_array(
    text: str, recognizers: RecognizerSet = DEFAULT_RECOGNIZERS, names: Sequence[str] = ()
) -> Column:
    """All raw findings of a text column as one array, in report order, before any resolution.

    Columns are immutable, so the large expression is assembled once per recognizer
    set and JVM.
    """
    return _cached(jvm_id(), text, recognizers, tuple(names))


def detect(
    df: DataFrame,
    text: str = "text",
    recognizers: RecognizerSet = DEFAULT_RECOGNIZERS,
    names: Sequence[str] = (),
    column: str = "raw",
) -> DataFrame:
    """Add the array of raw findings: one pass over the text, no shuffle.

    Where there are very many plain patterns, each runs only over texts that hold what its matches must contain (``many``).
    """
    plain = [r for r in recognizers if many.is_plain(r)]
    if len(plain) >= many.MANY:
        chosen = many.Chosen(plain, recognizers)
        rest = RecognizerSet([r for r in recognizers if not many.is_plain(r)], recognizers.flags, recognizers.entities)
        others = F.coalesce(findings_array(text, rest, names), F.expr(NO_FINDINGS)) if len(rest) or names else F.expr(NO_FINDINGS)
        found = F.coalesce(chosen.findings(F.col(text), F.col("_literals")), F.expr(NO_FINDINGS))
        asked = df.withColumn("_literals", chosen.numbers(F.col(text)))
        return asked.withColumn(column, F.array_sort(F.concat(others, found))).drop("_literals")
    return df.withColumn(column, F.coalesce(findings_array(text, recognizers, names), F.expr(NO_FINDINGS)))


def public_finding(x: Column) -> list[Column]:
    return [
        x["entity"].alias("entity"),
        x["pattern_name"].alias("pattern_name"),
        x["start"].alias("start"),
        (-x["neg_end"]).alias("end"),
        x["value"].alias("value"),
        (-x["neg_score"]).alias("score"),
        x["priority"].alias("priority"),
    ]


def explode_findings(df: DataFrame, *keys: str, column: str = "raw") -> DataFrame:
    """One row per finding, without the text."""
    # explode_outer + null test: a plain explode lets the optimizer copy the whole
    # detection expression into a size() filter below it, matching everything twice.
    rows = df.select(*keys, F.explode_outer(column).alias("f")).where(F.col("f").isNotNull())
    return rows.select(*keys, *public_finding(F.col("f")))


def gather_findings(findings: DataFrame, *keys: str, column: str = "raw") -> DataFrame:
    """Finding rows back to one sorted array per document.

    The group is one document's findings, so it is bounded by the text of that one
    row; only spans move, never texts.
    """
    packed = F.struct(
        F.col("start").alias("start"),
        (-F.col("end")).alias("neg_end"),
        (-F.col("score")).alias("neg_score"),
        F.col("priority").alias("priority"),
        F.col("entity").alias("entity"),
        F.col("pattern_name").alias("pattern_name"),
        F.col("value").alias("value"),
    )
    return findings.groupBy(*keys).agg(F.array_sort(F.collect_list(packed)).alias(column))
