"""Findings as readable entries, and counts over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.operators.resolve import of_entity
from veilspan.session import materialise

# ---------------------------------------------------------------------------
# The lines of an empty report and the mark of a confirmed finding.
# ---------------------------------------------------------------------------
NOTHING_FOUND = "No sensitive data detected."
NOTHING_REDACTED = "No data to anonymize or no sensitive data found."
CONFIRMED = " (confirmed)"
# ---------------------------------------------------------------------------


def entry(entity: Column, value: Column, score: Column, confirmed: Column | None = None) -> Column:
    """ENTITY=value:score, marked when a verdict confirmed it."""
    line = F.concat(entity, F.lit("="), value, F.lit(":"), score.cast("string"))
    if confirmed is None:
        return line
    return F.concat(line, F.when(confirmed, F.lit(CONFIRMED)).otherwise(F.lit("")))


def hide_values(findings: DataFrame) -> DataFrame:
    """Replace raw values by their SHA-256, for reports that may be shared."""
    return findings.withColumn("value_hash", F.sha2(F.col("value"), 256)).drop("value")


def order_columns(*keys: str) -> list[Column]:
    return [
        *[F.col(k) for k in keys],
        F.col("start"),
        F.col("end").desc(),
        F.col("score").desc(),
        F.col("priority"),
        F.col("pattern_name"),
    ]


def report_entries(findings: DataFrame, *keys: str, confirmed: bool = False) -> DataFrame:
    """One entry per finding, ordered over all documents (a range-partitioned sort)."""
    mark = F.lit(True) if confirmed else None
    return findings.orderBy(*order_columns(*keys)).select(
        *keys, "start", "end", entry(F.col("entity"), F.col("value"), F.col("score"), mark).alias("entry")
    )


def report_joined(detected: DataFrame, *keys: str, raw: str = "raw") -> DataFrame:
    """Each document's entries joined by newlines, or a fixed line when there are none."""
    lines = F.transform(F.col(raw), lambda x: entry(x["entity"], x["value"], -x["neg_score"]))
    joined = F.array_join(lines, "\n")
    return detected.select(
        *keys, F.when(F.size(raw) > 0, joined).otherwise(F.lit(NOTHING_FOUND)).alias("report")
    )


def or_line(rows: DataFrame, column: str, line: str) -> DataFrame:
    """``rows``, or if there are none one row with only ``line`` in ``column``."""
    if not rows.isEmpty():
        return rows
    empty = [F.lit(line if f.name == column else None).cast(f.dataType).alias(f.name) for f in rows.schema]
    return rows.sparkSession.range(1).select(*empty)


def redacted_in_order(redacted: DataFrame, *keys: str, column: str = "redacted") -> DataFrame:
    """The redacted texts of all documents in the order of their keys, or one fixed line (a range-partitioned sort)."""
    return or_line(redacted.select(*keys, column).orderBy(*keys), column, NOTHING_REDACTED)


def write_report(findings: DataFrame, path: str, *keys: str, confirmed: bool = False) -> None:
    """The whole report as text part files, in order; never one string on the driver."""
    # A global sort samples its input first, which would run the patterns twice:
    # the findings, small beside the texts, are written once and sorted from there.
    entries = report_entries(materialise(findings, "report"), *keys, confirmed=confirmed)
    entries = or_line(entries, "entry", NOTHING_FOUND)
    # Newlines inside a value would split its line.
    entries.select(F.replace("entry", F.lit("\n"), F.lit("\\n")).alias("value")).write.mode("overwrite").text(path)


def count_by_entity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


def count_by_document(detected: DataFrame, *keys: str, raw: str = "raw") -> DataFrame:
    """Findings per document, read off the row's own array."""
    return detected.select(*keys, F.size(raw).alias("n"))


def pivot_by_document(detected: DataFrame, entities: Sequence[str], *keys: str, raw: str = "raw") -> DataFrame:
    """One count column per entity, without a shuffle."""
    columns = [F.size(of_entity(F.col(raw), e)).alias(e.lower()) for e in entities]
    return detected.select(*keys, *columns)


def rollup_counts(findings: DataFrame, *levels: str) -> DataFrame:
    """Totals for every prefix of ``levels``; counted first, so the rollup expands few rows."""
    counted = findings.groupBy(*levels).agg(F.count(F.lit(1)).alias("n"))
    return counted.rollup(*levels).agg(F.sum("n").alias("n"))
