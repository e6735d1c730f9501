"""Settle duplicate and overlapping findings of one document.

Each step maps a sorted findings array to another, inside the row. Running maxima
replace interval self-joins, so a step is near-linear in the number of findings.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.arrays import let, max_before
from veilspan.functions.text import with_slicer


def _end(x: Column) -> Column:
    return -x["neg_end"]


def _with_span(x: Column, start: Column, end: Column, neg_score: Column, value: Column) -> Column:
    return F.struct(
        start.alias("start"),
        (-end).alias("neg_end"),
        neg_score.alias("neg_score"),
        x["priority"].alias("priority"),
        x["entity"].alias("entity"),
        x["pattern_name"].alias("pattern_name"),
        value.alias("value"),
    )


def of_entity(findings: Column, entity: str) -> Column:
    return F.filter(findings, lambda x: x["entity"] == entity)


def _per_entity(findings: Column, entities: Iterable[str], step) -> Column:
    """Apply ``step`` to each listed entity's findings; the others pass unchanged."""
    listed = list(entities)
    if not listed:
        return findings
    split = [step(of_entity(findings, e)) for e in listed]
    rest = F.filter(findings, lambda x: ~x["entity"].isin(listed))
    return F.array_sort(F.concat(rest, *split))


def dedupe(findings: Column, entities: Iterable[str]) -> Column:
    """Same entity and span: keep the highest score."""

    def first_of_each(found: Column) -> Column:
        # Sorted by start, end, score: the best copy comes first.
        return let(
            found,
            lambda fs: F.filter(
                fs,
                lambda x, i: (i == 0)
                | (F.get(fs, i - 1)["start"] != x["start"])
                | (F.get(fs, i - 1)["neg_end"] != x["neg_end"]),
            ),
        )

    return _per_entity(findings, entities, first_of_each)


def merge_same_entity(text: Column, findings: Column, entities: Iterable[str]) -> Column:
    """Overlapping findings of one entity become one: least start, greatest end, best score.

    Touching spans share no character and stay apart.
    """

    def islands(found: Column) -> Column:
        def build(fs: Column) -> Column:
            tops = max_before(F.transform(fs, _end))

            def cut(ts: Column) -> Column:
                heads = F.filter(F.sequence(F.lit(0), F.size(fs) - 1), lambda i: F.get(fs, i)["start"] >= F.get(ts, i))

                def assemble(hs: Column, cut_text) -> Column:
                    def island(h: Column, j: Column) -> Column:
                        stop = F.coalesce(F.get(hs, j + 1), F.size(fs))
                        members = F.slice(fs, h + 1, stop - h)
                        head = F.get(fs, h)
                        end = F.array_max(F.transform(members, _end))
                        best = F.array_min(F.transform(members, lambda m: m["neg_score"]))
                        value = F.when(end == _end(head), head["value"]).otherwise(cut_text(head["start"], end))
                        return _with_span(head, head["start"], end, best, value)

                    return F.transform(hs, island)

                return let(
                    heads,
                    lambda hs: F.when(F.size(hs) == F.size(fs), fs).otherwise(
                        with_slicer(text, F.size(hs), lambda cut_text: assemble(hs, cut_text))
                    ),
                )

            return F.when(F.size(fs) > 1, let(tops, cut)).otherwise(fs)

        return let(found, build)

    return _per_entity(findings, entities, islands)


def drop_contained(findings: Column) -> Column:
    """Drop a span inside another; of identical spans the best score, then priority, stays.

    In (start, longest, best) order a span is contained exactly if some earlier one
    ends at or after its end.
    """
    return let(
        findings,
        lambda fs: F.when(
            F.size(fs) > 1,
            let(
                max_before(F.transform(fs, _end)),
                lambda tops: F.filter(fs, lambda x, i: _end(x) > F.get(tops, i)),
            ),
        ).otherwise(fs),
    )


def clip_overlaps(findings: Column) -> Column:
    """Cut a span where the next one starts."""

    def clip(fs: Column) -> Column:
        def cut(x: Column, i: Column) -> Column:
            end = F.least(_end(x), F.get(fs, i + 1)["start"])
            return _with_span(
                x, x["start"], end, x["neg_score"], F.substring(x["value"], F.lit(1), end - x["start"])
            )

        return F.transform(fs, cut)

    return let(findings, lambda fs: F.when(F.size(fs) > 1, clip(fs)).otherwise(fs))


def overlapping_entities(recognizers, names: bool = False) -> list[str]:
    """Entities whose own findings can meet: several patterns, or a name list.

    One pattern alone never matches overlapping spans, so the rest need no
    same-entity step at all.
    """
    entities = [r.entity for r in recognizers]
    shared = {e for e in entities if entities.count(e) > 1}
    if names:
        shared.add("PERSON")
    return sorted(shared)


def resolve(text: Column, raw: Column, shared_entities: Iterable[str]) -> Column:
    """Raw findings to disjoint spans in text order."""
    shared = list(shared_entities)
    kept = raw
    if shared:
        kept = merge_same_entity(text, dedupe(kept, shared), shared)
    return clip_overlaps(drop_contained(kept))
