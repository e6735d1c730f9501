"""Regex matches as (start, value) spans, row by row.

Spark has no regex function that returns positions. Here each match is wrapped in
a marker and the text split at the markers, so gaps and matches alternate and a
match starts at the summed length of everything before it: one regex pass, no
shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.arrays import let, sums_before

# A Unicode noncharacter. Texts that contain it take the two-pass route.
MARK = "\uffff"

NO_SPANS = "cast(array() as array<struct<start:int,value:string>>)"

# Up to so many parts, a start is the length of the joined parts before it: that costs less than a running sum.
FEW_PARTS = 33
# Look-aheads rescan the line at every word boundary: up to so many characters that costs less than a pass for each line and class.
SHORT_TEXT = 1024


def gaps_and_matches(text: Column, pattern: str, prefix: str = "", skip: str | None = None) -> Column:
    """[gap, match, gap, match, ..., gap]; what ``skip`` passed over belongs to the gaps."""
    if skip is None:
        whole, kept, passed = prefix + pattern, "$0", ""
    else:
        whole, kept, passed = f"{prefix}(?:({pattern})|({skip}))", "$1", "$2"
    marked = F.split(F.regexp_replace(text, F.lit(whole), F.lit(f"{MARK}{kept}{MARK}{passed}")), MARK, -1)

    def all_of(group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(whole), F.lit(group))

    gaps = F.split(text, whole, -1)
    if skip is None:
        woven = F.zip_with(gaps, all_of(0), lambda gap, hit: F.array(gap, F.coalesce(hit, F.lit(""))))
    else:
        both = F.zip_with(all_of(1), all_of(2), lambda hit, over: F.array(hit, over, F.lit("")))
        none = F.array(F.lit(""))
        woven = F.zip_with(gaps, both, lambda gap, rest: F.concat(F.array(gap), F.coalesce(rest, none)))
    # The last gap has no match behind it: an odd number of parts on either route.
    two_pass = let(F.flatten(woven), lambda parts: F.slice(parts, F.lit(1), F.size(parts) - 1))
    return F.when(F.contains(text, F.lit(MARK)), two_pass).otherwise(marked)


def parts_of(text: Column, recognizer, prefix: str) -> Column:
    """``gaps_and_matches`` of a recognizer; a ``backwards`` pattern runs over the reversed text."""
    if recognizer.backwards is None:
        return gaps_and_matches(text, recognizer.regex, prefix, recognizer.skip)
    parts = gaps_and_matches(F.reverse(text), recognizer.backwards, prefix, recognizer.skip)
    return F.transform(F.reverse(parts), lambda p: F.reverse(p))


def located(parts: Column) -> Column:
    """array<struct<start int, value string>> of the matches in ``gaps_and_matches``, in order."""

    def spans(ps: Column) -> Column:
        starts = sums_before(F.transform(ps, lambda p: F.length(p)))
        pairs = F.zip_with(ps, starts, lambda p, s: F.struct(s.alias("start"), p.alias("value")))
        return F.filter(pairs, lambda x, i: (i % 2 == 1) & (x["value"] != ""))

    def span(start: Column, value: Column) -> Column:
        return F.struct(start.alias("start"), value.alias("value"))

    def few(ps: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(ps) - 2, F.lit(2))
        pairs = F.transform(places, lambda i: span(F.length(F.array_join(F.slice(ps, F.lit(1), i), "")), F.get(ps, i)))
        return F.filter(pairs, lambda x: x["value"] != "")

    def build(ps: Column) -> Column:
        none, one = F.expr(NO_SPANS), F.array(span(F.length(F.get(ps, F.lit(0))), F.get(ps, F.lit(1))))
        single = F.when(F.get(ps, F.lit(1)) != "", one).otherwise(none)
        return F.when(F.size(ps) > FEW_PARTS, spans(ps)).when(F.size(ps) == 3, single).when(F.size(ps) > 1, few(ps)).otherwise(none)

    return let(parts, build)


def match_spans(text: Column, pattern: str) -> Column:
    """All matches of ``pattern`` as array<struct<start int, value string>>."""
    return located(gaps_and_matches(text, pattern))


def last_start(text: Column, classes: Sequence[str], prefix: str) -> Column:
    """Last position from which every class still occurs ahead; -1 if one never does."""
    ends = [F.length(F.regexp_extract(text, f"(?s){prefix}^.*{c}", 0)) - 1 for c in classes]
    return F.least(*ends) if len(ends) > 1 else ends[0]


def spans_with_ahead(text: Column, pattern: str, classes: Sequence[str], prefix: str, scope: str, one_line: bool = False) -> Column:
    """Matches of ``pattern`` that have every class at or after their start.

    Equal to one lookahead per class in front of the pattern: a lookahead that
    fails at a position fails at all later ones in its scope, so it is enough to
    compare each match's start with one position per line (or text). That takes
    one pass where the lookaheads rescan the line at every word boundary. Short texts
    take the lookaheads as they are; ``one_line`` says that no match holds a line end.
    """

    def present(value: Column) -> Column:
        found = value.rlike(prefix + classes[0])
        for c in classes[1:]:
            found = found & value.rlike(prefix + c)
        return found

    def within(part: Column) -> Column:
        return let(
            last_start(part, classes, prefix),
            lambda limit: F.filter(match_spans(part, pattern), lambda x: x["start"] <= limit),
        )

    if scope == "token":
        return F.filter(match_spans(text, pattern), lambda x: present(x["value"]))
    if scope == "text":
        return F.when(present(text), within(text)).otherwise(F.expr(NO_SPANS))

    def by_line(lines: Column) -> Column:
        starts = sums_before(F.transform(lines, lambda line: F.length(line) + 1))
        located = F.zip_with(lines, starts, lambda line, s: F.struct(line.alias("line"), s.alias("at")))
        useful = F.filter(located, lambda x: present(x["line"]))
        return F.flatten(
            F.transform(
                useful,
                lambda x: F.transform(
                    within(x["line"]),
                    lambda m: F.struct((m["start"] + x["at"]).alias("start"), m["value"].alias("value")),
                ),
            )
        )

    lines = let(F.split(text, "\n", -1), by_line)
    if one_line:
        bare = pattern.removeprefix(prefix)
        begin = r"\b" if bare.startswith(r"\b") else ""
        ahead = "".join(rf"(?=[^\n]*?{c})" for c in classes)
        lines = F.when(F.length(text) <= SHORT_TEXT, match_spans(text, f"{prefix}{begin}{ahead}{bare}")).otherwise(lines)
    return F.when(present(text), lines).otherwise(F.expr(NO_SPANS))
