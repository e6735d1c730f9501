"""One long document over many tasks: findings and redacted texts piece by piece, equal to those of the whole text.

A text is cut only before white space that stands behind a small letter other than r. No match of the ten patterns crosses such
a place, with two exceptions, and one pattern looks beyond it:

- an ADDRESS is a run of letters, digits, white space and a few marks. A place inside such a run is open if the run has a digit
  before it and a state with its ZIP code behind it;
- an SSH_KEY reaches to the end of a line, over empty lines too. A place is open until three lines that are not blank have
  ended behind the last key;
- a PASSWORD needs classes of characters ahead on its line (or in its text). Which of them still come behind the piece is one
  character each, set behind the piece when it is matched: they are too few for a match of any pattern.

Each piece tells a few facts: its length, line ends, keys, digits and ZIP codes in the runs at its ends, classes in its first
line. Windows over these narrow rows settle which places are open; pieces with an open place between them are one unit, that
is matched together, and every other piece is a unit of its own. Offsets are those of the whole text. Since no finding
crosses a unit's end, overlaps are settled and texts rebuilt in each unit alone.

A unit with an open place is as long as the run it may be an address in; a text without any place to cut is one piece.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.operators.detect import detect, public_finding
from veilspan.operators.redact import redact
from veilspan.operators.resolve import overlapping_entities
from veilspan.policy import DEFAULT_POLICY, Rule
from veilspan.recognizers import DEFAULT_RECOGNIZERS, PASSWORD_NEEDS, RecognizerSet
from veilspan.session import materialise

#: Characters of a piece, at least.
SIZE = 1 << 20
#: A text may be cut before this, behind that.
WHITE, BEHIND = " \n\t", "a-qs-z"

_P = "(?Ud)"
#: What an address is made of; its first number may have digits of any script.
_RUN = r"[A-Za-z\d\s\.,'#-]"
_NOT_RUN = r"[^A-Za-z\d\s\.,'#-]"
_ZIP = r",\s*[A-Z]{2}\s*\d{5}"
_SSH = r"ssh-(?:rsa|dss|ecdsa|ed25519)(?:\s|\z)"
#: The end of a line that is not blank.
_LINE_END = r"\S[^\S\n]*\n"
_LINES = 3
#: One character for each class that a password needs ahead.
_STAND_IN = dict(zip(PASSWORD_NEEDS, "aA0"))

FACTS = ["n_chars", "line_ends", "has_newline", "has_ssh", "ends_after_ssh", "one_run", "run_number", "run_zip", "head_classes", "all_classes"]


def pieces(text: Column, size: int = SIZE) -> Column:
    """A text as an array of pieces of at least ``size`` characters, the last one excepted; they join up to the text."""
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{{size}}}.*?(?=(?<=[{BEHIND}])[{WHITE}])|.+"), F.lit(0))
    return F.when(F.length(text) > size, cut).otherwise(F.array(text))


def facts(text: Column) -> dict[str, Column]:
    """What a piece tells of itself; all that the decisions need."""
    classes = lambda part: F.array_compact(F.array(*[F.when(part.rlike(_P + c), F.lit(_STAND_IN[c])) for c in PASSWORD_NEEDS]))
    one_run = ~text.rlike(_P + _NOT_RUN)
    head = F.regexp_extract(text, f"{_P}^{_RUN}*+", 0)
    # Up to the last character that no address holds: the greedy dot comes back to it from the end.
    tail = F.when(one_run, text).otherwise(F.regexp_extract(text, f"(?s){_P}^.*{_NOT_RUN}(.*)$", 1))
    after = F.regexp_extract(text, f"(?s){_P}^.*({_SSH}.*)$", 1)
    ends = lambda part: F.regexp_count(part, F.lit(_P + _LINE_END))
    return {
        "n_chars": F.length(text).cast("long"), "line_ends": ends(text).cast("long"), "has_newline": F.contains(text, F.lit("\n")),
        "has_ssh": text.rlike(_P + _SSH), "ends_after_ssh": ends(after).cast("long"), "one_run": one_run,
        "run_number": tail.rlike(_P + r"\d"), "run_zip": head.rlike(_P + _ZIP),
        "head_classes": classes(F.substring_index(text, "\n", 1)), "all_classes": classes(text),
    }


def decide(found: DataFrame, *keys: str, scope: str = "line") -> DataFrame:
    """keys, segment, unit, unit_start and ahead of every piece, from the pieces' facts (one narrow row each).

    ``unit``: the first segment of the piece's unit; ``unit_start``: the unit's place in the text, in characters; ``ahead``: the
    stand-ins of the classes behind the piece, after a space.
    """
    order = Window.partitionBy(*keys).orderBy("segment")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(1, Window.unboundedFollowing)
    at = F.col("segment")
    where = lambda condition: F.when(condition, at)

    lines = found.withColumns({"_ends": F.sum("line_ends").over(so_far), "_start": F.coalesce(F.sum("n_chars").over(before), F.lit(0))})
    since = F.last(F.when(F.col("has_ssh"), F.col("_ends") - F.col("ends_after_ssh")), ignorenulls=True).over(so_far)
    ssh = F.coalesce(F.col("_ends") - since < _LINES, F.lit(False))
    # The run at the end began where the last piece that is not all one run ends; a digit since then may begin an address.
    number = F.max(where(F.col("run_number"))).over(so_far) >= F.coalesce(F.max(where(~F.col("one_run"))).over(so_far), F.lit(-1))
    behind = F.min(where(F.col("run_zip"))).over(later) <= F.coalesce(F.min(where(~F.col("one_run"))).over(later), F.lit(1 << 62))
    is_open = ssh | (F.coalesce(number, F.lit(False)) & F.coalesce(behind, F.lit(False)))
    line_end = F.coalesce(F.min(where(F.col("has_newline"))).over(later), F.lit(1 << 62))

    def comes(stand_in: str) -> Column:
        if scope == "text":
            return F.coalesce(F.max(F.array_contains("all_classes", stand_in)).over(later), F.lit(False))
        # The first line of a piece goes on the line before it; a later piece counts only up to the line's end.
        first = F.min(where(F.array_contains("head_classes", stand_in))).over(later)
        return F.coalesce(first <= line_end, F.lit(False))

    ahead = F.concat(*[F.when(comes(c), F.lit(c)).otherwise(F.lit("")) for c in _STAND_IN.values()]) if scope != "token" else F.lit("")
    # Behind a space; at the text's end nothing may come behind it.
    ahead = F.when(ahead != "", F.concat(F.lit(" "), ahead)).otherwise(ahead)
    opened = lines.select(*keys, "segment", "_start", is_open.alias("_open"), ahead.alias("ahead"))
    head = ~F.coalesce(F.lag("_open").over(order), F.lit(False))
    unit = F.max(where(head)).over(so_far)
    units = opened.withColumns({"unit": unit, "_first": F.when(head, F.col("_start"))})
    return units.select(*keys, "segment", "unit", F.max("_first").over(so_far).alias("unit_start"), "ahead")


def _unknown(recognizers: RecognizerSet) -> list[str]:
    known = {(r.entity, r.regex) for r in DEFAULT_RECOGNIZERS}
    return [r.pattern_name for r in recognizers if (r.entity, r.regex) not in known]


def is_known(recognizers: RecognizerSet) -> bool:
    """Whether it is known of all patterns where a text may be cut."""
    return not (_unknown(recognizers) or recognizers.flags)


def require_known(recognizers: RecognizerSet) -> None:
    if not is_known(recognizers):
        other = _unknown(recognizers)
        raise ValueError(f"long texts are cut for the given patterns as written only, not for {other or recognizers.flags!r}")


def scope_of(recognizers: RecognizerSet) -> str:
    return next((r.scope for r in recognizers if r.needs_ahead), "token")


def split(documents: DataFrame, key: str, text: str = "text", size: int = SIZE, folders: list[str] | None = None) -> DataFrame:
    """key, segment and text of the pieces of every document, written once; a row number tells equal keys apart.

    The pieces leave the task that has the whole text: each is matched wherever there is room.
    """
    numbered = documents.select(F.col(key), F.col(text).alias("text")).withColumn("_row", F.monotonically_increasing_id())
    rows = numbered.select(key, "_row", F.posexplode(pieces(F.col("text"), size)).alias("segment", "text"))
    return materialise(rows.withColumn("segment", F.col("segment").cast("long")), "pieces", folders=folders)


def units_of(segments: DataFrame, key: str, row: str = "_row", scope: str = "line") -> DataFrame:
    """key, row, unit, unit_start, ahead and text of the units of written pieces.

    Pieces meet their decisions by (row, segment), so a long document spreads over all tasks. Only pieces with an open
    place between them are gathered, by unit.
    """
    decided = decide(segments.select(row, "segment", *[c.alias(n) for n, c in facts(F.col("text")).items()]), row, scope=scope)
    decided = decided.withColumn("_parts", F.count("*").over(Window.partitionBy(row, "unit")))
    met = segments.join(decided, [row, "segment"])
    alone = met.where("_parts = 1").select(key, row, "unit", "unit_start", "ahead", "text")
    glued = met.where("_parts > 1").groupBy(row, "unit").agg(
        F.first(key).alias(key), F.first("unit_start").alias("unit_start"), F.max_by("ahead", "segment").alias("ahead"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "text"))), lambda x: x["text"]), "").alias("text"),
    )
    return alone.unionByName(glued)


def detect_units(units: DataFrame, recognizers: RecognizerSet = DEFAULT_RECOGNIZERS) -> DataFrame:
    """``units`` with ``raw`` findings; ``text`` ends with the stand-ins while they are matched."""
    require_known(recognizers)
    return detect(units.withColumn("text", F.concat("text", "ahead")), recognizers=recognizers)


def findings_of_units(detected: DataFrame, *keys: str) -> DataFrame:
    """One row per finding with its place in the whole text."""
    rows = detected.select(*keys, "unit_start", F.explode_outer("raw").alias("f")).where(F.col("f").isNotNull())
    moved = {n: F.col("unit_start") + F.col(n) for n in ("start", "end")}
    return rows.select(*keys, "unit_start", *public_finding(F.col("f"))).withColumns(moved).drop("unit_start")


def redacted_units(detected: DataFrame, *keys: str, recognizers: RecognizerSet = DEFAULT_RECOGNIZERS, policy: Mapping[str, Rule] = DEFAULT_POLICY) -> DataFrame:
    """keys, unit, text and redacted of every unit; in order of ``unit`` they join up to the document's."""
    done = redact(detected, overlapping_entities(recognizers), policy)
    own = lambda c: F.substring(F.col(c), F.lit(1), F.length(c) - F.length("ahead"))
    return done.select(*keys, "unit", own("text").alias("text"), own("redacted").alias("redacted"))


def segmented_findings(
    documents: DataFrame, key: str, text: str = "text", recognizers: RecognizerSet = DEFAULT_RECOGNIZERS, size: int = SIZE, folders: list[str] | None = None
) -> DataFrame:
    """The findings of ``documents``, each text in pieces of ``size`` characters."""
    require_known(recognizers)
    units = units_of(split(documents, key, text, size, folders), key, scope=scope_of(recognizers))
    return findings_of_units(detect_units(units, recognizers), key)


def segmented_texts(
    documents: DataFrame, key: str, text: str = "text", recognizers: RecognizerSet = DEFAULT_RECOGNIZERS, size: int = SIZE,
    policy: Mapping[str, Rule] = DEFAULT_POLICY, entities: Iterable[str] | None = None, folders: list[str] | None = None,
) -> DataFrame:
    """key and redacted of ``documents``, each text matched in pieces of ``size`` characters and put together again."""
    chosen = recognizers if entities is None else recognizers.only(entities)
    units = units_of(split(documents, key, text, size, folders), key, scope=scope_of(chosen))
    done = redacted_units(detect_units(units, chosen), key, "_row", recognizers=chosen, policy=policy)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit", "redacted"))), lambda x: x["redacted"]), "")
    return done.groupBy("_row").agg(F.first(key).alias(key), whole.alias("redacted")).select(key, "redacted")
