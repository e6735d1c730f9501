"""Very many patterns of the user's own: only those whose literal occurs in a text run over it.

Most patterns hold a literal that every match must contain. One automaton of all literals (Aho-Corasick) goes over a text once, in
Arrow batches, and tells which occur; the cost hardly depends on their number. The few patterns that are left run in the
row, taken from a literal table of the plan, with the same marks and offsets as any other pattern. Patterns without such a
literal run over every text.

The literal is read off the pattern's parse: the longest run of characters in sequence, in groups and in repetitions that occur at
least once, never in alternatives, options or look-arounds. A pattern that cannot be read, or that ignores case, has none.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from re import _constants as ops
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.arrays import let
from veilspan.functions.spans import MARK, located
from veilspan.recognizers import Recognizer, RecognizerSet

#: From so many plain patterns on they are chosen by their literals.
MANY = 32
#: A shorter literal says too little.
LEAST = 3

_TABLE = "array<struct<regex:string,neg_score:double,priority:int,entity:string,pattern_name:string>>"


def is_plain(r: Recognizer) -> bool:
    """Whether a pattern is nothing but its regex."""
    return not (r.needs_text or r.needs_regex or r.needs_also or r.skip or r.needs_ahead or r.backwards)


def _runs(parsed: Sequence, open_run: str, out: list[str]) -> str:
    """Literal runs of a sequence go to ``out``; the run that is still open at its end comes back."""
    for op, value in parsed:
        if op is ops.LITERAL:
            open_run += chr(value)
        elif op is ops.IN and len(value) == 1 and value[0][0] is ops.LITERAL:
            open_run += chr(value[0][1])
        elif op is ops.SUBPATTERN and not value[1] and not value[2]:
            open_run = _runs(value[3], open_run, out)
        elif op is ops.AT:
            continue
        else:
            out.append(open_run)
            open_run = ""
            if op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and value[0] >= 1:
                out.append(_runs(value[2], "", out))
    return open_run


def literal(regex: str) -> str | None:
    """A text that every match of ``regex`` contains, as long as can be read off; None if there is none."""
    # Java's quoting, classes of classes and embedded flags are read otherwise here: such patterns have no literal.
    if re.search(r"\(\?[a-zA-Z-]|\\[QEpPxuvcN0-9k]|&&|\[[^\]]*\[", regex):
        return None
    try:
        parsed = parser.parse(regex)
    except (re.error, OverflowError, RecursionError):
        return None
    runs: list[str] = []
    runs.append(_runs(parsed, "", runs))
    best = max(runs, key=len)
    return best if len(best) >= LEAST else None


@lru_cache(maxsize=4)
def _automaton(literals: tuple[str, ...]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for number, text in enumerate(literals):
        machine.add_word(text, number)
    machine.make_automaton()
    return machine


def occurring(text: Column, literals: Sequence[str]) -> Column:
    """Numbers of the literals that occur in a text, in order."""
    sent = SparkSession.getActiveSession().sparkContext.broadcast(tuple(literals))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = _automaton(sent.value)
        for column in columns:
            found = [[] if value is None else sorted({number for _, number in machine.iter(value)}) for value in column.to_pylist()]
            yield pa.array(found, pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(text)


def parts(text: Column, pattern: Column) -> Column:
    """[gap, match, gap, …, gap] of a pattern that is a value; see ``spans.gaps_and_matches``."""
    marked = F.split(F.regexp_replace(text, pattern, F.lit(f"{MARK}$0{MARK}")), F.lit(MARK), -1)
    gaps = F.split(text, pattern, -1)
    woven = F.zip_with(gaps, F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, hit: F.array(gap, F.coalesce(hit, F.lit(""))))
    two_pass = let(F.flatten(woven), lambda all_: F.slice(all_, F.lit(1), F.size(all_) - 1))
    return F.when(F.contains(text, F.lit(MARK)), two_pass).otherwise(marked)


class Chosen:
    """Plain recognizers prepared for texts: ``numbers`` goes beside a text, ``findings`` uses it."""

    def __init__(self, plain: Sequence[Recognizer], recognizers: RecognizerSet) -> None:
        by_literal: dict[str, list[int]] = {}
        self.always: list[int] = []
        for number, r in enumerate(plain):
            own = None if "i" in recognizers.flags else literal(r.regex)
            (self.always if own is None else by_literal.setdefault(own, [])).append(number)
        self.literals = list(by_literal)
        self.members = list(by_literal.values())
        rows = [(recognizers.prefix + r.regex, -float(r.score), recognizers.priority(r.entity), r.entity, r.pattern_name) for r in plain]
        names = ("regex", "neg_score", "priority", "entity", "pattern_name")
        # Folded to one literal array when the plan is made.
        self.table = F.from_json(F.lit(json.dumps([dict(zip(names, row)) for row in rows])), _TABLE)
        self.groups = F.from_json(F.lit(json.dumps(self.members)), "array<array<int>>")

    def numbers(self, text: Column) -> Column:
        return occurring(text, self.literals) if self.literals else F.array().cast("array<int>")

    def findings(self, text: Column, numbers: Column) -> Column:
        """Findings of the patterns whose literals are ``numbers``, and of those without a literal; not in order."""
        always = F.array(*[F.lit(k) for k in self.always]).cast("array<int>")
        chosen = F.concat(always, F.flatten(F.transform(numbers, lambda k: F.get(self.groups, k))))

        def of(p: Column) -> Column:
            return F.transform(
                located(parts(text, p["regex"])),
                lambda x: F.struct(
                    x["start"].alias("start"), (-(x["start"] + F.length(x["value"]))).alias("neg_end"), p["neg_score"].alias("neg_score"),
                    p["priority"].alias("priority"), p["entity"].alias("entity"), p["pattern_name"].alias("pattern_name"), x["value"].alias("value"),
                ),
            )

        return F.flatten(F.transform(chosen, lambda k: let(F.get(self.table, k), of)))
