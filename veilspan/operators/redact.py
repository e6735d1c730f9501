"""Replace findings in their text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.arrays import jvm_id, let
from veilspan.functions.mask import apply_rule, replacement
from veilspan.functions.spans import parts_of
from veilspan.functions.text import with_slicer
from veilspan.operators.resolve import resolve
from veilspan.policy import DEFAULT_POLICY, Rule
from veilspan.recognizers import Recognizer, RecognizerSet


def _replaced(rules: Mapping[str, Rule]):
    """An Arrow function from arrays of (entity, value) to arrays of replacements; null for other entities and where there is none."""

    def alone(rule: Rule, value: str) -> str | None:
        try:
            return list(rule.batch([value]))[0]
        except Exception:
            return None

    def of(rule: Rule, values: list[str]) -> list[str | None]:
        try:
            found = list(rule.batch(values))
            if len(found) != len(values):
                raise ValueError("one replacement a value is needed")
            return found
        except Exception:
            return [alone(rule, value) for value in values]

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            rows = column.to_pylist()
            wanted: dict[str, dict[str, str | None]] = {entity: {} for entity in rules}
            for x in (x for row in rows for x in row or ()):
                if x["entity"] in wanted:
                    wanted[x["entity"]][x["value"]] = None
            for entity, values in wanted.items():
                values.update(zip(list(values), of(rules[entity], list(values)) if values else ()))
            yield pa.array([None if row is None else [wanted.get(x["entity"], {}).get(x["value"]) for x in row] for row in rows], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")


def rebuild(text: Column, kept: Column, policy: Mapping[str, Rule] = DEFAULT_POLICY, replaced: Column | None = None) -> Column:
    """The text with every kept (disjoint, ordered) span replaced; ``replaced`` goes before the policy where it is not null."""

    def pieces(cut) -> Column:
        def one(x: Column, i: Column) -> Column:
            gap_from = F.coalesce(-F.get(kept, i - 1)["neg_end"], F.lit(0))
            new = replacement(x["entity"], x["value"], policy)
            return F.concat(cut(gap_from, x["start"]), new if replaced is None else F.coalesce(F.get(replaced, i), new))

        tail = cut(-F.element_at(kept, F.lit(-1))["neg_end"], F.length(text))
        # array_join would skip a null piece and lose the text before it: without a replacement there is no result.
        whole = lambda all_: F.when(~F.exists(all_, lambda p: p.isNull()), F.concat(F.array_join(all_, ""), tail))
        return let(F.transform(kept, one), whole)

    return F.when(F.size(kept) > 0, with_slicer(text, F.size(kept), pieces)).otherwise(text)


def redact_one(text: Column, recognizer: Recognizer, recognizers: RecognizerSet, rule: Rule) -> Column:
    """Short way for a single plain pattern: no offsets, only gaps and matches."""
    if rule.op == "batch":
        raise ValueError("a batch rule needs the findings: use redact")
    parts = parts_of(text, recognizer, recognizers.prefix)
    changed = F.transform(parts, lambda p, i: F.when((i % 2 == 1) & (p != ""), apply_rule(rule, p)).otherwise(p))
    done = let(changed, lambda all_: F.when(~F.exists(all_, lambda p: p.isNull()), F.array_join(all_, "")))
    if recognizer.needs_text is not None:
        return F.when(F.contains(text, F.lit(recognizer.needs_text)), done).otherwise(text)
    if recognizer.needs_regex is not None:
        return F.when(text.rlike(recognizers.prefix + recognizer.needs_regex), done).otherwise(text)
    return done


@lru_cache(maxsize=128)
def _resolved(jvm: str, text: str, raw: str, shared: tuple[str, ...]) -> Column:
    return resolve(F.col(text), F.col(raw), shared)


@lru_cache(maxsize=128)
def _rebuilt(jvm: str, text: str, kept: str, rules: tuple[tuple[str, Rule], ...], replaced: str | None) -> Column:
    return rebuild(F.col(text), F.col(kept), dict(rules), None if replaced is None else F.col(replaced))


def redact(
    detected: DataFrame,
    shared_entities: Iterable[str] = (),
    policy: Mapping[str, Rule] = DEFAULT_POLICY,
    text: str = "text",
    raw: str = "raw",
) -> DataFrame:
    """Add ``kept`` (resolved findings) and ``redacted`` to a detected table; no shuffle."""
    resolved = detected.withColumn("kept", _resolved(jvm_id(), text, raw, tuple(shared_entities)))
    batches = {entity: rule for entity, rule in policy.items() if rule.op == "batch"}
    if batches:
        asked = F.transform("kept", lambda x: F.struct(x["entity"].alias("entity"), F.when(x["entity"].isin(*batches), x["value"]).alias("value")))
        resolved = resolved.withColumn("_replaced", _replaced(batches)(asked))
    rebuilt = _rebuilt(jvm_id(), text, "kept", tuple(policy.items()), "_replaced" if batches else None)
    return resolved.withColumn("redacted", rebuilt).drop("_replaced")
