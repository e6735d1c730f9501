"""Replacement expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.policy import Rule


def mask(value: Column, char: str, n: int, from_end: bool = False) -> Column:
    """Mask ``n`` characters; values no longer than that are masked whole."""
    hidden = F.repeat(F.lit(char), F.least(F.lit(n), F.length(value)))
    if from_end:
        return F.concat(F.substring(value, F.lit(1), F.greatest(F.length(value) - n, F.lit(0))), hidden)
    return F.concat(hidden, F.substring(value, F.lit(n + 1), F.length(value)))


def apply_rule(rule: Rule, value: Column) -> Column:
    if rule.op == "replace":
        return F.lit(rule.new_value)
    if rule.op == "mask":
        return mask(value, rule.mask_char, rule.mask_n, rule.from_end)
    # What a batch rule gives stands beside the text already (``redact``); here is what holds without it.
    done = rule.apply(value) if rule.op == "custom" else F.lit(None).cast("string")
    return F.coalesce(done, F.repeat(F.lit("*"), F.length(value))) if rule.on_null == "mask" else done


def replacement(entity: Column, value: Column, policy: Mapping[str, Rule]) -> Column:
    """The policy as one CASE over literals, so no lookup join is needed."""
    case = None
    for name, rule in policy.items():
        branch = apply_rule(rule, value)
        case = F.when(entity == name, branch) if case is None else case.when(entity == name, branch)
    return case.otherwise(F.raise_error(F.concat(F.lit("no redaction rule for "), entity)))
