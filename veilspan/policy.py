"""What replaces a finding: a fixed text or a mask, per entity."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from veilspan import schemas


@dataclass(frozen=True)
class Rule:
    op: str
    new_value: str | None = None
    mask_char: str | None = None
    mask_n: int | None = None
    from_end: bool = False
    apply: Callable[[Column], Column] | None = None
    on_null: str = "mask"
    batch: Callable[[list[str]], Sequence[str | None]] | None = None

    def __post_init__(self) -> None:
        if self.op == "replace":
            if self.new_value is None:
                raise ValueError("replace needs new_value")
        elif self.op == "mask":
            if not self.mask_char or len(self.mask_char) != 1 or self.mask_n is None or self.mask_n < 0:
                raise ValueError("mask needs one mask_char and mask_n >= 0")
        elif self.op in ("custom", "batch"):
            if (self.apply if self.op == "custom" else self.batch) is None:
                raise ValueError(f"{self.op} needs {'apply' if self.op == 'custom' else 'batch'}")
            if self.on_null not in ("mask", "error"):
                raise ValueError("on_null must be 'mask' or 'error'")
        else:
            raise ValueError(f"unknown op: {self.op!r}")


def replace_with(new_value: str) -> Rule:
    return Rule("replace", new_value=new_value)


def mask_with(char: str, n: int, from_end: bool = False) -> Rule:
    return Rule("mask", mask_char=char, mask_n=n, from_end=from_end)


def custom(apply: Callable[[Column], Column], on_null: str = "mask") -> Rule:
    """The user's own operation, as a function from the value column to its replacement.

    Where it gives null the value is masked whole, or with ``on_null='error'`` the document has no result and its status is
    an error. A value never stays and the text around it is never lost.
    """
    return Rule("custom", apply=apply, on_null=on_null)


def custom_batch(batch: Callable[[list[str]], Sequence[str | None]], on_null: str = "mask") -> Rule:
    """The user's own operation in Python: from distinct values to their replacements, an Arrow batch of documents at a time.

    Only values go to Python, and each once a batch however often it occurs. ``on_null`` as in ``custom``; a value for which
    ``batch`` fails counts as null.
    """
    return Rule("batch", batch=batch, on_null=on_null)


# ---------------------------------------------------------------------------
# The operation for each entity.
# ---------------------------------------------------------------------------
DEFAULT_POLICY: Mapping[str, Rule] = {
    "PERSON": replace_with("[REDACTED]"),
    "EMAIL_ADDRESS": mask_with("*", 10),
    "CREDIT_CARD": mask_with("*", 12),
    "PHONE_NUMBER": mask_with("*", 7),
    "US_SSN": mask_with("*", 7),
    "ADDRESS": replace_with("[REDACTED]"),
    "PASSWORD": replace_with("[REDACTED]"),
    "SSH_KEY": replace_with("[SSH_KEY_REDACTED]"),
    "AADHAAR_NUMBER": mask_with("X", 8),
    "PAN_NUMBER": mask_with("X", 6),
    "API_KEY": replace_with("[API_KEY_REDACTED]"),
}
# ---------------------------------------------------------------------------


def require_rules(policy: Mapping[str, Rule], entities: Iterable[str]) -> None:
    """Fail before the job starts if an entity has no rule."""
    missing = sorted(set(entities) - set(policy))
    if missing:
        raise ValueError(f"no redaction rule for: {', '.join(missing)}")


def policy_df(spark: SparkSession, policy: Mapping[str, Rule] = DEFAULT_POLICY) -> DataFrame:
    rows = [(e, r.op, r.new_value, r.mask_char, r.mask_n, r.from_end) for e, r in policy.items()]
    return spark.createDataFrame(rows, schemas.POLICY)


def policy_from_df(df: DataFrame) -> dict[str, Rule]:
    """A policy kept as a table; one row per entity. Its rules become literals of the plan."""
    rows = df.select(*schemas.POLICY.fieldNames()).collect()
    return {
        r["entity"]: Rule(r["op"], r["new_value"], r["mask_char"], r["mask_n"], bool(r["from_end"])) for r in rows
    }
