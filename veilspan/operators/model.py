"""Findings of a user's model: texts go to it in Arrow batches, spans come back and join those of the patterns.

A :class:`ModelHook` names a function that loads the model. A Python worker calls it once, whatever number of tasks and batches
it serves; batches are cut by bytes, so that long texts do not add up. The model gets a list of texts and gives for each a list
of (start, end, label) or (start, end, label, score). Offsets in UTF-8 bytes are turned into characters: a span that begins or ends inside
a character takes all of it.

Rules: labels are mapped by ``entities``, others are left out; spans are cut to their text, empty ones are dropped; a missing
score is the one of listed names. The findings then take part like any others: duplicates and overlaps of one entity
are merged, spans in another are dropped, those partly covered are cut. A batch that fails is given text by text; a
text that fails again is marked, so that it is an error and never passes for clean.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions.arrays import let
from veilspan.functions.text import with_slicer
from veilspan.recognizers import DEFAULT_RECOGNIZERS, PERSON_SCORE, RecognizerSet

#: Bytes of the texts that a model gets at once, about.
BATCH = 1 << 20
ATTEMPTS = 3

Model = Callable[[list[str]], Sequence[Sequence[tuple]]]

_SPANS = "array<struct<start:int,end:int,entity:string,score:double>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity", pa.string()), ("score", pa.float64())]))

#: Whether the model failed for a text.
FAILED = "model_failed"

#: Models of this worker by name.
_LOADED: dict[str, Model] = {}


@dataclass(frozen=True)
class ModelHook:
    """``name`` tells models (and their versions) apart in a worker; ``load`` gives the model; ``entities``: its labels and ours."""

    name: str
    load: Callable[[], Model]
    entities: Mapping[str, str] = field(default_factory=lambda: {"PERSON": "PERSON"})
    byte_offsets: bool = False
    score: float = PERSON_SCORE

    def model(self) -> Model:
        if self.name not in _LOADED:
            _LOADED[self.name] = self.load()
        return _LOADED[self.name]


def characters(text: str, offsets: list[int], up: bool) -> list[int]:
    """Byte offsets of a text's UTF-8 as characters; inside one, its begin or, going ``up``, its end."""
    data = np.frombuffer(text.encode(), np.uint8)
    begins = (data & 0xC0) != 0x80
    before = np.concatenate(([0], np.cumsum(begins)))
    at = np.clip(np.asarray(offsets, np.int64), 0, len(data))
    if up:
        return before[at].tolist()
    # Inside a character its first byte has been counted already.
    inside = (at < len(data)) & ~np.append(begins, True)[at]
    return (before[at] - inside).tolist()


def _spans(hook: ModelHook, text: str, found: Sequence[tuple]) -> list[dict]:
    kept = [(s, e, hook.entities[label], *rest) for s, e, label, *rest in found if label in hook.entities]
    starts, ends = [int(x[0]) for x in kept], [int(x[1]) for x in kept]
    if hook.byte_offsets:
        starts, ends = characters(text, starts, False), characters(text, ends, True)
    out = []
    for start, end, (_, _, entity, *rest) in zip(starts, ends, kept):
        start, end = max(start, 0), min(end, len(text))
        if start < end:
            score = hook.score if not rest or rest[0] is None else float(rest[0])
            out.append({"start": start, "end": end, "entity": entity, "score": score})
    return out


def _asked(hook: ModelHook, texts: list[str]) -> list[list[dict] | None]:
    """Spans of each text; None for a text that fails."""
    try:
        found = list(hook.model()(texts))
        if len(found) != len(texts):
            raise ValueError("one list of spans a text is needed")
        return [_spans(hook, text, spans) for text, spans in zip(texts, found)]
    except Exception:
        if len(texts) > 1:
            return [_asked(hook, [text])[0] for text in texts]
    for _ in range(ATTEMPTS - 1):
        try:
            (spans,) = hook.model()(texts)
            return [_spans(hook, texts[0], spans)]
        except Exception:
            continue
    return [None]


def model_spans(text: Column, hook: ModelHook, batch: int = BATCH) -> Column:
    """array<struct<start, end, entity, score>> of the model; null where it fails, and for a null text."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            texts = column.to_pylist()
            out: list[list[dict] | None] = [None] * len(texts)
            rows: list[int] = []
            held = 0
            for k, text in enumerate(texts):
                if text is None:
                    continue
                rows.append(k)
                held += len(text)
                if held >= batch:
                    for row, spans in zip(rows, _asked(hook, [texts[r] for r in rows])):
                        out[row] = spans
                    rows, held = [], 0
            for row, spans in zip(rows, _asked(hook, [texts[r] for r in rows]) if rows else ()):
                out[row] = spans
            yield pa.array(out, _SPAN_TYPE)

    return F.arrow_udf(run, _SPANS)(text)


def with_model(
    detected: DataFrame, hook: ModelHook, recognizers: RecognizerSet = DEFAULT_RECOGNIZERS, text: str = "text", raw: str = "raw", batch: int = BATCH
) -> DataFrame:
    """``detected`` with the model's findings among the raw ones, and whether the model failed for the text."""
    unknown = set(hook.entities.values()) - set(recognizers.entities)
    if unknown:
        raise ValueError(f"unknown entities: {sorted(unknown)}")
    priorities = F.create_map(*[F.lit(x) for e in sorted(set(hook.entities.values())) for x in (e, recognizers.priority(e))])

    def findings(spans: Column) -> Column:
        def build(cut) -> Column:
            return F.transform(
                spans,
                lambda s: F.struct(
                    s["start"].alias("start"), (-s["end"]).alias("neg_end"), (-s["score"]).alias("neg_score"),
                    F.element_at(priorities, s["entity"]).alias("priority"), s["entity"].alias("entity"),
                    F.lit(hook.name).alias("pattern_name"), cut(s["start"], s["end"]).alias("value"),
                ),
            )

        return with_slicer(F.col(text), F.size(spans), build)

    asked = detected.withColumn("_spans", model_spans(F.col(text), hook, batch))
    merged = let(F.col("_spans"), lambda spans: F.array_sort(F.concat(F.col(raw), findings(spans))))
    failed = F.col("_spans").isNull() & F.col(text).isNotNull()
    done = asked.withColumns({FAILED: failed, raw: F.when(F.col("_spans").isNotNull(), merged).otherwise(F.col(raw))})
    return done.drop("_spans")
