"""Scan and redact newly arriving documents continuously.

Detection, overlap resolution and redaction all stay inside the row, so the batch
expressions run on a stream unchanged and need no state, watermark or foreachBatch.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veilspan.operators.detect import detect, explode_findings
from veilspan.operators.redact import redact
from veilspan.operators.resolve import overlapping_entities
from veilspan.policy import DEFAULT_POLICY, Rule, require_rules
from veilspan.recognizers import DEFAULT_RECOGNIZERS, RecognizerSet


def stream_findings(
    documents: DataFrame, key: str = "path", recognizers: RecognizerSet = DEFAULT_RECOGNIZERS, names: Sequence[str] = ()
) -> DataFrame:
    return explode_findings(detect(documents, recognizers=recognizers, names=names), key)


def stream_redacted(
    documents: DataFrame,
    key: str = "path",
    recognizers: RecognizerSet = DEFAULT_RECOGNIZERS,
    names: Sequence[str] = (),
    policy: Mapping[str, Rule] = DEFAULT_POLICY,
) -> DataFrame:
    require_rules(policy, [r.entity for r in recognizers] + (["PERSON"] if names else []))
    detected = detect(documents, recognizers=recognizers, names=names)
    done = redact(detected, overlapping_entities(recognizers, bool(names)), policy)
    return done.select(key, done["redacted"].alias("text"))


def start(redacted: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append redacted documents to ``out``; each input row is written exactly once."""
    writer = redacted.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(out)
