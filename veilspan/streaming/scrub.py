"""Scrub arriving documents batch by batch, with everything that a batch run has.

Each batch is scanned like a table: a table of names and a table of verdicts are joined to it, findings are settled, and
texts, statuses and originals are written as one version, named by the stream and the batch. A batch that is run again after a
failure is the same version: it is written once. ``manifest.read_merged`` gives the documents of all batches; one that
arrives again takes the place of its earlier self. Every ``compact_every`` batches the versions become one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veilspan.plans.scan import scan
from veilspan.sources import manifest


def _dealt(documents: DataFrame) -> DataFrame:
    """A batch of few scan splits dealt to four tasks a core; one with more stays where it is read.

    A batch is often one file, and a file one split or one row group: a single task would then match all its texts.
    """
    wide = 4 * documents.sparkSession.sparkContext.defaultParallelism
    return documents.repartition(wide) if documents.rdd.getNumPartitions() < wide else documents


def scrub_batch(documents: DataFrame, batch: int, root: str, stream: str = "stream", key: str = "path", compact_every: int = 100, **options) -> None:
    """One batch of documents (key, text), published once; ``options`` are those of ``scan``."""
    spark = documents.sparkSession
    if manifest.current(spark, root).batches.get(stream, -1) >= batch:
        return
    with scan(_dealt(documents), key, "text", **options) as result:
        entry = manifest.write_batch(result.redacted, root, stream, batch, key)
    if entry is not None and len(entry.chain) > compact_every:
        manifest.compact(spark, root, key)


def start_scrub(
    documents: DataFrame, root: str, checkpoint: str, stream: str = "stream", key: str = "path", available_now: bool = True, compact_every: int = 100, **options
) -> StreamingQuery:
    """Scrub a stream of documents into ``root``."""

    def run(batch: DataFrame, number: int) -> None:
        scrub_batch(batch, number, root, stream, key, compact_every, **options)

    writer = documents.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
