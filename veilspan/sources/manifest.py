"""Versions that hold only what changed, merged on reading, with a log that two writers cannot both extend.

Under ``root`` there are data folders, ``data/version=V/kind=…`` as in ``versions``, and ``log/``: entry N is one small file that names
the versions that make up the state, oldest first. Writing never touches what is there: data goes to a new folder, and the
entry after it makes it visible.

- ``write_full`` writes every text; ``write_changes`` writes the texts that changed, their originals and everyone's status.
- ``read_merged`` takes a document from the newest version that has it. Only keys are compared; the base's texts are not
  moved where Spark finds the changed keys small enough to send around. ``compact`` writes the merged state as one version.
- ``commit`` publishes entry ``expected + 1`` only if nobody else has: the file appears whole under its final name, or the
  name is taken and it is a :class:`Conflict`. Nothing is lost then; the loser reads the new state and tries again.

The log needs a store whose rename (or, on a mounted one, link) does not replace a file. A key names one document: a version
in which a key repeats is refused before it is published.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.sources import versions
from veilspan.sources.versions import MODIFIED, NEW, ORIGINAL

STATUS = "status"


class Conflict(RuntimeError):
    """Another writer has published since the state that this one was made from."""


class RepeatedKey(ValueError):
    """A key that is to name one document names several."""


@dataclass(frozen=True)
class Entry:
    """The state after ``number`` publications: the ``chain`` of versions, oldest first, and the last batch of every stream."""

    number: int = 0
    chain: tuple[str, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)
    published: str = ""


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def _place(root: str, number: int) -> str:
    return f"{root}/log/{number:020d}.json"


def current(spark: SparkSession, root: str) -> Entry:
    """The newest entry; without one, the state of nothing (number 0)."""
    fs, folder = _file_system(spark, f"{root}/log")
    if not fs.exists(folder):
        return Entry()
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    numbers = [int(name.removesuffix(".json")) for name in names if name.endswith(".json") and name[:1].isdigit()]
    if not numbers:
        return Entry()
    (line,) = spark.read.text(_place(root, max(numbers))).collect()
    entry = json.loads(line["value"])
    return Entry(entry["number"], tuple(entry["chain"]), entry["batches"], entry["published"])


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, jvm_path = _file_system(spark, path)
    out = fs.create(jvm_path, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def commit(spark: SparkSession, root: str, entry: Entry) -> Entry:
    """Publish ``entry``; raises :class:`Conflict` if its number is taken."""
    entry = replace(entry, published=datetime.now(timezone.utc).isoformat())
    target, draft = _place(root, entry.number), f"{root}/log/.draft-{uuid.uuid4().hex}"
    _write_text(spark, draft, json.dumps(asdict(entry)) + "\n")
    fs, source = _file_system(spark, draft)
    try:
        if fs.getUri().getScheme() == "file":
            local = lambda path: spark._jvm.java.io.File(fs.makeQualified(path).toUri().getPath()).toPath()
            spark._jvm.java.nio.file.Files.createLink(local(_file_system(spark, target)[1]), local(source))
        elif not fs.rename(source, _file_system(spark, target)[1]):
            raise Conflict(f"entry {entry.number} of {root} is published already")
    except Py4JJavaError as error:
        if "AlreadyExists" not in str(error.java_exception):
            raise
        raise Conflict(f"entry {entry.number} of {root} is published already") from error
    finally:
        fs.delete(source, False)
    return entry


def _folder(root: str, version: str) -> str:
    return f"{root}/data/version={version}"


def _new_version() -> str:
    return versions.new_version_id(datetime.now(timezone.utc))


def _require_single_keys(rows: DataFrame, key: str) -> None:
    """Over narrow rows that were written already."""
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise RepeatedKey(f"{key} {twice[0][key]!r} names several documents")


def write_full(df: DataFrame, root: str, expected: Entry, key: str = "path") -> Entry:
    """Every row of ``df`` (key, text and more) as the state after ``expected``, without what was before."""
    spark, version = df.sparkSession, _new_version()
    df.withColumn("kind", F.lit(NEW)).write.mode("errorifexists").partitionBy("kind").parquet(_folder(root, version))
    _require_single_keys(spark.read.parquet(f"{_folder(root, version)}/kind={NEW}").select(key), key)
    return commit(spark, root, Entry(expected.number + 1, (version,), expected.batches))


def changes(
    redacted: DataFrame, root: str, version: str, key: str, text: str, result: str, create_backup: bool, append: bool, every: bool, keep: Sequence[str] = ()
) -> DataFrame:
    """Rows by kind: everyone's status, the new texts and the originals of those that changed; with ``every``, all texts."""
    backup = (lambda name: versions.backup_place(root, version, name)) if create_backup else None
    status = versions.scrub_status_columns(key, text, result, append, backup)
    changed = status["status"] == MODIFIED
    none = F.lit(None).cast("string")
    said = [status[n].alias(n) for n in ("status", "backup_path", "error")]
    unsaid = [none.alias(n) for n in ("status", "backup_path", "error")]
    row = lambda kind, content, more: F.struct(F.lit(kind).alias("kind"), content.alias("text"), *more)
    out = F.when(changed, versions.output_text(F.col(text), F.col(result), append)).otherwise(F.col(text))
    new = [row(NEW, out, unsaid)]
    original = [row(ORIGINAL, F.col(text), unsaid)] if create_backup else []
    of_changed = F.array(row(STATUS, none, said), *new, *original)
    of_same = F.array(row(STATUS, none, said), *(new if every else []))
    return redacted.select(key, *keep, F.explode(F.when(changed, of_changed).otherwise(of_same)).alias("r")).select(key, *keep, "r.*")


def write_changes(
    redacted: DataFrame, root: str, expected: Entry, key: str = "path", text: str = "text", result: str = "redacted",
    create_backup: bool = True, append: bool = False,
) -> Entry:
    """What scrubbing changes in the state ``expected``, as the next one; texts that stay are not written again."""
    version, spark = _new_version(), redacted.sparkSession
    rows = changes(redacted, root, version, key, text, result, create_backup, append, every=False)
    rows.write.mode("errorifexists").partitionBy("kind").parquet(_folder(root, version))
    _require_single_keys(read_status(spark, root, version, key), key)
    return commit(spark, root, replace(expected, number=expected.number + 1, chain=(*expected.chain, version)))


def write_batch(
    redacted: DataFrame, root: str, stream: str, batch: int, key: str = "path", text: str = "text", result: str = "redacted", create_backup: bool = True
) -> Entry | None:
    """A stream's batch of documents as one version named by it; None if it is published already.

    A batch that is repeated because its first try was cut off writes its folder anew; one whose entry stands writes nothing. Another
    writer's entry in between is no conflict: a batch only adds, so it goes behind that.
    """
    spark, version = redacted.sparkSession, f"{stream}-{batch:012d}"
    if current(spark, root).batches.get(stream, -1) >= batch:
        return None
    rows = changes(redacted, root, version, key, text, result, create_backup, append=False, every=True)
    rows.write.mode("overwrite").partitionBy("kind").parquet(_folder(root, version))
    _require_single_keys(read_status(spark, root, version, key), key)
    while True:
        now = current(spark, root)
        if now.batches.get(stream, -1) >= batch:
            return None
        try:
            return commit(spark, root, Entry(now.number + 1, (*now.chain, version), {**now.batches, stream: batch}))
        except Conflict:
            continue


def _has(spark: SparkSession, root: str, version: str, kind: str) -> bool:
    fs, path = _file_system(spark, f"{_folder(root, version)}/kind={kind}")
    return fs.exists(path)


def _read(spark: SparkSession, root: str, version: str, kind: str) -> DataFrame:
    return spark.read.parquet(f"{_folder(root, version)}/kind={kind}")


def read_status(spark: SparkSession, root: str, version: str, key: str = "path") -> DataFrame:
    """(key, status, backup_path, error) of a version of changes; no text is read."""
    return _read(spark, root, version, STATUS).select(key, "status", "backup_path", "error")


def read_merged(spark: SparkSession, root: str, key: str = "path", entry: Entry | None = None) -> DataFrame:
    """key and text of every document, from the newest version of the chain that has it.

    Documents of one version are as they were written there: a reader of ``entry`` is not disturbed by later writers.
    """
    entry = entry or current(spark, root)
    # A version of changes may have changed nothing.
    present = [v for v in entry.chain if _has(spark, root, v, NEW)]
    if not present:
        raise ValueError(f"nothing was published under {root}")
    rows = [_read(spark, root, v, NEW).select(key, "text").withColumn("_at", F.lit(k)) for k, v in enumerate(present)]
    if len(rows) == 1:
        return rows[0].drop("_at")
    newer = reduce(DataFrame.unionAll, rows[1:])
    # Keys alone settle which version a document comes from; a null key is one, too.
    newest = newer.groupBy(F.col(key).alias("_key")).agg(F.max("_at").alias("_newest"))
    same = F.col(key).eqNullSafe(F.col("_key"))
    kept = rows[0].join(newest, same, "left_anti")
    taken = newer.join(newest, same & (F.col("_at") == F.col("_newest")), "left_semi")
    return kept.unionByName(taken).select(key, "text")


def compact(spark: SparkSession, root: str, key: str = "path") -> Entry:
    """The merged state as one version; readers of older entries still find theirs."""
    entry = current(spark, root)
    return write_full(read_merged(spark, root, key, entry), root, entry, key)
