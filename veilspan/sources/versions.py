"""Versioned output, backups and restore.

Data is always written to a fresh directory; a one-row pointer written after it
makes the version current. Readers therefore see a whole version or the one before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.functions.text import strip

# ---------------------------------------------------------------------------
# Statuses, messages and the timestamp format of backups.
# ---------------------------------------------------------------------------
MODIFIED, SKIPPED, ERROR = "modified", "skipped", "errors"
NEW, ORIGINAL = "new", "original"
NO_FILES = "No text files found."
FAILED = "Failed modifying "
BACKUP_STAMP = "%Y%m%d_%H%M%S"
# ---------------------------------------------------------------------------


def stamp(now: datetime | None = None) -> str:
    return (now or datetime.now(timezone.utc)).strftime(BACKUP_STAMP)


def is_changed(text: Column, redacted: Column) -> Column:
    """Whether there is more to write than whitespace at the ends."""
    return strip(text) != strip(redacted)


def output_text(text: Column, redacted: Column, append: bool = False) -> Column:
    """The redacted text, or in append mode the original with the redacted text below it."""
    return F.concat(text, F.lit("\n"), redacted) if append else redacted


def failure(name: Column, why: Column) -> Column:
    return F.concat(F.lit(FAILED), name, F.lit(": "), why)


def scrub_status_columns(
    key: str, text: str, result: str, append: bool, backup: Callable[[Column], Column] | None, reason: str | None = None
) -> dict[str, Column]:
    """``backup`` names the backup of a key; None if none is made. ``reason``: a column with why there is no text to redact."""
    failed = F.col(result).isNull()
    written = F.lit(append) | is_changed(F.col(text), F.col(result))
    status = F.when(failed, F.lit(ERROR)).when(written, F.lit(MODIFIED)).otherwise(F.lit(SKIPPED))
    name = F.col(key).cast("string")
    none = F.lit(None).cast("string")
    place = F.when(status == MODIFIED, backup(name)) if backup else none
    why = F.lit("no redacted text") if reason is None else F.coalesce(reason, F.lit("no redacted text"))
    error = F.when(failed, failure(name, why))
    return {"status": status, "backup_path": place, "error": error}


def scrub_status(
    redacted: DataFrame,
    key: str = "path",
    text: str = "text",
    result: str = "redacted",
    append: bool = False,
    backup_stamp: str | None = None,
    reason: str | None = None,
) -> DataFrame:
    """(key, status, backup_path, error) per document; one bad row does not stop the others."""
    named = (lambda name: F.concat(name, F.lit(f".backup_{backup_stamp}"))) if backup_stamp else None
    columns = scrub_status_columns(key, text, result, append, named, reason)
    return redacted.select(key, *[c.alias(name) for name, c in columns.items()])


def scrub_summary(status: DataFrame) -> DataFrame:
    """Files and backups per status. The lists themselves are the rows of ``scrub_status``."""
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("n_files"), F.count("backup_path").alias("n_backups"))


def unmatched(documents: DataFrame, redacted: DataFrame, key: str) -> DataFrame:
    """Keys on one side only; both counts must be zero before anything is written."""
    # Distinct keys: a key repeated many times must not gather in one task.
    left, right = documents.select(key).distinct(), redacted.select(key).distinct()
    missing = left.join(right, key, "left_anti").withColumn("problem", F.lit("no redacted result"))
    extra = right.join(left, key, "left_anti").withColumn("problem", F.lit("no source document"))
    return missing.unionByName(extra)


def status_of_empty(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(
        F.lit(None).cast("string").alias("path"),
        F.lit(ERROR).alias("status"),
        F.lit(None).cast("string").alias("backup_path"),
        F.lit(NO_FILES).alias("error"),
    )


def status_or_empty(documents: DataFrame, status: DataFrame) -> DataFrame:
    """``status``, or a single error row if there was nothing to scan."""
    return status_of_empty(documents.sparkSession) if documents.isEmpty() else status


def new_version_id(now: datetime) -> str:
    """Sorts by time; unique even for two runs in one second."""
    return f"{stamp(now)}_{now.microsecond:06d}_{uuid.uuid4().hex[:8]}"


def _write(rows: DataFrame, root: str, version: str) -> str:
    """Rows with a ``kind`` column as one version; current only once all of it is written."""
    rows.write.mode("errorifexists").partitionBy("kind").parquet(f"{root}/data/version={version}")
    publish(rows.sparkSession, root, version)
    return version


def write_version(df: DataFrame, root: str) -> str:
    """Write ``df`` as the new current version under ``root``; returns its id."""
    return _write(df.withColumn("kind", F.lit(NEW)), root, new_version_id(datetime.now(timezone.utc)))


def write_scrubbed(
    redacted: DataFrame,
    root: str,
    key: str = "path",
    text: str = "text",
    result: str = "redacted",
    create_backup: bool = True,
    append: bool = False,
    form: Sequence[str] = (),
    reason: str | None = None,
) -> str:
    """New texts, statuses and backups of the changed originals in one write.

    A changed document gives two rows, the new text and the original, in separate
    directories of the same version. The patterns run once, nothing is shuffled, and
    a text is never replaced without its backup: both appear with the same commit.
    ``form``: columns that say how a file was written (texts are UTF-8 with Unix line ends here), kept beside its text.
    ``reason``: a column with why a document has no text; such a document is an error row without text.
    """
    now = datetime.now(timezone.utc)
    version = new_version_id(now)
    backup = (lambda name: backup_place(root, version, name)) if create_backup else None
    status = scrub_status_columns(key, text, result, append, backup, reason)
    changed = status["status"] == MODIFIED
    out = F.when(changed, output_text(F.col(text), F.col(result), append)).otherwise(F.col(text))
    none = F.lit(None).cast("string")
    new = F.struct(
        F.lit(NEW).alias("kind"), out.alias("text"), status["status"].alias("status"),
        status["backup_path"].alias("backup_path"), status["error"].alias("error"),
    )
    original = F.struct(
        F.lit(ORIGINAL).alias("kind"), F.col(text).alias("text"), none.alias("status"),
        none.alias("backup_path"), none.alias("error"),
    )
    rows = F.when(changed, F.array(new, original)).otherwise(F.array(new)) if create_backup else F.array(new)
    return _write(redacted.select(key, *form, F.explode(rows).alias("r")).select(key, *form, "r.*"), root, version)


def backup_place(root: str, version: str, name: Column) -> Column:
    """Where a backup is: the folder of the version's originals and, behind ``#``, the key of the row."""
    return F.concat(F.lit(f"{root}/data/version={version}/kind={ORIGINAL}#"), name)


def publish(spark: SparkSession, root: str, version: str) -> None:
    published = datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
    pointer = spark.range(1).select(F.lit(version).alias("version"), F.lit(published).alias("published"))
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/pointer")


def current_version(spark: SparkSession, root: str) -> str:
    pointers = spark.read.schema("version string, published string").parquet(f"{root}/pointer")
    return pointers.agg(F.max_by("version", F.struct("published", "version")).alias("v")).first()["v"]


def read_version(spark: SparkSession, root: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root}/data/version={version}/kind={NEW}")


def read_current(spark: SparkSession, root: str) -> DataFrame:
    return read_version(spark, root, current_version(spark, root))


def read_status(spark: SparkSession, root: str, version: str, key: str = "path") -> DataFrame:
    """(key, status, backup_path, error) of a scrubbing run; its texts are not read."""
    return read_version(spark, root, version).select(key, "status", "backup_path", "error")


def status_of_documents(status: DataFrame, key: str = "path") -> DataFrame:
    """One row per document of several units: an error of any unit, else whether any was changed. Only statuses move."""
    rank = F.when(F.col("status") == ERROR, 2).when(F.col("status") == MODIFIED, 1).otherwise(0)
    worst = F.max_by(F.struct("status", "error"), rank).alias("s")
    rows = status.groupBy(key).agg(worst, F.max("backup_path").alias("backup_path"))
    return rows.select(key, "s.status", "backup_path", "s.error")


def read_backups(spark: SparkSession, root: str) -> DataFrame:
    """Originals kept by all runs; ``ts`` is the run's version, which sorts by time."""
    rows = spark.read.parquet(f"{root}/data").where(F.col("kind") == ORIGINAL)
    return rows.withColumn("ts", F.col("version").cast("string"))


def backup_rows(
    redacted: DataFrame, key: str, text: str = "text", result: str = "redacted", append: bool = False
) -> DataFrame:
    """Originals of the documents about to change."""
    changed = F.lit(append) | is_changed(F.col(text), F.col(result))
    return redacted.where(changed).select(key, F.col(text).alias("text"))


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def latest_backup(backups: DataFrame, key: str | Sequence[str], ts: str = "ts") -> DataFrame:
    """The newest backup row of each document.

    The newest stamps are found on keys alone; the match is on (key, stamp), so a
    document with very many backups does not gather in one task.
    """
    newest = backups.groupBy(*_keys(key)).agg(F.max(ts).alias(ts))
    return backups.join(newest, [*_keys(key), ts], "left_semi")


def rollback(spark: SparkSession, root: str, key: str = "path") -> str:
    """Publish a version in which every modified document has its latest backup again; returns its id.

    Only modified rows meet the backups; the others are copied as they are.
    """
    current = read_current(spark, root)
    changed = F.coalesce(F.col("status") == MODIFIED, F.lit(False))
    # Very large documents are several rows.
    keys = [key, *({"unit"} & set(current.columns))]
    back = restore(current.where(changed).select(*keys, "text"), read_backups(spark, root), keys)
    whole = current.where(~changed).select(*keys, "text").unionByName(back.select(*keys, "text"))
    return write_version(whole, root)


def restore(current: DataFrame, backups: DataFrame, key: str | Sequence[str], text: str = "text") -> DataFrame:
    """Current rows with the text of their latest backup where there is one."""
    latest = latest_backup(backups, key).select(*_keys(key), F.col("text").alias("_backup"))
    return current.join(latest, _keys(key), "left").withColumn(text, F.coalesce("_backup", text)).drop("_backup")
