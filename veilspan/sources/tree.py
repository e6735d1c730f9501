"""Directories listed and files read in tasks, so that neither passes through the driver.

Spark's own lister works on the driver and leaves out hidden directories and names that begin with ``_``; a scanner for
secrets has to see ``.git/config`` and ``_build/settings.py``. Here a frontier of directories is a table. A task lists its
directories and goes down into what it finds until it has seen ``BUDGET`` entries; the directories still open then are the
next frontier, dealt to all tasks anew. A deep chain and a wide tree so both take few rounds, and the driver only asks
whether a frontier is empty.

Roots are plain paths, ``file:`` or any scheme that pyarrow's file systems open (object stores, HDFS). Other schemes are
for ``files.list_files``.

Rules: files whose name begins with ``.`` are left out, links to directories are not followed, and what is neither a
file nor a directory is passed over. A directory that cannot be listed, and a file that cannot be looked at or read, is a
row with an error; everything else goes on.
"""

from __future__ import annotations

import os
import re
import stat
import uuid
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache, partial, reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.session import materialise
from veilspan.sources.files import MAX_BYTES, check_directory, decode, had_crlf, is_text_path, list_files, source_encoding
from veilspan.sources.files import text_files as spark_text_files

#: Entries that a task lists below one directory before it hands on what is left.
BUDGET = 20_000
#: Rows and bytes of one batch on the way back to Spark.
ROWS, BYTES = 4096, 32 << 20
#: Bytes that one task reads, about.
SPLIT = 128 << 20
#: Files above this are read by ranges.
WHOLE = 64 << 20

_ENTRY = "path string, length long, modified double, is_directory boolean, error string"
_ENTRY_TYPES = pa.schema(
    [("path", pa.string()), ("length", pa.int64()), ("modified", pa.float64()), ("is_directory", pa.bool_()), ("error", pa.string())]
)


def scheme_of(path: str) -> str:
    return (re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path) or ["", ""])[1].lower()


def local_path(path: str) -> str | None:
    """The path on a mounted file system, or None for another store."""
    if scheme_of(path) not in ("", "file"):
        return None
    return re.sub(r"^file:(?://[^/]*)?", "", path)


@lru_cache(maxsize=16)
def _store(scheme: str, place: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a place, and what its own paths leave out of an address: the scheme, or the host with it."""
    store, inner = pafs.FileSystem.from_uri(f"{place}/x")
    return store, place if inner == "/x" else f"{scheme}://"


def opened(path: str) -> tuple[pafs.FileSystem, str, str]:
    """A file system, the path in it, and what stands before the paths that it lists."""
    place = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://[^/]*", path)
    if place is None:
        raise ValueError(f"not an address of a store: {path}")
    store, front = _store(place[1], place[0])
    return store, path[len(front) :], front


def listable(path: str) -> bool:
    """Whether tasks can list and read below ``path`` themselves."""
    if local_path(path) is not None:
        return True
    try:
        opened(path)
    except (ValueError, OSError, pa.ArrowException):
        return False
    return True


def _entries(directory: str) -> Iterator[tuple]:
    """path, length, modified, is_directory, error of what a directory holds."""
    local = local_path(directory)
    if local is not None:
        front = directory[: len(directory) - len(local)]
        try:
            with os.scandir(local) as found:
                for entry in found:
                    path = front + entry.path
                    try:
                        if entry.is_dir():
                            if not entry.is_symlink():
                                yield path, None, None, True, None
                        elif not entry.name.startswith("."):
                            info = entry.stat()
                            if stat.S_ISREG(info.st_mode):
                                yield path, info.st_size, info.st_mtime, False, None
                    except OSError as error:
                        yield path, None, None, False, error.strerror
        except OSError as error:
            yield directory, None, None, False, error.strerror
        return
    try:
        store, inner, front = opened(directory)
        for info in store.get_file_info(pafs.FileSelector(inner)):
            path = front + info.path
            if info.type == pafs.FileType.Directory:
                yield path, None, None, True, None
            elif info.type == pafs.FileType.File and not info.base_name.startswith("."):
                yield path, info.size, info.mtime and info.mtime.timestamp(), False, None
    except (OSError, pa.ArrowException) as error:
        yield directory, None, None, False, str(error)


def _listed(budget: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for directory in batch.column("path").to_pylist():
            waiting, seen = [directory], 0
            while waiting:
                if seen >= budget:
                    rows += [(path, None, None, True, None) for path in waiting]
                    break
                for entry in _entries(waiting.pop()):
                    seen += 1
                    if entry[3]:
                        waiting.append(entry[0])
                        continue
                    rows.append(entry)
                    if len(rows) >= ROWS:
                        yield _rows(rows, _ENTRY_TYPES)
                        rows = []
    if rows:
        yield _rows(rows, _ENTRY_TYPES)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def walk(spark: SparkSession, roots: str | Sequence[str], folders: list[str] | None = None, budget: int = BUDGET) -> DataFrame:
    """path, length, modified and error of all files below the roots; written to the shared work folder."""
    roots = [roots] if isinstance(roots, str) else list(roots)
    frontier = spark.createDataFrame([(root.rstrip("/") or "/",) for root in dict.fromkeys(roots)], "path string")
    levels: list[DataFrame] = []
    directories = len(roots)
    while directories:
        # As many tasks as there is work for; a handful of names would else be coalesced into one.
        dealt = frontier.repartition(min(directories, 4 * spark.sparkContext.defaultParallelism))
        found = materialise(dealt.mapInArrow(partial(_listed, budget), _ENTRY), "listing", folders=folders)
        levels.append(found.where("not is_directory"))
        frontier = found.where("is_directory").select("path")
        directories = frontier.count()
    files = reduce(DataFrame.unionAll, levels)
    return files.select("path", "length", F.timestamp_micros((F.col("modified") * 1_000_000).cast("long")).alias("modified"), "error")


def text_files(files: DataFrame) -> DataFrame:
    """Non-empty files with a text extension, and those that could not be looked at; no file is opened for that."""
    return files.where(is_text_path(F.col("path")) & ((F.col("length") > 0) | F.col("error").isNotNull()))


def read_bytes(path: str, low: int = 0, high: int | None = None) -> bytes:
    """Bytes ``low`` to ``high`` (the end) of a file."""
    local = local_path(path)
    if local is not None:
        with open(local, "rb") as file:
            file.seek(low)
            return file.read() if high is None else file.read(high - low)
    store, inner, _ = opened(path)
    with store.open_input_file(inner) as file:
        file.seek(low)
        return file.read() if high is None else file.read(high - low)


def reason(error: Exception) -> str:
    return getattr(error, "strerror", None) or str(error)


def _contents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for path, length, error in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "error"))):
            content = None
            if error is None:
                try:
                    # What was listed is read; a file that grows meanwhile does not.
                    content = read_bytes(path, 0, length)
                except (OSError, pa.ArrowException) as failed:
                    error = reason(failed)
            rows.append((path, content, error))
            held += len(content or b"") + 256
            if held >= BYTES:
                yield _rows(rows, _CONTENT_TYPES)
                rows, held = [], 0
    if rows:
        yield _rows(rows, _CONTENT_TYPES)


_CONTENT_TYPES = pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])


def spread(files: DataFrame) -> DataFrame:
    """``files`` dealt to tasks of about ``SPLIT`` bytes each, by the lengths that the listing has."""
    total = files.agg(F.sum("length").alias("bytes"), F.count("*").alias("n")).first()
    wide = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(1, min(total["n"], max(wide, (total["bytes"] or 0) // SPLIT))), "path")


def read_documents(files: DataFrame, whole: int = WHOLE) -> DataFrame:
    """path, text, unread (why there is no text), encoding and had_crlf of listed files of at most ``whole`` bytes.

    A file that cannot be read has a null text and the reason; nothing else is touched by it.
    """
    small = files.where((F.col("length") <= whole) | F.col("error").isNotNull())
    read = spread(small).mapInArrow(_contents, "path string, content binary, error string")
    content = F.col("content")
    return read.select("path", decode(content).alias("text"), F.col("error").alias("unread"), source_encoding(content).alias("encoding"), had_crlf(content).alias("had_crlf"))


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """path and text of all text files below a root, listed and read in tasks; by Spark's own lister where tasks cannot.

    Nothing is left out: what cannot be listed or read, or is larger than a row can hold, fails the read with its path and the reason.
    """
    if not listable(root):
        # Spark's reader itself fails for a file that it cannot read or that no row can hold.
        files = spark_text_files(list_files(spark, root, ignore_corrupt=False))
        return files.select("path", decode(F.col("content")).alias("text"))
    check_directory(spark, root)
    files = text_files(walk(spark, root))
    too_large = F.when(F.col("length") > MAX_BYTES, F.lit(f"larger than {MAX_BYTES} bytes"))
    read = read_documents(files.withColumn("error", F.coalesce("error", too_large)), MAX_BYTES)
    failed = F.raise_error(F.concat(F.lit("cannot read "), "path", F.lit(": "), "unread"))
    return read.select("path", F.when(F.col("unread").isNull(), F.col("text")).otherwise(failed).alias("text"))


def _put(path: str, parts: list[bytes]) -> None:
    """A file that is whole as soon as it has its name; a task that runs again replaces it by the same."""
    local = local_path(path)
    folder, name = (path if local is None else local).rsplit("/", 1)
    if local is not None:
        os.makedirs(folder, exist_ok=True)
        hidden = f"{folder}/.{uuid.uuid4().hex}"
        with open(hidden, "wb") as file:
            file.writelines(parts)
        os.replace(hidden, f"{folder}/{name}")
        return
    store, inner, _ = opened(path)
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(inner) as file:
        for part in parts:
            file.write(part)


def _written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, lines, files = None, [], 0
    for batch in batches:
        for path, value in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist()):
            if path != at:
                if at is not None:
                    _put(at, lines)
                at, lines, files = path, [], files + 1
            lines.append((value or "").encode() + b"\n")
    if at is not None:
        _put(at, lines)
    yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])


def write_lines(rows: DataFrame, root: str, key: str, folder: Column | None = None) -> None:
    """Rows (key, value) as files ``key=K/text.txt`` below ``root``, or a folder in it; a key's rows are the lines of its file.

    Tasks write the files themselves. A partitioned write of Spark's has the driver move every directory to its place one
    after the other, which takes longer than all the rest where each document is one.
    """
    name = F.concat(F.lit(f"{key}="), F.coalesce(F.col(key).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__")))
    if not listable(root):
        at = [] if folder is None else ["folder"]
        placed = rows if folder is None else rows.withColumn("folder", folder)
        for (part,) in placed.select("folder").distinct().collect() if at else [(None,)]:
            some = placed if part is None else placed.where(F.col("folder") == part).drop("folder")
            some.repartition(key).write.partitionBy(key).text(root if part is None else f"{root}/{part}")
        return
    top = [F.lit(root.rstrip("/"))] if folder is None else [F.lit(root.rstrip("/")), folder]
    named = rows.select(F.concat_ws("/", *top, name, F.lit("text.txt")).alias("path"), "value")
    written = named.repartition("path").sortWithinPartitions("path").mapInArrow(_written, "files long")
    if not written.agg(F.sum("files")).first()[0] and (local := local_path(root)) is not None:
        os.makedirs(local, exist_ok=True)
