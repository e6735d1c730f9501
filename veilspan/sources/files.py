"""Directories of files as a table of (path, text)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan import schemas
from veilspan.functions.text import basename, extension, strip, unix_newlines
from veilspan.sources.versions import ERROR, failure

# ---------------------------------------------------------------------------
# File extensions; '' stands for no extension.
# ---------------------------------------------------------------------------
TEXT_EXTENSIONS = (".txt", ".log", ".csv", ".json", ".xml", ".html", ".py", ".md", ".yml", ".ini", "")
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".webp")
PDF_EXTENSIONS = (".pdf",)
REPOSITORY_PREFIXES = ("http://", "https://")
# ---------------------------------------------------------------------------

# What one value of a row can hold; reading a larger file would fail the whole job.
MAX_BYTES = (1 << 31) - 1024


def is_repository(source: Column) -> Column:
    return F.startswith(source, F.lit(REPOSITORY_PREFIXES[0])) | F.startswith(source, F.lit(REPOSITORY_PREFIXES[1]))


def is_visible(path: Column) -> Column:
    """Hidden files by name; a hidden directory does not hide its files."""
    return ~F.startswith(basename(path), F.lit("."))


def is_text_path(path: Column) -> Column:
    return is_visible(path) & extension(path).isin(*TEXT_EXTENSIONS)


def file_kind(path: Column) -> Column:
    ext = extension(path)
    return (
        F.when(ext.isin(*TEXT_EXTENSIONS), F.lit("text"))
        .when(ext.isin(*IMAGE_EXTENSIONS), F.lit("image"))
        .when(ext.isin(*PDF_EXTENSIONS), F.lit("pdf"))
        .otherwise(F.lit("other"))
    )


def coverage(paths: DataFrame, path: str = "path") -> DataFrame:
    """How many files of each kind there are."""
    return paths.groupBy(file_kind(F.col(path)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def source_encoding(content: Column) -> Column:
    return F.when(F.is_valid_utf8(content.cast("string")), F.lit("utf-8")).otherwise(F.lit("latin-1"))


def decode(content: Column) -> Column:
    """Strict UTF-8, else Latin-1, with Unix newlines; a byte order mark stays."""
    as_utf8 = content.cast("string")
    decoded = F.when(F.is_valid_utf8(as_utf8), as_utf8).otherwise(F.decode(content, "ISO-8859-1"))
    return unix_newlines(decoded)


def had_crlf(content: Column) -> Column:
    return F.contains(F.decode(content, "ISO-8859-1"), F.lit("\r"))


NO_PATH = "no input directory given"
IS_REPOSITORY = "check the repository out first and scan its directory"


def path_problem(path: Column) -> Column:
    """Why an input cannot be a directory, as far as its name tells; null if it can."""
    blank = path.isNull() | (strip(path) == "")
    return F.when(blank, F.lit(NO_PATH)).when(is_repository(path), F.lit(IS_REPOSITORY))


def check_directory(spark: SparkSession, path: str) -> None:
    """Fail early on an empty path, a missing one, or one that is not a directory."""
    if not path or not path.strip():
        raise ValueError(NO_PATH)
    if path.startswith(REPOSITORY_PREFIXES):
        raise ValueError(f"{IS_REPOSITORY}: {path}")
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        raise ValueError(f"path does not exist: {path}")
    if not fs.getFileStatus(jvm_path).isDirectory():
        raise ValueError(f"path is not a directory: {path}")


def list_files(spark: SparkSession, paths: str | Sequence[str], ignore_corrupt: bool = True) -> DataFrame:
    """Files under one or several roots.

    Spark's own lister leaves out empty files and names (or directories) starting
    with '_' or '.'.
    """
    roots = [paths] if isinstance(paths, str) else list(paths)
    for root in roots:
        check_directory(spark, root)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreCorruptFiles", str(ignore_corrupt).lower())
        .load(roots)
    )


def text_files(files: DataFrame) -> DataFrame:
    """Visible, non-empty files with a text extension.

    The test is on the scan's metadata columns, so other files are dropped from the
    listing and their bytes are never read.
    """
    return files.where(is_text_path(F.col("_metadata.file_name")) & (F.col("length") > 0))


def documents_of(files: DataFrame, details: bool = False, limit: int = MAX_BYTES) -> DataFrame:
    """(path, text) of listed files; a file that cannot be read has no row, one above ``limit`` bytes is in ``oversized``.

    With ``details`` also encoding and had_crlf, for a writer that is to restore the file's form.
    """
    read = files.where(F.col("length") <= limit)
    more = [source_encoding(F.col("content")).alias("encoding"), had_crlf(F.col("content")).alias("had_crlf")] if details else []
    return read.select("path", decode(F.col("content")).alias("text"), *more).where(F.col("text").isNotNull())


def oversized(files: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """Status rows of the files above ``limit`` bytes; the others go on. Sizes come from the listing, nothing is read."""
    none = F.lit(None).cast("string")
    error = failure(F.col("path"), F.lit(f"larger than {limit} bytes"))
    return files.where(F.col("length") > limit).select(
        "path", F.lit(ERROR).alias("status"), none.alias("backup_path"), error.alias("error")
    )


def read_documents(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return documents_of(text_files(list_files(spark, paths)))


def stream_documents(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """The same documents as a stream of newly arriving files."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(schemas.BINARY_FILE)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", str(max_files_per_trigger))
        .load(path)
    )
    return documents_of(files.where(is_text_path(F.col("path")) & (F.col("length") > 0)))
