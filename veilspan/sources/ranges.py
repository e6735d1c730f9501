"""Files of any size, read by byte ranges in many tasks.

1. Every range of a file looks for the first place at which the text may be cut (``segments``): an ASCII white space behind an
   ASCII letter, found a few kilobytes at a time. Such a place is a border between code points in UTF-8 and in Latin-1, and
   no ``\\r\\n`` stands across it. A range without one belongs to the piece before it.
2. Every piece is read and checked alone: a file is UTF-8 if all its pieces are, since a text that is cut between code points
   is valid exactly if its parts are. Pieces tell their facts as UTF-8, and as Latin-1 where that makes a difference.
3. The facts, a narrow row a piece, decide which pieces are matched together. A unit is a range of bytes again: it is
   read, decoded as its file is, and matched where there is room. No text is shuffled, copied or held beyond its unit.

A file is three short tables and two reads of its bytes; its size bounds nothing. A file that cannot be read, or that has no place
to cut within ``LARGEST`` bytes, is an error with the reason, and the others go on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.functions.text import unix_newlines
from veilspan.operators.segments import BEHIND, FACTS, WHITE, decide, facts
from veilspan.session import materialise
from veilspan.sources.tree import BYTES, ROWS, SPLIT, read_bytes, reason

#: Bytes of a range.
SIZE = 8 << 20
#: Bytes that one read of a search takes.
STEP = 4096
#: Bytes of a unit, at most: what one row can hold, with room for its decoding.
LARGEST = 1 << 29

_WHITE = frozenset(WHITE.encode())
_BEHIND = frozenset(b"abcdefghijklmnopqstuvwxyz")

_CUTS = pa.schema([("path", pa.string()), ("segment", pa.int64()), ("low", pa.int64()), ("length", pa.int64()), ("unread", pa.string())])


def first_cut(path: str, low: int, high: int, step: int = STEP) -> int | None:
    """The first byte from ``low`` on, before ``high``, at which the file may be cut."""
    at, last = low, b""
    if low:
        last = read_bytes(path, low - 1, low)
    while at < high:
        block = read_bytes(path, at, min(at + step, high))
        if not block:
            return None
        for k, byte in enumerate(block):
            if byte in _WHITE and (block[k - 1] if k else last and last[0]) in _BEHIND:
                return at + k
        at, last = at + len(block), block[-1:]
    return None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _cuts(size: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for path, length, segment in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "segment"))):
            low, error = segment * size, None
            try:
                cut = first_cut(path, low, min(low + size, length)) if segment else 0
            except (OSError, pa.ArrowException) as failed:
                cut, error = 0, reason(failed)
            if cut is not None:
                rows.append((path, segment, cut, length, error))
            if len(rows) >= ROWS:
                yield _batch(rows, _CUTS)
                rows = []
    if rows:
        yield _batch(rows, _CUTS)


def _reads(names: list[str], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges (path, low, high and more) with their contents beside them, or why there is none; about ``BYTES`` at a time."""
    for batch in batches:
        contents: list[bytes | None] = []
        errors: list[str | None] = []
        done, held = 0, 0

        def read_so_far() -> pa.RecordBatch:
            own = [batch.column(n).slice(done, len(contents)) for n in names]
            return pa.RecordBatch.from_arrays([*own, pa.array(contents, pa.binary()), pa.array(errors, pa.string())], [*names, "content", "unread"])

        for path, low, high in zip(*(batch.column(c).to_pylist() for c in ("path", "low", "high"))):
            if contents and (held + high - low > BYTES or len(contents) >= ROWS):
                yield read_so_far()
                done, held, contents, errors = done + len(contents), 0, [], []
            content, error = None, None
            try:
                content = read_bytes(path, low, high)
                if len(content) < high - low:
                    content, error = None, "shorter than when it was listed"
            except (OSError, pa.ArrowException) as failed:
                error = reason(failed)
            contents.append(content)
            errors.append(error)
            held += len(content or b"")
        if contents:
            yield read_so_far()


def _spread(ranges: DataFrame, length: Column) -> DataFrame:
    """Ranges dealt to tasks of about ``SPLIT`` bytes each, by ``length`` of a range; one file's ranges are in many tasks."""
    total = ranges.agg(F.count("*").alias("n"), F.sum(length).alias("bytes")).first()
    wide = 4 * ranges.sparkSession.sparkContext.defaultParallelism
    return ranges.repartition(max(1, min(total["n"], max(wide, (total["bytes"] or 0) // SPLIT))))


def _read(ranges: DataFrame) -> DataFrame:
    """``ranges`` (path, low, high and more) with content and unread."""
    schema = T.StructType([*ranges.schema, T.StructField("content", T.BinaryType()), T.StructField("unread", T.StringType())])
    return _spread(ranges, F.col("high") - F.col("low")).mapInArrow(partial(_reads, ranges.columns), schema)


def _latin(content: Column) -> Column:
    return unix_newlines(F.decode(content, "ISO-8859-1"))


def _utf(content: Column) -> Column:
    return unix_newlines(content.cast("string"))


def units_of_files(files: DataFrame, scope: str = "line", size: int = SIZE, folders: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(units, unreadable) of listed files (path, length).

    units: path, unit, unit_start, ahead, text, encoding, had_crlf and unread, ready to be matched; unreadable: path and unread, the
    reason. A unit that can no longer be read has no text but the reason.
    """
    segments = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))
    ranges = files.where("length > 0").select("path", "length", F.explode(segments).alias("segment"))
    cuts = materialise(
        _spread(ranges, F.lit(size).cast("long")).mapInArrow(partial(_cuts, size), "path string, segment long, low long, length long, unread string"), "cuts", folders=folders
    )
    order = Window.partitionBy("path").orderBy("segment")
    pieces = cuts.where("unread is null").withColumn("high", F.coalesce(F.lead("low").over(order), "length"))
    pieces = materialise(pieces.select("path", "segment", "low", "high"), "ranges", folders=folders)

    content = F.col("content")
    valid = F.is_valid_utf8(content.cast("string"))
    plain = F.octet_length("content") == F.length(content.cast("string"))
    struct = lambda text: F.struct(*[c.alias(n) for n, c in facts(F.col(text)).items()])
    # The texts are columns of their own: each fact would else decode them anew.
    decoded = _read(pieces.where(F.col("high") - F.col("low") <= LARGEST)).select(
        "path", "segment", "unread", valid.alias("valid"), F.contains(content, F.lit(b"\r")).alias("crlf"),
        F.when(valid, _utf(content)).alias("utf"), F.when(~valid | ~plain, _latin(content)).alias("latin"),
    )
    told = decoded.withColumns({n: F.when(F.col(n).isNotNull(), struct(n)) for n in ("utf", "latin")})
    told = materialise(told, "facts", folders=folders)
    whole = told.groupBy("path").agg(F.bool_and("valid").alias("valid"), F.bool_or("crlf").alias("had_crlf"), F.max("unread").alias("unread"))
    long = pieces.groupBy("path").agg(F.max(F.col("high") - F.col("low")).alias("longest")).where(F.col("longest") > LARGEST)
    too_long = F.lit(f"no place to cut within {LARGEST} bytes").alias("unread")
    unreadable = (
        cuts.where("unread is not null").select("path", "unread")
        .union(whole.where("unread is not null").select("path", "unread")).union(long.select("path", too_long))
    )
    good = whole.where("unread is null").join(long, "path", "left_anti").drop("unread")

    facts_of = F.when(F.col("valid"), F.col("utf")).otherwise(F.coalesce("latin", "utf"))
    met = told.drop("valid", "unread").join(good, "path").select("path", "segment", facts_of.alias("f")).select("path", "segment", *[f"f.{n}" for n in FACTS])
    decided = decide(met, "path", scope=scope).join(pieces, ["path", "segment"])
    units = decided.groupBy("path", "unit").agg(
        F.first("unit_start").alias("unit_start"), F.max_by("ahead", "segment").alias("ahead"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    units = materialise(units.join(good, "path"), "units", folders=folders)
    wide = units.where(F.col("high") - F.col("low") > LARGEST).select("path", too_long).distinct()
    wide = materialise(wide, "wide", folders=folders)
    units = units.join(wide, "path", "left_anti")
    unreadable = materialise(unreadable.union(wide).groupBy("path").agg(F.max("unread").alias("unread")), "unreadable", folders=folders)
    text = F.when(F.col("valid"), _utf(content)).otherwise(_latin(content))
    return _read(units).select(
        "path", "unit", "unit_start", "ahead", text.alias("text"),
        F.when(F.col("valid"), F.lit("utf-8")).otherwise(F.lit("latin-1")).alias("encoding"), "had_crlf", "unread",
    ), unreadable
