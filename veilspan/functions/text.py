"""String helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.arrays import let

# Texts are sliced through blocks of this many code points once a plain substring,
# which walks from the start each time, would walk too far in total.
BLOCK = 4096
DIRECT_STEPS = 4_000_000


def strip(text: Column) -> Column:
    """Remove all leading and trailing whitespace, not only spaces.

    Taking what lies between is linear; deleting ``\\s+$`` rescans every inner gap.
    """
    return F.regexp_extract(text, r"(?Us)^[\s\x1c-\x1f]*+(.*[^\s\x1c-\x1f])?", 1)


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or '' when there is none."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^.*[^.].*?(\.[^.]*)$", 1))


def blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def slice_blocks(parts: Column, start: Column, end: Column) -> Column:
    """text[start:end] out of ``blocks(text)``."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((end - 1) / BLOCK).cast("int")
    piece = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
    return F.when(end > start, F.substring(piece, start - first * BLOCK + 1, end - start)).otherwise(F.lit(""))


def slice_text(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def with_slicer(text: Column, n_slices: Column, build) -> Column:
    """``build(cut)`` where ``cut(start, end)`` slices ``text``; picks the cheaper way per row."""
    direct = build(lambda s, e: slice_text(text, s, e))
    blocked = let(blocks(text), lambda parts: build(lambda s, e: slice_blocks(parts, s, e)))
    steps = F.length(text).cast("bigint") * n_slices
    return F.when(steps <= DIRECT_STEPS, direct).otherwise(blocked)
