"""Pages of a document put together in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The page headings.
# ---------------------------------------------------------------------------
HEADING = "\n--- Page %d ---\n"
HEADING_EMPTY = "\n--- Page %d (No text extracted or error) ---\n"
# ---------------------------------------------------------------------------


def page_block(number: Column, text: Column) -> Column:
    filled = F.concat(F.format_string(HEADING, number), text)
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, filled).otherwise(F.format_string(HEADING_EMPTY, number))


def page_blocks(pages: DataFrame, doc: str, page: str, *ties: str, text: str = "text", span: int = 1000) -> DataFrame:
    """(doc, n, block): every page under its heading, numbered 1..n in the order of page numbers, null numbers last.

    The same shape at any size. ``span`` page numbers of a document are numbered together, so that one that holds a large
    share of all pages is still many tasks: counts per span are small, and their running sum gives each span its first
    number. It does not show in the result. Pages without a document id are those of one document without id.
    """
    part = F.coalesce(F.floor(F.col(page) / span), F.lit((1 << 63) - 1))
    cut = pages.select(
        F.col(doc).alias("_doc"), part.alias("_part"), F.col(page).alias("_page"), *[F.col(t).alias(f"_{t}_tie") for t in ties],
        F.col(text).alias("_text"),
    )
    sizes = cut.groupBy("_doc", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_doc").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(
        F.col("_doc").alias("_d"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    order = Window.partitionBy("_doc", "_part").orderBy("_page", *[f"_{t}_tie" for t in ties], "_text")
    own = cut.withColumn("_own", F.row_number().over(order))
    met = own.join(first, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_part") == F.col("_p")))
    number = F.col("_before") + F.col("_own")
    return met.select(F.col("_doc").alias(doc), number.alias("n"), page_block(number, F.col("_text")).alias("block"))


def assemble_pages(blocks: DataFrame, doc: str) -> DataFrame:
    """(doc, text): the blocks of a document in order. A document's whole text is one value, so it bounds the group."""
    gathered = blocks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("n", "block"))).alias("_blocks"))
    return gathered.select(doc, F.array_join(F.transform("_blocks", lambda x: x["block"]), "").alias("text"))


def assemble_segments(blocks: DataFrame, doc: str, pages_per_segment: int) -> DataFrame:
    """(doc, segment, text): the blocks of a document, so many pages at a time."""
    segment = F.floor((F.col("n") - 1) / pages_per_segment).cast("int")
    gathered = blocks.groupBy(doc, segment.alias("segment")).agg(F.array_sort(F.collect_list(F.struct("n", "block"))).alias("_blocks"))
    return gathered.select(doc, "segment", F.array_join(F.transform("_blocks", lambda x: x["block"]), "").alias("text"))
