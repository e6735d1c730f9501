"""Contiguous shards of near equal size from global prefix sums of bytes; DataFrame functions only.

Documents are put in one global order: by the least doc_id among rows of equal text, then by doc_id, so that equal texts are
neighbours. The order is range-partitioned; a document's place is its partition's base (a prefix sum over the partitions'
totals) plus its place in the partition. A document belongs to the shard in which its middle byte falls, shard borders
being at equal shares of the total. Rows of equal text that together take at most a hundredth of a shard go by the
middle of the group, so that a border does not part them; larger groups are cut where the border is, as equal sizes ask.

Defined cases: null text counts as none (size 1, and a group of its own kind); rows without doc_id come first in
the order; rows that repeat are each placed. Other columns are not read. More shards than documents leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilspan.session import materialise

_WHOLE = 100


def shards(docs: DataFrame, count: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 within a shard) of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text, F.col("text").isNull()).alias("key"),
        F.xxhash64(F.lit(1), text).alias("key2"),
    )
    rows = materialise(rows, "sizes")
    same = ["key", "key2", "size"]
    groups = rows.groupBy(*same).agg(F.min("doc_id").alias("leader"), F.sum("size").alias("group_size"), F.count("*").alias("n"))
    # A text that occurs once is its own group: only others meet their group.
    shared = groups.where("n > 1").drop("n")
    rows = rows.join(shared, same, "left").select(
        "doc_id", "size", "text_crc32", F.coalesce("leader", "doc_id").alias("leader"), F.coalesce("group_size", "size").alias("group_size"), "key"
    )
    order = ["leader", "key", "doc_id", "size"]
    placed = rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    placed = materialise(placed, "order")

    parts = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    everything = Window.partitionBy()
    base = parts.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_base"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_base"),
        F.sum("bytes").over(everything).alias("total"),
    )
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select(
        "*",
        F.coalesce(F.sum("size").over(within), F.lit(0)).alias("byte_at"),
        F.row_number().over(Window.partitionBy("part").orderBy(*order)).alias("row_at"),
    )
    local = local.join(base, "part").withColumns(
        {"from": F.col("byte_base") + F.col("byte_at"), "row": F.col("row_base") + F.col("row_at") - 1}
    )
    local = materialise(local.select("doc_id", "size", "text_crc32", "leader", "key", "group_size", "from", "row", "total"), "places")
    small = F.expr(f"group_size * {_WHOLE} * {count} <= total and group_size > size")
    starts = local.where(small).groupBy("leader", "key").agg(F.min("from").alias("group_from"))
    local = local.join(starts, ["leader", "key"], "left")
    middle = F.when(F.col("group_from").isNotNull(), 2 * F.col("group_from") + F.col("group_size")).otherwise(2 * F.col("from") + F.col("size"))
    # 64-bit whole numbers would overflow at a corpus of some exabytes / count: decimals do not.
    shard = F.floor(middle.cast("decimal(38,0)") * count / (2 * F.col("total")).cast("decimal(38,0)")).cast("int")
    local = local.withColumn("shard", F.least(shard, F.lit(count - 1)))
    first = local.groupBy("shard").agg(F.min("row").alias("first"))
    return local.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))
