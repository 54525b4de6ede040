"""Contiguous shards of nearly equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, stored


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assign every row to one of `shards` contiguous ranges in the order of (id, text_crc32, size).

    Sizes are UTF-8 bytes of the text (null: none) plus 1. Rows are range-partitioned once and written; the
    totals of the partitions, one row for each, give every partition its offset; within a partition a running
    sum gives a row's place. A row goes to the shard in which its middle byte falls, so each cut lies within half a
    row of its target. Null ids come first. Repeated rows are neighbours. An empty table gives no rows.

    Returns id_col, size, text_crc32, law ('bytes'), shard, slot (from 0, gapless in a shard), grown_shard (null).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = stored(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("crc")), "sizes")
    width = shuffle_width(docs.sparkSession)
    placed = stored(narrow.repartitionByRange(width, "id", "crc", "size").select("*", F.spark_partition_id().alias("part")), "ranges")
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = stored(
        totals.select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(Window.partitionBy()).alias("total"),
        ),
        "offsets",
    )
    within = Window.partitionBy("part").orderBy("id", "crc", "size")
    start = F.col("bytes_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    cut = placed.join(F.broadcast(offsets), "part").select(  # as many rows as partitions
        "id", "size", "crc",
        (F.col("rows_before") + F.row_number().over(within)).alias("pos"),
        start.alias("start"), "total",
    )
    cut = stored(cut.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"int((2 * start + size) * {shards} div (2 * total))"))), "cut")
    firsts = cut.groupBy("shard").agg(F.min("pos").alias("first"))  # one row a shard
    return cut.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), (F.col("pos") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
