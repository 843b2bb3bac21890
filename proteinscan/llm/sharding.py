"""Contiguous shards of nearly equal bytes, cut from global prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proteinscan.llm.common import written


def shard(docs: DataFrame, shards: int = 24, row_bytes: int = 8, keep_together: int = 20) -> DataFrame:
    """`doc_id, size, text_crc32, shard, slot` for every row.

    Size is the text's UTF-8 bytes (null: none) plus `row_bytes`. Rows are ordered by the MD5 of
    their text, then doc_id (null first), so equal texts are neighbours; per-partition totals give
    each row its global offset in bytes, and the shard is the share of its middle in `shards` equal
    targets. A group of equal texts that lies across a cut goes to the earlier shard if it holds at
    most one part in `keep_together` of a shard's target; larger groups are split, which keeps
    shards balanced. `slot` counts rows inside a shard from 0. Ids may be null or repeat; an empty
    table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(row_bytes)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("h"),
    )
    ordered = rows.repartitionByRange("h", "doc_id").withColumn("part", F.spark_partition_id())
    ordered = written(ordered, "ordered")  # the ranges must be the same in both passes below

    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = ordered.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("n"))  # a row per partition
    parts = parts.select(
        "part", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("part_bytes"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_rows"), F.sum("b").over(every).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.withColumn("bytes_inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).withColumn("rows_inside", F.count("*").over(inside))
    placed = placed.join(F.broadcast(parts), "part").withColumn("before", F.col("part_bytes") + F.col("bytes_inside"))
    cut = F.expr(f"((2 * before + size) * {shards}) div (2 * total)").cast("int")
    placed = placed.select("doc_id", "size", "text_crc32", "h", "total", cut.alias("cut"), (F.col("part_rows") + F.col("rows_inside")).alias("row"))
    placed = written(placed, "placed")
    # Each cut lies inside one group at most: fewer rows than shards.
    straddling = placed.groupBy("h").agg(F.min("cut").alias("first_cut"), F.max("cut").alias("last_cut"), F.sum("size").alias("b"), F.max("total").alias("total"))
    straddling = straddling.where((F.col("first_cut") < F.col("last_cut")) & (F.col("b") * F.lit(shards * keep_together) <= F.col("total"))).select("h", "first_cut")
    sharded = placed.join(F.broadcast(straddling), "h", "left").withColumn("shard", F.coalesce("first_cut", "cut"))
    starts = sharded.groupBy("shard").agg(F.min("row").alias("first_row"))  # a row per shard
    return sharded.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"))
