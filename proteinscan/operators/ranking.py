"""Global positions and prefix sums without one task for all rows: by sorted ranges, or by counting lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proteinscan.session import written


def with_prefix(rows: DataFrame, order: list[str], of: str) -> DataFrame:
    """Rows with `position` from 1 in the order of the columns `order`, and `before`, the sum of `of` before a row.

    Ranges of the order are sorted in parallel; the totals of the ranges, a row for each, are summed
    up and added. The rows are written once, as the ranges must be the same in both passes.
    """
    ranges = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("_range").agg(F.count("*").alias("_n"), F.sum(of).alias("_sum"))
    totals = totals.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order)
    summed = F.coalesce(F.sum(of).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranges.withColumn("position", F.row_number().over(inside)).withColumn("before", summed)
    placed = placed.join(F.broadcast(totals), "_range")  # a row per range
    return placed.select(*rows.columns, (F.col("_rows") + F.col("position")).alias("position"), (F.col("_before") + F.col("before")).alias("before"))


#: Rows of one length that one task numbers; more frequent lengths are numbered by sorted ranges.
CROWDED = 1 << 20


def by_length(keys: DataFrame) -> DataFrame:
    """Rows `input_pos, length` with `position` from 1 by length, then input position, and the residues `before` a row.

    A counting sort: lengths have few values, so the histogram's prefix sums, a row for each
    length, place every length, and only ranks inside a length remain. Residues do not move.
    """
    keys = written(keys.select("input_pos", "length"), "keys")
    earlier = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    starts = keys.groupBy("length").agg(F.count("*").alias("_n"))
    starts = starts.select(
        "length", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"), F.coalesce(F.sum(F.col("_n") * F.col("length")).over(earlier), F.lit(0)).alias("_before"),
    )
    starts = written(starts, "lengths")
    inside = Window.partitionBy("length").orderBy("input_pos")
    ranked = keys.join(starts.where(F.col("_n") <= CROWDED), "length").withColumn("_rank", F.row_number().over(inside))
    crowded = starts.where(F.col("_n") > CROWDED)
    if not crowded.isEmpty():
        crowded = crowded.withColumn("_others", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        rows = with_prefix(keys.join(F.broadcast(crowded.select("length")), "length", "left_semi"), ["length", "input_pos"], "length").drop("before")  # fewer lengths than rows by CROWDED
        rows = rows.join(F.broadcast(crowded), "length").withColumn("_rank", F.col("position") - F.col("_others"))
        ranked = ranked.unionByName(rows.select(*ranked.columns))
    before = F.col("_before") + (F.col("_rank") - 1) * F.col("length")
    return ranked.select("input_pos", "length", (F.col("_first") + F.col("_rank")).alias("position"), before.alias("before"))
