"""Ranks of rows under composite whole-number keys, by a distributed least-significant-digit radix sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proteinscan.llm.common import written

#: Bits of a digit: a pass counts 2**DIGIT_BITS values. Rows of a block are 2**BLOCK_BITS neighbours in the order so far.
DIGIT_BITS, BLOCK_BITS = 11, 18

_SIGN = -(2**63)


def descending(key: Column) -> Column:
    """A key that orders rows from large to small."""
    return F.bitwise_not(key)


def digits_between(least: int, largest: int, digit_bits: int = DIGIT_BITS) -> list[int]:
    """Shifts of the digits in which 64-bit numbers between the two can differ, least significant first.

    All numbers between two share the leading bits that the two share, so no pass is made for those.
    """
    return list(range(0, ((least ^ largest) & (2**64 - 1)).bit_length(), digit_bits))


def _pass(rows: DataFrame, key: str, shift: int, digit_bits: int, block_bits: int) -> DataFrame:
    """One stable counting sort: `position` becomes that of the order by digit, then old position.

    Blocks count their digits; global prefix sums over (digit, block) give the destination of each
    block's first row of a digit, and rows are numbered inside their block and digit alone, so no
    task gets more than a block, whatever the digits are.
    """
    digit = F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(_SIGN)), shift).bitwiseAND(F.lit(2**digit_bits - 1))
    dealt = rows.withColumn("_digit", digit.cast("int")).withColumn("_block", F.shiftright("position", block_bits))
    counts = dealt.groupBy("_digit", "_block").agg(F.count("*").alias("_n"))
    smaller = Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("_digit").agg(F.sum("_n").alias("_all"))  # at most 2**digit_bits rows
    totals = totals.select("_digit", F.coalesce(F.sum("_all").over(smaller), F.lit(0)).alias("_first"))
    earlier = Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(F.broadcast(totals), "_digit")
    starts = starts.select("_digit", "_block", (F.col("_first") + F.col("_before")).alias("_start"))
    inside = Window.partitionBy("_digit", "_block").orderBy("position")
    placed = dealt.withColumn("_inside", F.row_number().over(inside) - 1).join(starts, ["_digit", "_block"])
    return placed.select(*(c for c in rows.columns if c != "position"), (F.col("_start") + F.col("_inside")).alias("position"))


def ranked(rows: DataFrame, keys: list[str], digit_bits: int = DIGIT_BITS, block_bits: int = BLOCK_BITS) -> DataFrame:
    """`rows` with `position`, from 0, in the order of the columns `keys` (longs without nulls, first one first).

    Keys are sorted digit by digit from the last one's lowest; each pass is a written table. Rows
    of equal keys stay in the order in which they were read. No rows give none.
    """
    now = written(rows.withColumn("position", F.monotonically_increasing_id()), "radix")
    ends = now.agg(*(f(k).alias(f"{name}_{i}") for i, k in enumerate(keys) for name, f in (("least", F.min), ("largest", F.max)))).first()
    if ends["least_0"] is None:
        return now
    passes = [(k, shift) for i, k in reversed(list(enumerate(keys))) for shift in digits_between(ends[f"least_{i}"], ends[f"largest_{i}"], digit_bits)]
    # Without a digit to sort by, a pass over the lowest one still makes positions gapless.
    for key, shift in passes or [(keys[-1], 0)]:
        now = written(_pass(now, key, shift, digit_bits, block_bits), "radix")
    return now
