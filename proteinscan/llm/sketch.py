"""Threshold-scaled fingerprints: every shingle hash below a fixed fraction. DataFrame functions only.

Two sketches made with one fraction are comparable whatever their documents' lengths: the union of
sketches is the sketch of the union, and the shared share of a sketch estimates containment. A text
of few shingles may have no hash below the limit; its sketch is empty and tells of no likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = 5
#: Share of all hashes that a sketch keeps. A hash takes 16 characters of a fingerprint as text and
#: a shingle about 6 of its document, so a fingerprint is about a sixth of its text.
FRACTION = 1 / 16
#: Bytes of text that a range of doc_id holds, about, and the number of ranges at most.
RANGE_BYTES = 16 << 20
MAX_RANGES = 65_536


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """The first 16 hexadecimal digits of the MD5 of each run of `words` words; with fewer words, of all of them."""
    tokens = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - F.lit(words - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, F.lit(words)), " ").cast("binary")), 1, 16))

    return F.element_at(F.transform(F.array(tokens), lambda w: F.when(F.size(w) > 0, runs(w)).otherwise(F.array().cast("array<string>"))), 1)


def limit(fraction: float) -> str:
    """Hashes below this string are the `fraction` that sketches keep."""
    if not 0 < fraction < 1:
        raise ValueError(f"fraction is {fraction}; it must be between 0 and 1")
    return f"{int(fraction * 16**8):08x}"


def sketch_of(hashes: Column, fraction: float = FRACTION) -> Column:
    """Sorted distinct hashes below `fraction` of the range; none of a short text may be."""
    return F.array_sort(F.array_distinct(F.filter(hashes, lambda x: x < F.lit(limit(fraction)))))


def sketch(text: Column, fraction: float = FRACTION, words: int = WORDS) -> Column:
    return sketch_of(shingle_hashes(text, words), fraction)


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller sketch that the other one holds; 1 for two empty ones."""
    shared, least = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    return F.when(least > 0, shared / least).when(F.size(a) == F.size(b), F.lit(1.0)).otherwise(F.lit(0.0))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Containment of the sketches; two empty ones are alike if the texts are the same, one and a full one are not."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), same.cast("double")).otherwise(containment(a, b))


def merge(a: Column, b: Column) -> Column:
    """Sketch of both documents together."""
    return F.array_sort(F.array_union(a, b))


def as_text(hashes: Column) -> Column:
    return F.array_join(hashes, ",")


def _range_of(value: Column, bounds: list[int]) -> Column:
    """Number of `bounds` (ascending) that are at most `value`, by binary search."""
    steps = max(1, len(bounds)).bit_length()
    padded = F.lit([int(x) for x in bounds] + [2**63 - 1] * (2**steps - len(bounds)))
    found = F.aggregate(
        F.lit([2**k for k in reversed(range(steps))]), F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.element_at(padded, F.least(at + step, F.lit(2**steps)).cast("int")) <= value), at + step).otherwise(at),
    )
    return found


def with_next(docs: DataFrame) -> DataFrame:
    """Rows `doc_id, text` with `next_text`, the text of the next smaller doc_id (after the last: of the first).

    Ids are dealt into ranges, whose number follows the bytes of all texts up to MAX_RANGES and whose
    bounds are percentiles of rows, so ranges of long texts are larger; an id that many rows share,
    or that many lack, has several ranges, by a hash of the text. Rows that agree in id and text
    stay in one range. A range gets, as its last row, a copy of the
    first row of the range after it, so that one shuffle of the texts is enough. Rows without an id
    come last; rows that share one are ordered by that hash, then by text.
    """
    order_by = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    rows = docs.select(order_by.alias("id"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    ranges = min(MAX_RANGES, max(8, size // RANGE_BYTES))
    shares = [k / ranges for k in range(1, ranges)]
    bounds = sorted(rows.agg(F.percentile_approx("id", F.lit(shares), 10 * ranges).alias("p")).first()["p"] or [])
    # Ids that are a bound several times are that often too frequent for one range.
    upto = _range_of(F.col("id"), bounds)
    times = upto - F.when(F.col("id") > -(2**63), _range_of(F.col("id") - 1, bounds)).otherwise(F.lit(0))
    place = F.col("h") / F.lit(2.0**64) + F.lit(0.5)
    rows = rows.withColumn("range", F.lit(len(bounds)) - upto + F.least(F.floor(place * times).cast("int"), F.greatest(times - 1, F.lit(0))))
    rows = rows.withColumn("guest", F.lit(False))

    # A row per range, MAX_RANGES at most: what comes first in it goes to the range before it too.
    heads = rows.groupBy("range").agg(F.min(F.struct(F.bitwise_not("id").alias("k"), "h")).alias("head"))
    order = Window.orderBy("range")
    ring = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(F.bitwise_not("head.k").alias("id"), "head.h", F.coalesce(F.lag("range").over(order), F.last("range").over(ring)).alias("to"))
    guests = rows.select("id", "h", "text").join(F.broadcast(heads), ["id", "h"]).groupBy("id", "h", "to").agg(F.min("text").alias("text"))
    guests = guests.select("id", F.lit(None).cast("long").alias("doc_id"), "text", "h", F.col("to").alias("range"), F.lit(True).alias("guest"))

    within = Window.partitionBy("range").orderBy("guest", F.desc("id"), "h", "text")
    return rows.unionByName(guests).withColumn("next_text", F.lead("text").over(within))


def fingerprints(docs: DataFrame, fraction: float = FRACTION, words: int = WORDS) -> DataFrame:
    """Sketches of each text, of its edited text and of the next document, with their likeness.

    Returns `doc_id, n_chars, edited, sketch, edited_sketch, near_edited, near_next`. The edited
    text has its last third replaced by the start of the next document's. Likeness is read from the
    sketches; where both are empty, it is 1 for equal texts and 0 for others. Null texts count as
    empty; equal texts have equal sketches; repeated rows give a row each; an empty table none;
    other columns are ignored.
    """
    rows = with_next(docs)
    within = Window.partitionBy("range").orderBy("guest", F.desc("id"), "h", "text")
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("sketch", sketch(F.col("text"), fraction, words)).withColumn("next_sketch", F.lead("sketch").over(within))
    rows = rows.where(~F.col("guest"))
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = rows.select("doc_id", "text", "next_text", "sketch", "next_sketch", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), fraction, words))
    near_edited = likeness(F.col("sketch"), F.col("edited_sketch"), F.col("text") == F.col("edited"))
    near_next = likeness(F.col("sketch"), F.col("next_sketch"), F.col("text") == F.col("next_text"))
    return rows.select("doc_id", "n_chars", "edited", "sketch", "edited_sketch", near_edited.alias("near_edited"), near_next.alias("near_next"))
