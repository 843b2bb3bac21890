"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proteinscan.llm.common import checked_broadcast, written
from proteinscan.llm.quality import Discriminant, score_quality

#: Word separators of the size rule.
WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 256
#: Weight of the poorest documents; the best ones weigh 1.
LEAST_WEIGHT = 0.05


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column) -> Column:
    """A number in (0, 1) that depends on the id only, so that reruns agree; without an id, on the text."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**48)


def source_targets(sized: DataFrame, max_repeats: float = 3.0) -> DataFrame:
    """Per source its size, id and target.

    Sources by code point, null last, weigh 1, 2, 3, 1, ...; targets share all words by weight and
    stop at `max_repeats` times the source, the excess going to the others by weight. That fixed
    point is min(cap, level * weight) with one level, found from sums over the sources in the order
    in which they reach their caps. The table has one row per source.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", (F.col("sid") % 3 + 1).cast("double")).withColumn("cap", F.col("source_size") * F.lit(max_repeats))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped_before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_from = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", (F.sum("source_size").over(everything) - capped_before) / weight_from)
    s = s.withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("weight")))
    return s.select("source", "sid", "source_size", "target")


def _sized(docs: DataFrame, model: Discriminant | None, carried: Column | None) -> DataFrame:
    """`doc_id, source, size, key` and the column `row` that `carried` makes; keys are exponential, divided by the weight."""
    rows = docs.select("doc_id", "source", "text", *([] if carried is None else [carried.alias("row")]))
    if model is None:
        rows = rows.withColumn("score", F.lit(1.0))
    else:
        rows = score_quality(rows, model)
    weight = F.greatest(F.lit(LEAST_WEIGHT), F.round("score", 4))
    key = -F.ln(uniform(F.col("doc_id"), F.col("text"))) / weight
    return rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), *([] if carried is None else ["row"]))


def _taken(sized: DataFrame, max_repeats: float) -> DataFrame:
    """`sized` with `source_size, target, taken`: whole epochs, then documents in the order of their keys."""
    targets = source_targets(sized, max_repeats)
    n_docs = sized.groupBy("source").agg(F.count("*").alias("n_docs"))
    targets = written(targets.join(n_docs, targets["source"].eqNullSafe(n_docs["source"])).drop(n_docs["source"]), "targets")
    known = checked_broadcast(targets.withColumnRenamed("source", "_source"))
    keyed = sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    # Prefix sums in key order without one task per source: buckets of the key's range in (0, 1),
    # sums per bucket, and an order inside each bucket only.
    buckets = F.ceil(F.col("n_docs") / BUCKET_ROWS)
    keyed = keyed.withColumn("bucket", F.floor(F.col("key") / (F.lit(1.0) + F.col("key")) * buckets))
    sums = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["sid", "bucket"])

    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    rest = F.least(F.col("size"), F.greatest(F.lit(0), budget - F.col("bucket_start") - F.col("inside")))
    taken = F.when(epochs >= F.lit(max_repeats), epochs * F.col("size")).otherwise(epochs * F.col("size") + rest)
    return placed.withColumn("taken", taken.cast("long"))


def mix(docs: DataFrame, model: Discriminant | None = None, max_repeats: float = 3.0) -> DataFrame:
    """Words the mix takes of each row: `doc_id, source, size, source_size, target, taken`.

    A source is taken whole as often as its target holds it. The rest of the target goes to its
    documents in the order of their keys -ln(u) / weight, until the budget is spent; the document
    at the cut gives its first words only. The weight is the quality of the text under `model`,
    LEAST_WEIGHT at least; without a model all weigh alike. Null or empty texts have size 0 and are
    taken 0 times; a null source is a source; repeated rows count as often as they occur, ids may
    be null; an empty table gives no rows; other columns are ignored. Of equal keys the smaller
    doc_id comes first.
    """
    sized = written(_sized(docs, model, None), "sized")
    return _taken(sized, max_repeats).select("doc_id", "source", "size", "source_size", "target", "taken")


def repeat_rows(docs: DataFrame, model: Discriminant | None = None, max_repeats: float = 3.0) -> DataFrame:
    """The mixed corpus as rows: each row of `docs`, with all its columns, as often as the mix takes it.

    A row that its source's budget cuts is kept whole if at least half of it was taken. Each row
    counts by itself, so rows without an id, or that share one, are taken like others; rows of size
    0 are not. Ties and empty tables are as in `mix`.
    """
    sized = written(_sized(docs, model, F.struct(*(F.col(f"`{c}`") for c in docs.columns))), "sized")
    times = F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int")
    rows = _taken(sized, max_repeats).where("size > 0").withColumn("times", times).where("times > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
