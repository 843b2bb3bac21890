"""What the operators share: written tables, hold-out rules and bounded training samples."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proteinscan.session import new_path, shared_dir, written

#: Tables of more rows are not broadcast; rows of a hot key are then dealt over so many tasks.
BROADCAST_ROWS = 200_000
SALTS = 16
#: Bits for each key of such a table in the bitmaps that tell which rows may have a partner, and bits of all bitmaps at most.
KEY_BITS, MOST_BITS = 16, 1 << 27

__all__ = [
    "bounded_sample", "checked_broadcast", "clean_labels", "held_out", "joined_by_hot_key", "new_path", "shared_dir", "slices", "table", "where_text", "with_text_columns", "written",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves `remainder`; false for a null id."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(crc % F.lit(modulus) == F.lit(remainder), F.lit(False))


def checked_broadcast(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`small` with a broadcast hint if it has at most `rows` rows, else as it is."""
    return F.broadcast(small) if small.count() <= rows else small


def joined_by_hot_key(rows: DataFrame, small: DataFrame, key: str, spread: Column, how: str = "inner") -> DataFrame:
    """Join rows, of which any share may have one `key`, with a table of one row per key.

    A table of at most BROADCAST_ROWS rows is broadcast, and the rows stay where they are. A larger
    one is repeated for each of SALTS salts, and rows get a salt from the hash of `spread`, so that
    the rows of a key are dealt over SALTS tasks. The copies are merged and never broadcast, as
    Spark takes them for no larger than the table. Of an inner join only rows that may have a
    partner are moved.
    """
    n = small.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), key, how)
    rows = _with_partners(rows, small, key, n) if how == "inner" else rows
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies.hint("merge"), [key, "_salt"], how).drop("_salt")


def _with_partners(rows: DataFrame, small: DataFrame, key: str, n: int) -> DataFrame:
    """All rows whose key is among the `n` ones of `small`, and a few others: those whose key's hash has a bit set.

    The bits, KEY_BITS for each key and MOST_BITS at most, are broadcast in bitmaps of 4 KB; with
    more keys than these are for, more of the others pass.
    """
    place = F.pmod(F.xxhash64(key), F.lit(min(MOST_BITS, KEY_BITS * n)))
    bucket, bit = F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place)
    maps = small.select(bucket, bit.alias("_bit")).repartition("_bucket").groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_bucket", bucket).join(F.broadcast(maps), "_bucket")
    return found.where(F.getbit(byte, bit % 8) == 1).drop("_bucket", "_bits")


def bounded_sample(labelled: DataFrame, label: str, per_class: int, buckets: int = 256) -> DataFrame:
    """At most `per_class` rows of each label, lowest hash of doc_id first; ids are distinct in a label.

    The hash is cut into `buckets` over about twice the bound. Buckets that fit together are kept
    whole where they lie; only the rows of the bucket that crosses the bound meet and are ranked.
    """
    scale = 1 << 30
    sizes = labelled.groupBy(label).agg(F.count("*").alias("_size"))
    rows = labelled.withColumn("_hash", F.pmod(F.xxhash64("doc_id"), F.lit(scale)))
    rows = joined_by_hot_key(rows, sizes, label, F.col("doc_id"))
    rows = rows.withColumn("_bucket", F.floor(F.col("_hash") * F.col("_size") * F.lit(buckets / (2.0 * per_class * scale))))
    rows = written(rows.where(F.col("_bucket") < buckets), "thinned")  # about twice the bound
    counts = rows.groupBy(label, "_bucket").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(label).orderBy("_bucket"))
    counts = counts.withColumn("_room", F.lit(per_class) - upto + F.col("_n")).where(F.col("_room") > 0)
    rows = rows.join(checked_broadcast(counts), [label, "_bucket"])
    whole = rows.where(F.col("_n") <= F.col("_room"))
    edge = rows.where(F.col("_n") > F.col("_room"))
    edge = edge.withColumn("_rank", F.row_number().over(Window.partitionBy(label).orderBy("_hash", "doc_id"))).where(F.col("_rank") <= F.col("_room"))
    return whole.select(*labelled.columns).union(edge.select(*labelled.columns))


def clean_labels(labels: DataFrame, label: str) -> DataFrame:
    """One label per doc_id: null labels and ids are left out, of several the largest counts."""
    return labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))


def slices(batches, rows: int = 256):
    """Arrow batches in slices of at most `rows`, so that memory follows a few texts only."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_ARROW = {"string": pa.string(), "double": pa.float64(), "int": pa.int32()}


def with_text_columns(docs: DataFrame, make: Callable[[list], tuple], fields: str, keep: list[str] | None = None, rows: int = 64) -> DataFrame:
    """`docs` (or its columns `keep`) with columns that `make` computes from a list of texts.

    Few texts are held at once, whatever the size of Arrow batches. Columns that have the name of a
    new one are replaced.
    """
    new = [f.split() for f in fields.split(", ")]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in {n for n, _ in new}]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(n, T.DoubleType() if k == "double" else T.IntegerType() if k == "int" else T.StringType()) for n, k in new])

    def run(batches):
        for batch in slices(batches, rows):
            made = make(batch.column("text").to_pylist())
            columns = [batch.column(c) for c in kept] + [pa.array(v, _ARROW[k]) for v, (_, k) in zip(made, new, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *(n for n, _ in new)])

    wanted = list(dict.fromkeys([*kept, "text"]))
    return docs.select(*(f"`{c}`" for c in wanted)).mapInArrow(run, schema)


def where_text(docs: DataFrame, keep: Callable[[list], np.ndarray], rows: int = 64) -> DataFrame:
    """The rows, with all their columns, whose texts `keep` marks; it gets a list of texts."""

    def run(batches):
        for batch in slices(batches, rows):
            yield batch.filter(pa.array(keep(batch.column("text").to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
