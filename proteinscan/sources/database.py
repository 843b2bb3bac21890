"""The preprocessed database: encoded sequences, dealt evenly over files, and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proteinscan.functions.alphabet import encoded, rejected
from proteinscan.operators.ranking import by_length
from proteinscan.session import written

#: Residues of a file, about.
FILE_RESIDUES = 1 << 25
#: Query sets of at most so many rows are numbered by one sort.
FEW_ROWS = 100_000


def with_residues(rows: DataFrame, rejects: bool = False) -> DataFrame:
    """`input_pos, header, length, residues` from `input_pos, header, seq`; a null sequence has none.

    With `rejects`, `rejected` lists the symbols that are no letters, found in the same pass.
    """
    out = rows.select("input_pos", "header", F.coalesce(F.length("seq"), F.lit(0)).alias("length"), encoded(F.col("seq")).alias("residues"), "seq")
    return out.withColumn("rejected", rejected(F.col("seq"))).drop("seq") if rejects else out.drop("seq")


def in_order(rows: DataFrame) -> DataFrame:
    """Sequences with their `position` in database order, by length, then input position, and the residues `before`.

    Only keys and lengths are sorted; other columns, if there are any, are joined to their places.
    """
    placed = by_length(rows)
    return placed if set(rows.columns) == {"input_pos", "length"} else rows.join(placed.drop("length"), "input_pos")


def _stored(encoded: DataFrame, placed: DataFrame, files: int, path: str) -> None:
    """Write sequences with their positions; their residues are shuffled once.

    The hash of the input position deals sequences over the files, so no file holds all long ones.
    Inside a file they are in database order.
    """
    dealt = encoded.repartition(files, "input_pos").join(placed.select("input_pos", "position").repartition(files, "input_pos"), "input_pos")
    dealt.select(*encoded.columns, "position").sortWithinPartitions("position").write.parquet(f"{path}/sequences")


def preprocess(rows: DataFrame, path: str, rejects: bool = False) -> DataFrame:
    """Write `input_pos, header, seq` as a database and return its summary, which is stored too.

    With `rejects`, the symbols that are no letters are kept beside each sequence (see `rejected_symbols`).
    """
    spark = rows.sparkSession
    encoded = with_residues(rows, rejects)
    placed = written(by_length(encoded), "placed")
    total = placed.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    _stored(encoded, placed, max(spark.sparkContext.defaultParallelism, -(-total // FILE_RESIDUES)), path)
    summary(load(spark, path)).coalesce(1).write.parquet(f"{path}/summary")
    return info(spark, path)


def append(old: str, rows: DataFrame, path: str) -> DataFrame:
    """Write a database at `path` of the one at `old` and new sequences, and return its summary.

    Two sorted runs are merged by counting: a length's new sequences follow its old ones, so an old
    position grows by the new sequences of smaller lengths, and a new one by the old sequences of
    its own and smaller lengths. The old sequences are neither sorted nor moved. New input positions
    go on after the largest old one, in their order; those of files stay as they are.
    """
    spark = rows.sparkSession
    known = load(spark, old)
    fresh = written(with_residues(rows, "rejected" in known.columns), "fresh")
    if not isinstance(known.schema["input_pos"].dataType, T.StructType):
        last = known.agg(F.coalesce(F.max("input_pos"), F.lit(0)).alias("n")).first()["n"]
        number = by_length(fresh.select("input_pos", F.lit(0).alias("length"))).select("input_pos", F.col("position").alias("number"))
        fresh = fresh.join(number, "input_pos").withColumn("input_pos", F.col("number") + F.lit(last)).select(*fresh.columns)
        fresh = written(fresh, "fresh")
    counts = known.groupBy("length").agg(F.count("*").alias("was"), F.lit(0).cast("long").alias("came"))
    counts = counts.unionByName(fresh.groupBy("length").agg(F.lit(0).cast("long").alias("was"), F.count("*").alias("came"))).groupBy("length").agg(F.sum("was").alias("was"), F.sum("came").alias("came"))
    smaller = Window.orderBy("length")
    shifts = counts.select("length", (F.sum("came").over(smaller) - F.col("came")).alias("by_new"), F.sum("was").over(smaller).alias("by_old"))
    shifts = written(shifts, "shifts")  # a row for each length
    shifted = known.join(F.broadcast(shifts), "length").withColumn("position", F.col("position") + F.col("by_new"))
    shifted.select(*known.columns).write.parquet(f"{path}/sequences")
    placed = by_length(fresh).join(F.broadcast(shifts), "length").withColumn("position", F.col("position") + F.col("by_old"))
    total = fresh.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    more = fresh.join(placed.select("input_pos", "position"), "input_pos").repartition(-(-total // FILE_RESIDUES) or 1).sortWithinPartitions("position")
    more.select(*known.columns).write.mode("append").parquet(f"{path}/sequences")
    both = info(spark, old).unionByName(summary(fresh))
    both = both.agg(*(f(c).alias(c) for c, f in (("sequences", F.sum), ("residues", F.sum), ("max_title_length", F.max), ("longest", F.max))))
    both.coalesce(1).write.parquet(f"{path}/summary")
    return info(spark, path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """`input_pos, header, length, residues, position` of a stored database."""
    return spark.read.parquet(f"{path}/sequences")


def rejected_symbols(spark: SparkSession, path: str) -> DataFrame:
    """`input_pos, header, offset, symbol` of what a database preprocessed with `rejects` holds as the dummy.

    One row a symbol, `offset` from 0 in the residues; a database without that column gives no rows.
    Residues are not read.
    """
    db = load(spark, path)
    found = F.col("rejected") if "rejected" in db.columns else rejected(F.lit(None).cast("string"))
    return db.select("input_pos", "header", F.explode(found).alias("x")).select("input_pos", "header", "x.offset", "x.symbol")


def info(spark: SparkSession, path: str) -> DataFrame:
    """The stored summary of a database; its sequences are not read."""
    return spark.read.parquet(f"{path}/summary")


def summary(db: DataFrame) -> DataFrame:
    """Sequences, residues, longest header and longest sequence; one row, zeros for an empty database."""
    return db.agg(
        F.count("*").alias("sequences"), F.coalesce(F.sum("length"), F.lit(0)).alias("residues"),
        F.coalesce(F.max(F.length("header")), F.lit(0)).alias("max_title_length"), F.coalesce(F.max("length"), F.lit(0)).alias("longest"),
    )


def numbered_queries(rows: DataFrame) -> DataFrame:
    """Queries `query_no, input_pos, header, length, residues, before`, numbered from 1 by length, then input position."""
    queries = written(with_residues(rows), "queries")
    if queries.count() <= FEW_ROWS:
        order = Window.orderBy("length", "input_pos")
        summed = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = F.broadcast(queries.select("input_pos", F.row_number().over(order).cast("long").alias("query_no"), summed.alias("before")))  # FEW_ROWS at most
    else:
        placed = by_length(queries).select("input_pos", F.col("position").alias("query_no"), "before")
    return queries.join(placed, "input_pos").select("query_no", "input_pos", "header", "length", "residues", "before")
