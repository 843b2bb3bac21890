"""A stream of FASTA query files against a database, beyond what the batch search offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from proteinscan.operators.search import search
from proteinscan.sources import database
from proteinscan.sources.fasta import parse


def stream_search(spark: SparkSession, folder: str, db: DataFrame, output: str, checkpoint: str, **parameters) -> StreamingQuery:
    """Append each arriving file's hits to Parquet at `output`, with the number of its batch.

    A batch that is run again after a failure replaces its own rows.
    """
    rows = parse(spark.readStream, folder)

    def one(batch: DataFrame, number: int) -> None:
        search(db, database.numbered_queries(batch), **parameters).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
