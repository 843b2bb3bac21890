"""A training corpus from `documents`: language, toxicity, near copies, mixing, packing.

Stages take (spark, docs, sf_dir) and return a DataFrame. All but the last return the columns of
`documents`, with the values they had, whatever further columns there are and whatever their names;
each is written as Parquet and read again as the next one's input. Rows are judged one by one, so
repeated rows, rows that share a doc_id and rows without one are treated like others. An empty
table gives no rows in every stage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proteinscan.llm import langid, mixing, neardup, packing, quality, toxicity
from proteinscan.llm.common import table, where_text, written

#: Similarity, in percent, from which documents count as near copies here.
NEAR_COPY_PERCENT = 80


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told: null and empty texts and those without a letter go.

    Without a labelled language nothing can be told, and all rows go.
    """
    model = langid.fit(docs)
    return where_text(docs, lambda texts: np.array([x != langid.UNDETERMINED for x in model.predict(texts)[0]], bool))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model does not mark; a null text counts as empty, without labels all stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return where_text(docs, lambda texts: model.scores(texts) < 0.5, toxicity.ROWS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies; rows without words are no copies and stay.

    Rows are numbered, and near copies are found among the numbers, so that of rows with the same
    text one stays even if they share a doc_id or have none. The smallest number of a group stays.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = written(docs.select(F.monotonically_increasing_id().alias("number"), row.alias("row")), "numbered")
    found = neardup.near_duplicates(rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")), NEAR_COPY_PERCENT)
    return rows.join(found.where("kept").select(F.col("doc_id").alias("number")), "number").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of their source's weight takes them; a null source is a source.

    Inside a source documents are weighted by their quality under the discriminant.
    """
    return mixing.repeat_rows(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens, each row as often as it occurs."""
    return packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The models of the first stages are no SQL. Tests hold the language, toxicity and near-copy stages against plain
#: rules on a table of odd rows, and the totals of mixing and packing; the operators have brute-force versions of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
