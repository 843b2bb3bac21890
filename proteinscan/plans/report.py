"""Run metrics and the text report of a search."""

from __future__ import annotations

import datetime
import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proteinscan.operators.search import Run, search


def padded_length(length: Column) -> Column:
    """Query length rounded up to even, as in the padded cell count."""
    return length + length % 2


def cells(db: DataFrame, queries: DataFrame) -> DataFrame:
    """Residues of both sides and the cells of a full search; one row."""
    sides = queries.select(F.lit(True).alias("query"), "length").union(db.select(F.lit(False), "length"))

    def total(side: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(side, value)), F.lit(0))

    length, is_query = F.col("length"), F.col("query")
    out = sides.agg(
        total(is_query, length).alias("query_residues"), total(is_query, padded_length(length)).alias("padded_query_residues"),
        total(~is_query, length).alias("database_residues"),
    )
    return out.withColumn("cells", F.col("query_residues") * F.col("database_residues"))


def timed_search(db: DataFrame, queries: DataFrame, **parameters) -> tuple[DataFrame, dict]:
    """The hits, computed, and the run's metrics; billions of cells a second count the whole search.

    Sequences, residues and cells are what the search observed while it ran.
    """
    started = datetime.datetime.now().astimezone()
    began = time.perf_counter()
    run = Run()
    hits = search(db, queries, run=run, **parameters).cache()  # top rows of each query
    found = hits.count()
    seconds = time.perf_counter() - began
    seen = run.metrics()
    return hits, {"started": started, "seconds": seconds, "hits": found, **seen, "gcups": seen["cells"] / (seconds * 1e9), **parameters}


def banner(about: dict, metrics: dict, db_name: str, query_name: str) -> Iterator[str]:
    """What is searched, with which parameters, from a database's stored summary."""
    yield f"Database: {db_name}"
    yield f"  {about['sequences']} sequences, {about['residues']} residues, longest {about['longest']}"
    yield f"Queries: {query_name}"
    yield f"Matrix {metrics.get('matrix', 'blosum62')}, gap open {metrics.get('gap_open', 10)}, gap extend {metrics.get('gap_extend', 2)}"


def listed(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits by query and rank, with a row of nulls for each query that has none."""
    about = queries.select("query_no", F.col("header").alias("query_header"), F.col("length").alias("query_length"))
    return about.join(hits.drop("query_header", "query_length"), "query_no", "left").orderBy("query_no", "rank")


def lines(queries: DataFrame, hits: DataFrame, about: dict, metrics: dict, db_name: str = "", query_name: str = "") -> Iterator[str]:
    """The report: what was searched, each query with its hits in order, when it ran and how fast."""
    yield from banner(about, metrics, db_name, query_name)
    last = None
    for hit in listed(queries, hits).toLocalIterator():
        if hit["query_no"] != last:
            last = hit["query_no"]
            yield ""
            yield f"Query {last}: {hit['query_header']} ({hit['query_length']} residues)"
            yield "Score\tSequence"
        if hit["rank"] is not None:
            yield f"{hit['score']}\t{hit['target_header']}"
    yield ""
    yield f"Search started {metrics['started']:%Y-%m-%d %H:%M:%S}"
    yield f"{metrics['seconds']:.2f} s, {metrics['gcups']:.3f} GCUPS"
