"""Command line: `python -m proteinscan.plans.cli preprocess|search ...`."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from proteinscan.functions.matrices import DEFAULT, MATRICES
from proteinscan.plans import report
from proteinscan.session import ship_package
from proteinscan.sources import database
from proteinscan.sources.fasta import read_fasta


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="proteinscan")
    todo = out.add_subparsers(dest="command", required=True)
    pre = todo.add_parser("preprocess", help="turn a FASTA file into a database")
    pre.add_argument("-i", "--input", required=True)
    pre.add_argument("-o", "--output", required=True)
    find = todo.add_parser("search", help="search a database with the sequences of a FASTA file")
    find.add_argument("-q", "--query", required=True)
    find.add_argument("-d", "--db", required=True)
    find.add_argument("-s", "--sm", choices=MATRICES, default=DEFAULT)
    find.add_argument("-g", "--gap_open", type=int, default=10)
    find.add_argument("-e", "--gap_extend", type=int, default=2)
    find.add_argument("-r", "--top", type=int, default=10)
    pre.add_argument("--rejects", action="store_true", help="keep the symbols that are no letters, with their places")
    for command in (pre, find):
        command.add_argument("--strict", action="store_true", help="stop at symbols that are no letters")
    return out


def main(args: list[str] | None = None) -> int:
    given = parser().parse_args(args)
    spark = SparkSession.builder.appName("proteinscan").getOrCreate()
    ship_package(spark)
    if given.command == "preprocess":
        began = time.perf_counter()
        about = database.preprocess(read_fasta(spark, given.input, given.strict), given.output, given.rejects).first()
        print(f"{given.output}: {about['sequences']} sequences, {about['residues']} residues, longest {about['longest']}, {time.perf_counter() - began:.2f} s")
        return 0
    db = database.load(spark, given.db)
    queries = database.numbered_queries(read_fasta(spark, given.query, given.strict))
    hits, metrics = report.timed_search(db, queries, matrix=given.sm, gap_open=given.gap_open, gap_extend=given.gap_extend, top=given.top)
    for line in report.lines(queries, hits, database.info(spark, given.db).first().asDict(), metrics, given.db, given.query):
        print(line)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
