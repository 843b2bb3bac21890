"""The search engine's queries over the given tables, and their SQL.

The tables hold no proteins, so residues are the letters of names and texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proteinscan.functions import alphabet, alignment, matrices
from proteinscan.functions import sql as sql_functions
from proteinscan.operators import search as finder
from proteinscan.plans import report
from proteinscan.session import new_path
from proteinscan.sources import database, datasource
from proteinscan.sources.fasta import read_fasta, write_fasta

Query = Callable[[SparkSession, str], DataFrame]

#: Table, key and text column of what serves as sequences.
PARTS, NATIONS = ("part", "p_partkey", "p_name"), ("nation", "n_nationkey", "n_name")
#: The fixed number of nations.
NATION_KEYS = 25
DOCUMENTS, BENCHMARK = ("documents", "doc_id", "text"), ("benchmark", "item_id", "text")


def sequences(spark: SparkSession, sf_dir: str, source: tuple[str, str, str]) -> DataFrame:
    """`input_pos, header, seq` of a table: its key, its key as text, its letters."""
    table, key, text = source
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return rows.select(F.col(key).cast("long").alias("input_pos"), F.col(key).cast("string").alias("header"), alphabet.letters_of(F.col(text)).alias("seq"))


def _db(spark: SparkSession, sf_dir: str, source: tuple[str, str, str]) -> DataFrame:
    return database.with_residues(sequences(spark, sf_dir, source))


def _queries(spark: SparkSession, sf_dir: str, source: tuple[str, str, str]) -> DataFrame:
    return database.numbered_queries(sequences(spark, sf_dir, source))


def seq_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir, DOCUMENTS)
    return rows.select("input_pos", F.length("seq").alias("length"), F.md5(F.translate("seq", "JOU", "[[[")).alias("residues_md5"))


def residue_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(spark, sf_dir, PARTS).select("input_pos", F.array_join(alphabet.codes(F.col("seq")), ",").alias("codes"))


def db_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary that a preprocessed database stores."""
    path = new_path(spark, "database")
    return database.preprocess(sequences(spark, sf_dir, DOCUMENTS), path)


def db_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database.in_order(_db(spark, sf_dir, DOCUMENTS).select("input_pos", "length")).select("input_pos", "length", "position")


def db_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names preprocessed, then the benchmark passages added: the order of the whole database."""
    path = new_path(spark, "database")
    database.preprocess(sequences(spark, sf_dir, PARTS), f"{path}/old")
    database.append(f"{path}/old", sequences(spark, sf_dir, BENCHMARK), f"{path}/new")
    return database.load(spark, f"{path}/new").select("header", "length", "position", F.md5("residues").alias("residues_md5"))


def query_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(spark, sf_dir, BENCHMARK).select("query_no", "header", "length", report.padded_length(F.col("length")).alias("padded_length"))


def fasta_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as FASTA, read again, preprocessed and loaded: what a database holds of them."""
    path = new_path(spark, "fasta")
    write_fasta(sequences(spark, sf_dir, DOCUMENTS), f"{path}/text")
    database.preprocess(read_fasta(spark, f"{path}/text"), f"{path}/database")
    return database.load(spark, f"{path}/database").select("header", "length", F.md5("residues").alias("residues_md5"))


def search_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.cells(_db(spark, sf_dir, DOCUMENTS), _queries(spark, sf_dir, BENCHMARK))


def search_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search of part names for all nation names observed of itself: residues, cells and hits; one row."""
    _, seen = report.timed_search(_db(spark, sf_dir, PARTS), _queries(spark, sf_dir, NATIONS), top=10)
    columns = ("sequences", "database_residues", "query_residues", "cells", "hits")
    return spark.createDataFrame([tuple(seen[c] for c in columns)], ", ".join(f"{c} long" for c in columns))


def db_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts preprocessed as they are: the symbols that are no residues, with their places."""
    path = new_path(spark, "database")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = rows.select(F.col("doc_id").alias("input_pos"), F.col("doc_id").cast("string").alias("header"), alphabet.clean(F.col("text")).alias("seq"))
    database.preprocess(rows, path, rejects=True)
    return database.rejected_symbols(spark, path).select("input_pos", F.col("offset").alias("residue"), "symbol")


LENGTH_BIN, SCORE_BIN = 16, 10
PORTION_RESIDUES = 200_000


def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences and residues by length."""
    first = (F.floor(F.col("length") / LENGTH_BIN) * LENGTH_BIN).alias("from_length")
    return _db(spark, sf_dir, DOCUMENTS).groupBy(first).agg(F.count("*").alias("sequences"), F.sum("length").alias("residues"))


def db_portions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of neighbours in database order that have about equal residues in all."""
    dealt = database.in_order(_db(spark, sf_dir, DOCUMENTS).select("input_pos", "length")).withColumn("portion", F.floor(F.col("before") / PORTION_RESIDUES))
    return dealt.groupBy("portion").agg(F.count("*").alias("sequences"), F.sum("length").alias("residues"), F.min("position").alias("first_position"))


def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of each query by score."""
    scored = all_scores(queries=BENCHMARK)(spark, sf_dir)
    return scored.groupBy("query_no", (F.floor(F.col("score") / SCORE_BIN) * SCORE_BIN).alias("from_score")).agg(F.count("*").alias("pairs"))


def score_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of each residue of each target against each letter: the profile as an equi-join."""
    rows = sequences(spark, sf_dir, PARTS).select("input_pos", F.posexplode(F.filter(F.split("seq", ""), lambda c: c != "")).alias("position", "residue"))
    rows = rows.withColumn("b", F.when(F.instr(F.lit(alphabet.LETTERS), F.col("residue")) > 0, F.col("residue")).otherwise("["))
    scores = matrices.table(spark, (matrices.DEFAULT,))
    return rows.join(F.broadcast(scores), "b").select("input_pos", "position", F.col("a").alias("letter"), "score")  # 576 rows are broadcast


def query_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query position the summed scores against all letters, from the same join on the query side."""
    rows = _text_positions(spark, sf_dir)
    joined = rows.join(F.broadcast(matrices.table(spark, (matrices.DEFAULT,))), "a")
    return joined.groupBy("input_pos", "position").agg(F.sum("score").alias("total"), F.max("score").alias("largest"))


def _text_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequences(spark, sf_dir, BENCHMARK).select("input_pos", F.posexplode(F.filter(F.split("seq", ""), lambda c: c != "")).alias("position", "residue"))
    return rows.withColumn("a", F.when(F.instr(F.lit(alphabet.LETTERS), F.col("residue")) > 0, F.col("residue")).otherwise("["))


def residue_scores(matrix: str) -> Query:
    """Scores of the letters that occur in documents against all letters, under one matrix, with their number."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        letters = sequences(spark, sf_dir, DOCUMENTS).select(F.explode(F.split(F.translate("seq", "JOU", "[[["), "")).alias("a")).where("a <> ''")
        used = letters.groupBy("a").agg(F.count("*").alias("n"))
        return used.join(F.broadcast(matrices.table(spark, (matrix,))), "a").select("a", "b", "score", "n")  # 576 rows are broadcast

    return query


def all_scores(matrix: str = matrices.DEFAULT, gap_open: int = 10, gap_extend: int = 2, queries: tuple[str, str, str] = NATIONS) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return finder.scores(_db(spark, sf_dir, PARTS), _queries(spark, sf_dir, queries), matrix, gap_open, gap_extend)

    return query


def sw_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of part names against the nation names of their portion by the built-in expression.

    Each part meets the one nation whose key is its own key modulo the number of nations.
    """
    q = _queries(spark, sf_dir, NATIONS).select("query_no", F.col("input_pos").alias("nation"))
    q = q.join(sequences(spark, sf_dir, NATIONS).select(F.col("input_pos").alias("nation"), F.col("seq").alias("query")), "nation")
    parts = sequences(spark, sf_dir, PARTS).select("input_pos", F.length("seq").alias("length"), "seq", (F.col("input_pos") % NATION_KEYS).alias("nation"))
    return parts.join(q, "nation").select("query_no", "input_pos", "length", alignment.score_expr(F.col("query"), F.col("seq")).alias("score"))


def sw_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = finder.scores(_db(spark, sf_dir, PARTS), _queries(spark, sf_dir, BENCHMARK), top=10)
    return finder.best(scored, 10).select("query_no", "input_pos", "length", "score", "rank")


def sw_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of part names against the nation with their key modulo the number of nations, in SQL."""
    sql_functions.register(spark)
    return spark.sql(
        f"""SELECT n.query_no, p.input_pos, length(p.seq) AS length, sw_score(n.seq, p.seq) AS score
        FROM {{parts}} AS p JOIN {{nations}} AS n ON p.input_pos % {NATION_KEYS} = n.input_pos""",
        parts=sequences(spark, sf_dir, PARTS),
        nations=sequences(spark, sf_dir, NATIONS).join(_queries(spark, sf_dir, NATIONS).select("input_pos", "query_no"), "input_pos"),
    )


def sw_topk_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten of each passage by the table function, which stops reading a query's rows after them."""
    sql_functions.register(spark)
    scored = finder.scores(_db(spark, sf_dir, PARTS), _queries(spark, sf_dir, BENCHMARK), top=10)
    return spark.sql("SELECT * FROM best_hits(TABLE({scored}) PARTITION BY query_no ORDER BY (score DESC, length DESC, input_pos DESC), 10)", scored=scored)


def fasta_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written and read through the FASTA data source, in ranges much smaller than a file."""
    datasource.register(spark)
    path = new_path(spark, "fasta")
    sequences(spark, sf_dir, DOCUMENTS).select("header", "seq").write.format("fasta").mode("append").save(path)
    rows = spark.read.format("fasta").option("splitBytes", 1 << 18).load(path)
    return rows.select("header", "length", F.md5("seq").alias("seq_md5"))


def search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finder.search(_db(spark, sf_dir, PARTS), _queries(spark, sf_dir, NATIONS), top=10)


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every benchmark passage against every document, whole texts, best ten."""
    return finder.search(_db(spark, sf_dir, DOCUMENTS), _queries(spark, sf_dir, BENCHMARK), top=10)


def _sql_sequences(source: tuple[str, str, str]) -> str:
    table, key, text = source
    return f"SELECT CAST({key} AS BIGINT) AS input_pos, CAST({key} AS VARCHAR) AS header, upper(regexp_replace(coalesce({text}, ''), '[^A-Za-z]', '', 'g')) AS seq FROM {table}"


def _sql_numbered(source: tuple[str, str, str]) -> str:
    return f"SELECT *, length(seq) AS length, row_number() OVER (ORDER BY length(seq), input_pos) AS query_no FROM ({_sql_sequences(source)})"


_SQL_CODES = f"list_transform(list_filter(string_split(seq, ''), lambda c: c <> ''), lambda c: CASE WHEN instr('{alphabet.LETTERS}', c) > 0 THEN instr('{alphabet.LETTERS}', c) - 1 ELSE {alphabet.DUMMY} END)"


def sql_scores(queries: tuple[str, str, str], targets: tuple[str, str, str], matrix: str = matrices.DEFAULT, gap_open: int = 10, gap_extend: int = 2, where: str = "true") -> str:
    """Named queries `q`, `t` and `scored` (query_no, input_pos, length, score), by anti-diagonals.

    Lists run over the target; matrices are symmetric, so the sides may change roles.
    """
    cost, values = gap_open + gap_extend, ", ".join(map(str, matrices.literal(matrix)))
    e = f"greatest(now[k + 1].e - {gap_extend}, now[k + 1].h - {cost})"
    f = f"CASE WHEN k > 0 THEN greatest(now[k].f - {gap_extend}, now[k].h - {cost}) ELSE -{cost} END"
    pair = f"(CASE WHEN k > 0 THEN before[k] ELSE 0 END) + [{values}][tc[k + 1] * 24 + qc[d + 1 - k] + 1]"
    return f"""WITH RECURSIVE q AS (SELECT *, {_SQL_CODES} AS codes FROM ({_sql_numbered(queries)})),
t AS (SELECT *, length(seq) AS length, {_SQL_CODES} AS codes FROM ({_sql_sequences(targets)})),
pairs AS (SELECT q.query_no, t.input_pos, q.length AS m, t.length AS n, q.codes AS qc, t.codes AS tc FROM q, t WHERE {where}),
r AS (
  SELECT query_no, input_pos, m, n, qc, tc, 0 AS d, list_transform(range(n), lambda k: {{'h': 0, 'e': -{cost}, 'f': -{cost}}}) AS now, list_transform(range(n), lambda k: 0) AS before, 0 AS best
  FROM pairs WHERE m > 0 AND n > 0
  UNION ALL
  SELECT query_no, input_pos, m, n, qc, tc, d + 1, nw, list_transform(now, lambda x: x.h), greatest(best, list_max(list_transform(nw, lambda x: x.h)))
  FROM (SELECT *, list_transform(range(n), lambda k: {{'h': CASE WHEN d + 1 - k BETWEEN 1 AND m THEN greatest(0, {pair}, {e}, {f}) ELSE 0 END, 'e': {e}, 'f': {f}}}) AS nw FROM r WHERE d < m + n - 1)
),
scored AS (
  SELECT query_no, input_pos, n AS length, best AS score FROM r WHERE d = m + n - 1
  UNION ALL SELECT query_no, input_pos, n, 0 FROM pairs WHERE m = 0 OR n = 0
)
"""


_SQL_PLACED = f"""SELECT *, row_number() OVER o AS position, coalesce(sum(length) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM (SELECT input_pos, length(seq) AS length FROM ({_sql_sequences(DOCUMENTS)})) WINDOW o AS (ORDER BY length, input_pos)"""
#: Stored residues: the code of each letter plus one, as a byte.
_SQL_BYTES = "(SELECT string_agg(chr(k::INTEGER), '' ORDER BY k) FROM range(1, 25) AS x(k))"
_SQL_RESIDUES = f"md5(translate(regexp_replace(seq, '[^{alphabet.LETTERS}]', '[', 'g'), '{alphabet.LETTERS}[', {_SQL_BYTES}))"


def _sql_positions(source: tuple[str, str, str]) -> str:
    """Each residue of each sequence as the symbol under which a matrix lists it."""
    one = "substr(seq, unnest(range(length(seq))) + 1, 1)"
    each = f"SELECT input_pos, unnest(range(length(seq))) AS position, {one} AS c FROM ({_sql_sequences(source)})"
    return f"SELECT input_pos, position, CASE WHEN instr('{alphabet.LETTERS}', c) > 0 THEN c ELSE '[' END AS symbol FROM ({each})"


_SQL_RANK = "row_number() OVER (PARTITION BY query_no ORDER BY score DESC, length DESC, input_pos DESC)"


def _sql_matrix(matrix: str) -> str:
    rows = ", ".join(f"('{a}', '{b}', {s})" for _, a, b, s in matrices.as_rows(matrix))
    return f"(VALUES {rows}) AS x(a, b, score)"


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        search_documents, seq_clean, residue_encode, fasta_roundtrip, db_info, db_sorted, db_append, db_portions, length_histogram, query_order, search_cells,
        score_profile, query_profile, sw_expr, sw_function, score_histogram, sw_topk, sw_topk_function, search_report,
        search_metrics, db_rejected,
        fasta_source,
    )
}
QUERIES |= {f"residue_scores_{m}": residue_scores(m) for m in matrices.MATRICES}
QUERIES |= {"sw_scores": all_scores(queries=BENCHMARK), **{f"sw_scores_{m}": all_scores(m) for m in matrices.MATRICES}}
QUERIES |= {f"sw_gap_{o}_{e}": all_scores(gap_open=o, gap_extend=e) for o, e in ((0, 0), (3, 1), (127, 127))}

_DOCS = _sql_sequences(DOCUMENTS)
ORACLES: dict[str, str] = {
    "seq_clean": f"SELECT input_pos, length(seq) AS length, md5(translate(seq, 'JOU', '[[[')) AS residues_md5 FROM ({_DOCS})",
    "residue_encode": f"SELECT input_pos, array_to_string({_SQL_CODES}, ',') AS codes FROM ({_sql_sequences(PARTS)})",
    "db_info": f"""SELECT count(*) AS sequences, coalesce(sum(length(seq)), 0) AS residues, coalesce(max(length(header)), 0) AS max_title_length,
  coalesce(max(length(seq)), 0) AS longest FROM ({_DOCS})""",
    "db_sorted": f"SELECT input_pos, length(seq) AS length, row_number() OVER (ORDER BY length(seq), input_pos) AS position FROM ({_DOCS})",
    "query_order": f"SELECT query_no, header, length, length + length % 2 AS padded_length FROM ({_sql_numbered(BENCHMARK)})",
    "search_cells": f"""SELECT *, query_residues * database_residues AS cells
FROM (SELECT coalesce(sum(length), 0) AS query_residues, coalesce(sum(length + length % 2), 0) AS padded_query_residues FROM ({_sql_numbered(BENCHMARK)})),
  (SELECT coalesce(sum(length(seq)), 0) AS database_residues FROM ({_DOCS}))""",
    "fasta_roundtrip": f"SELECT header, length(seq) AS length, {_SQL_RESIDUES} AS residues_md5 FROM ({_DOCS})",
    "db_append": f"""SELECT header, length(seq) AS length, row_number() OVER (ORDER BY length(seq), part, input_pos) AS position, {_SQL_RESIDUES} AS residues_md5
FROM (SELECT 0 AS part, * FROM ({_sql_sequences(PARTS)}) UNION ALL SELECT 1, * FROM ({_sql_sequences(BENCHMARK)}))""",
    "length_histogram": f"SELECT length // {LENGTH_BIN} * {LENGTH_BIN} AS from_length, count(*) AS sequences, sum(length) AS residues FROM (SELECT length(seq) AS length FROM ({_DOCS})) GROUP BY 1",
    "db_portions": f"SELECT before // {PORTION_RESIDUES} AS portion, count(*) AS sequences, sum(length) AS residues, min(position) AS first_position FROM ({_SQL_PLACED}) GROUP BY 1",
    "score_profile": f"SELECT input_pos, position, a AS letter, score FROM ({_sql_positions(PARTS)}) JOIN {_sql_matrix(matrices.DEFAULT)} ON b = symbol",
    "query_profile": f"""SELECT input_pos, position, sum(score) AS total, max(score) AS largest
FROM ({_sql_positions(BENCHMARK)}) JOIN {_sql_matrix(matrices.DEFAULT)} ON a = symbol GROUP BY ALL""",
    "sw_expr": sql_scores(NATIONS, PARTS, where=f"t.input_pos % {NATION_KEYS} = q.input_pos") + "SELECT * FROM scored",
    "sw_scores": sql_scores(BENCHMARK, PARTS) + "SELECT * FROM scored",
    "score_histogram": sql_scores(BENCHMARK, PARTS) + f"SELECT query_no, score // {SCORE_BIN} * {SCORE_BIN} AS from_score, count(*) AS pairs FROM scored GROUP BY ALL",
    "sw_topk": sql_scores(BENCHMARK, PARTS) + f"SELECT * FROM (SELECT *, {_SQL_RANK} AS rank FROM scored) WHERE rank <= 10",
    "search_report": sql_scores(NATIONS, PARTS) + f"""SELECT query_no, q.header AS query_header, q.length AS query_length, rank, score,
  s.input_pos AS target_id, t.header AS target_header, s.length AS target_length
FROM (SELECT *, {_SQL_RANK} AS rank FROM scored) AS s JOIN q USING (query_no) JOIN t ON t.input_pos = s.input_pos WHERE rank <= 10""",
}
_SQL_SYMBOLS = r"""SELECT doc_id, regexp_replace(text, '[\x09-\x0D\x20]', '', 'g') AS seq FROM documents"""
ORACLES |= {
    "search_metrics": f"""SELECT *, query_residues * database_residues AS cells FROM (SELECT coalesce(sum(length), 0) AS query_residues FROM ({_sql_numbered(NATIONS)})),
  (SELECT count(*) AS sequences, coalesce(sum(length(seq)), 0) AS database_residues FROM ({_sql_sequences(PARTS)})),
  (SELECT (SELECT count(*) FROM nation) * least(10, count(*)) AS hits FROM part)""",
    "db_rejected": f"""SELECT input_pos, residue, symbol FROM (
  SELECT doc_id AS input_pos, i AS residue, translate(substr(seq, i + 1, 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS symbol
  FROM (SELECT *, unnest(range(length(seq))) AS i FROM ({_SQL_SYMBOLS}))) WHERE NOT regexp_matches(symbol, '^[A-Z]$')""",
}
ORACLES |= {"sw_function": ORACLES["sw_expr"], "sw_topk_function": ORACLES["sw_topk"], "fasta_source": f"SELECT header, length(seq) AS length, md5(seq) AS seq_md5 FROM ({_DOCS})"}
_SQL_LETTERS = f"SELECT unnest(string_split(translate(seq, 'JOU', '[[['), '')) AS a, count(*) AS n FROM ({_DOCS}) GROUP BY 1"
ORACLES |= {f"residue_scores_{m}": f"SELECT a, b, score, n FROM ({_SQL_LETTERS}) JOIN {_sql_matrix(m)} USING (a)" for m in matrices.MATRICES}
ORACLES |= {f"sw_scores_{m}": sql_scores(NATIONS, PARTS, m) + "SELECT * FROM scored" for m in matrices.MATRICES}
ORACLES |= {f"sw_gap_{o}_{e}": sql_scores(NATIONS, PARTS, gap_open=o, gap_extend=e) + "SELECT * FROM scored" for o, e in ((0, 0), (3, 1), (127, 127))}
