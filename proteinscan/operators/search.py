"""Every query against every sequence, and the deterministic best hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from proteinscan.functions import alignment, alphabet, matrices
from proteinscan.session import new_path

#: Positions times lanes that the kernel handles at once; larger arrays leave the processor's cache.
TILE = 48_000
#: Residues and queries that one pass over the database scores.
PASS_RESIDUES, PASS_QUERIES = 1_000_000, 4096
#: Rows that are sorted by length into tiles at once, and scores that a task holds for them.
SLICE_ROWS, SLICE_SCORES = 8192, 1 << 23
#: Residues of a query from which a narrower tile is worth its making.
NARROWED = 32
#: Cells that a task fills, about, and residues of a database block at most and, if there are many queries, at least.
TASK_CELLS = 20_000_000_000
BLOCK_RESIDUES, SMALL_BLOCK = 1 << 26, 1 << 15
#: Tables of hits or queries of more rows are not broadcast.
BROADCAST_ROWS = 200_000


class Passes:
    """A query set in portions, each a file in the shared folder that tasks read; the driver keeps their number."""

    def __init__(self, queries: DataFrame):
        spark = queries.sparkSession
        path = new_path(spark, "queries")
        portion = F.floor(F.col("before") / PASS_RESIDUES) + F.floor((F.col("query_no") - 1) / PASS_QUERIES)
        rows = queries.select("query_no", "residues", portion.alias("portion"))
        rows.write.partitionBy("portion").parquet(path)
        sizes = spark.read.schema("query_no long, residues binary, portion long").parquet(path).groupBy("portion").agg(F.sum(F.octet_length("residues")).alias("n"))
        if "://" not in path and not path.startswith("file:"):
            path = f"file://{path}"
        self.uri = path.replace("file:///", "file:/").replace("file:/", "file:///")
        found = {r["portion"]: r["n"] for r in sizes.collect()}  # a row per pass
        self.portions, self.residues = sorted(found), sum(found.values())

    def read(self, portion: int) -> list[tuple[int, np.ndarray]]:
        """Numbers and codes of a portion's queries, in a task."""
        files, base = fs.FileSystem.from_uri(f"{self.uri}/portion={portion}")
        parts = [x.path for x in files.get_file_info(fs.FileSelector(base)) if x.path.endswith(".parquet")]
        rows: list[tuple[int, bytes]] = []
        for part in parts:
            table = pq.read_table(part, filesystem=files, partitioning=None)
            rows += zip(table["query_no"].to_pylist(), map(bytes, table["residues"].to_pylist()), strict=True)
        return [(n, alphabet.decoded(r)) for n, r in sorted(rows)]


def _tiles(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of rows, in order of length, that fit a tile."""
    order = np.argsort(lengths, kind="stable")
    width = np.maximum(lengths[order], 1)
    at = 0
    while at < len(order):
        fits = np.arange(1, len(order) - at + 1) * width[at:] <= TILE
        size = max(1, len(fits) if fits.all() else int(fits.argmin()))
        yield order[at : at + size]
        at += size


class BestRows:
    """The best rows of one query among those that a task has seen, in a fixed order of ties.

    Rows that score less than `least` are not among them.
    """

    def __init__(self, query_no: int, top: int):
        self.query_no, self.top, self.least, self.parts, self.held = query_no, top, -1, [], 0

    def offer(self, scores: np.ndarray, lengths: np.ndarray, places: pa.Array) -> None:
        if len(scores) > self.top:
            self.least = max(self.least, int(np.partition(scores, len(scores) - self.top)[len(scores) - self.top]))
        chosen = np.flatnonzero(scores >= self.least)
        if len(chosen):
            self.parts.append(pa.table({"score": scores[chosen], "length": lengths[chosen], "place": places.take(pa.array(chosen))}))
            self.held += len(chosen)
        if self.held > 16 * self.top + 256:
            self.settle()

    def settle(self) -> pa.Table:
        rows = pa.concat_tables(self.parts).combine_chunks()
        keys = {"score": rows["score"], "length": rows["length"]}
        place = rows["place"].combine_chunks()
        place = place if isinstance(place, pa.Array) else place.chunk(0)
        keys |= {f"p{k}": x for k, x in enumerate(place.flatten())} if pa.types.is_struct(place.type) else {"p": place}
        order = pc.sort_indices(pa.table(keys), sort_keys=[(k, "descending") for k in keys])
        rows = rows.take(order[: self.top])
        if len(rows) == self.top:
            self.least = max(self.least, rows["score"][-1].as_py())
        self.parts, self.held = [rows], len(rows)
        return rows


def _batch(query_no: int, scores, lengths, places) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(scores), query_no, np.int64)), places, pa.array(lengths, pa.int32()), pa.array(scores, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["query_no", "input_pos", "length", "score"])


def _filled(queries: list[np.ndarray], codes: list[np.ndarray], table: np.ndarray, gaps: tuple[int, int], best: list[BestRows], done) -> np.ndarray:
    """Scores of all queries (rows) against the targets (columns).

    With `best`, targets that cannot be among a query's best rows are skipped for it and score -1: whole
    tiles, and for longer queries the lanes of a tile if at most half of them are left. `done` gets the cells that were filled and skipped.
    """
    lengths = np.fromiter(map(len, codes), np.int64, len(codes))
    out = np.zeros((len(queries), len(codes)), np.int32)
    bounds = None
    if best and len(codes):
        counts = np.stack([np.bincount(c, minlength=len(table)) for c in codes])
        bounds = alignment.score_bounds(queries, counts, table)
    seen = [np.empty(0, np.int32)] * len(queries)

    def wanted(q: int, rows: np.ndarray) -> np.ndarray:
        """Which of the rows may be among the best of a query."""
        if bounds is None:
            return np.ones(len(rows), bool)
        least = best[q].least
        if len(seen[q]) >= best[q].top:
            least = max(least, int(np.partition(seen[q], len(seen[q]) - best[q].top)[len(seen[q]) - best[q].top]))
        return bounds[q, rows] >= least

    long = np.flatnonzero(lengths > TILE)
    for i in long:
        out[:, i] = alignment.score_long(queries, codes[i], table, *gaps, TILE)
    others = np.flatnonzero(lengths <= TILE)
    cells, left = sum(map(len, queries)) * int(lengths[long].sum()), 0
    for part in reversed(list(_tiles(lengths[others]))):  # the longest first: they score most
        rows = others[part]
        tile = alignment.Tile(alignment.lanes_of([codes[i] for i in rows]), table)
        for q, query in enumerate(queries):
            chosen = wanted(q, rows)
            mine, fit = rows, tile
            if not chosen.any():
                mine, fit = rows[:0], None
            elif len(query) >= NARROWED and 2 * chosen.sum() <= len(rows):
                mine = rows[chosen]
                fit = alignment.Tile(alignment.lanes_of([codes[i] for i in mine]), table)
            out[q, rows] = -1
            if fit is not None:
                out[q, mine] = alignment.score_tile(query, fit, *gaps)
            filled = len(query) * int(lengths[mine].sum())
            cells += filled
            left += len(query) * int(lengths[rows].sum()) - filled
            if bounds is not None:
                seen[q] = np.concatenate([seen[q], out[q, mine]])
                if len(seen[q]) > 4 * best[q].top + 64:
                    seen[q] = np.partition(seen[q], len(seen[q]) - best[q].top)[-best[q].top :]
    done(cells, left)
    return out


def _scored(rows: DataFrame, passes: Passes, matrix: str, gaps: tuple[int, int], top: int | None, work) -> DataFrame:
    """Scores of blocks of rows, each against the portions of its group; a partition is one block and group."""
    table = matrices.load(matrix)
    key = rows.schema["input_pos"].dataType.simpleString()

    def done(cells: int, skipped: int) -> None:
        if work is not None:
            work[0].add(cells)
            work[1].add(skipped)

    def run(batches):
        held = [b for b in batches if b.num_rows]  # a block, of bounded residues
        for portion in sorted({p for b in held[:1] for p in b.column("portions")[0].as_py()}):
            queries = passes.read(portion)
            best = [BestRows(no, top) for no, _ in queries] if top else []
            codes_of = [q for _, q in queries]
            size = max(64, min(SLICE_ROWS, SLICE_SCORES // max(1, len(queries))))
            for part in (b.slice(at, size) for b in held for at in range(0, b.num_rows, size)):
                codes = [alphabet.decoded(r) for r in part.column("residues").to_pylist()]
                lengths = np.fromiter(map(len, codes), np.int32, len(codes))
                scores = _filled(codes_of, codes, table, gaps, best, done)
                for q, (no, _) in enumerate(queries):
                    if top is None:
                        yield _batch(no, scores[q], lengths, part.column("input_pos"))
                    elif top:
                        kept = np.flatnonzero(scores[q] >= 0)
                        best[q].offer(scores[q][kept], lengths[kept], part.column("input_pos").take(pa.array(kept)))
            for rows in best:
                if rows.parts:
                    kept = rows.settle()
                    yield _batch(rows.query_no, *(kept[c].combine_chunks() for c in ("score", "length", "place")))

    return rows.mapInArrow(run, f"query_no long, input_pos {key}, length int, score int")


def grid(db_residues: int, query_residues: int, portions: int, cores: int) -> tuple[int, int]:
    """Blocks of the database and groups of query portions, so that a block and a group make about TASK_CELLS cells.

    The database is cut first, as its rows then move once; queries are dealt over groups, for each
    of which the rows are repeated, only where blocks would become too small.
    """
    tasks = max(4 * cores, -(-db_residues * query_residues // TASK_CELLS))
    blocks = max(-(-db_residues // BLOCK_RESIDUES), min(tasks, -(-db_residues // SMALL_BLOCK)), 1)
    return blocks, max(1, min(portions, -(-tasks // blocks)))


class Run:
    """What a search itself observes while it runs; read it after the first action on the result.

    `query_residues` is known beforehand; the database's sequences and residues are counted by the
    rows that the search reads (`DataFrame.observe`), so no second scan is needed.
    """

    def __init__(self) -> None:
        self.query_residues = 0
        self._seen: Observation | None = None

    def watch(self, rows: DataFrame, query_residues: int) -> DataFrame:
        self.query_residues, self._seen = query_residues, Observation()
        return rows.observe(self._seen, F.count("*").alias("sequences"), F.coalesce(F.sum(F.octet_length("residues")), F.lit(0)).alias("database_residues"))

    def metrics(self) -> dict[str, int]:
        """`sequences, database_residues, query_residues, cells`; zeros if nothing was searched."""
        seen = self._seen.get if self._seen else {"sequences": 0, "database_residues": 0}
        return {**seen, "query_residues": self.query_residues, "cells": seen["database_residues"] * self.query_residues}


def scores(
    db: DataFrame, queries: DataFrame, matrix: str = matrices.DEFAULT, gap_open: int = 10, gap_extend: int = 2, top: int | None = None, work=None, run: Run | None = None
) -> DataFrame:
    """`query_no, input_pos, length, score` of all pairs; with `top`, each task's best ones of each query.

    One plan of (block, group of portions) keys: the database is read once, its rows are dealt over
    blocks by hash, and a task reads the queries of its group, a portion at a time, from the shared
    folder. With `top`, targets that cannot be among the best are skipped by an upper bound of
    their scores. `work`, a pair of accumulators, gets the cells that were filled and skipped;
    `run` observes what is read. Headers are not read.
    """
    alignment.check_gaps(gap_open, gap_extend)
    rows = db.select("input_pos", "residues")
    passes = Passes(queries)
    if not passes.portions:
        rows, passes.portions = rows.where("false"), [0]
    size = rows.agg(F.coalesce(F.sum(F.octet_length("residues")), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    blocks, groups = grid(size["n"], passes.residues, len(passes.portions), db.sparkSession.sparkContext.defaultParallelism)
    blocks = max(1, min(blocks, size["rows"]))
    if run is not None and size["rows"] and top != 0:
        rows = run.watch(rows, passes.residues)
    own = F.array(*(F.array(*(F.lit(p).cast("long") for p in passes.portions[g::groups])) for g in range(groups)))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("input_pos"), F.lit(blocks)).cast("int"))
    dealt = dealt.select("*", F.posexplode(own).alias("group", "portions"))
    dealt = dealt.repartitionById(blocks * groups, (F.col("block") * groups + F.col("group")).cast("int"))
    return _scored(dealt, passes, matrix, (gap_open, gap_extend), top, work)


def best(scored: DataFrame, top: int = 10) -> DataFrame:
    """The `top` rows of each query with their `rank`.

    Equal scores are ordered by length, longest first, then by input position, last first. Spark
    keeps `top` rows of each partition before it brings a query's rows together.
    """
    if top < 0:
        raise ValueError(f"top is {top}; it must not be negative")
    order = Window.partitionBy("query_no").orderBy(F.desc("score"), F.desc("length"), F.desc("input_pos"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(db: DataFrame, queries: DataFrame, matrix: str = matrices.DEFAULT, gap_open: int = 10, gap_extend: int = 2, top: int = 10, run: Run | None = None) -> DataFrame:
    """Best hits of each query with headers, by query and rank. No sequences or queries: no rows.

    `run` observes the search and has its metrics after an action.

    Headers are joined to the hits alone, after ranking. Hits, `top` rows of each query at most, are
    broadcast while they are few, so that headers stay where they are.
    """
    hits = best(scores(db, queries, matrix, gap_open, gap_extend, top, run=run), top)
    few = queries.count()
    hits = F.broadcast(hits) if few * max(1, top) <= BROADCAST_ROWS else hits
    named = db.select("input_pos", F.col("header").alias("target_header")).join(hits, "input_pos")
    about = queries.select("query_no", F.col("header").alias("query_header"), F.col("length").alias("query_length"))
    named = named.join(F.broadcast(about) if few <= BROADCAST_ROWS else about, "query_no")
    columns = ("query_no", "query_header", "query_length", "rank", "score", F.col("input_pos").alias("target_id"), "target_header", F.col("length").alias("target_length"))
    return named.select(*columns).orderBy("query_no", "rank")
