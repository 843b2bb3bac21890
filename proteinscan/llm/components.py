"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proteinscan.llm.common import BROADCAST_ROWS, written

#: Beyond so many edges, nodes of so many edges are joined apart, so that no task gets all edges of one.
MANY_EDGES, HUB_EDGES = 1_000_000, 4096


def _joined(rows: DataFrame, key: str, least: DataFrame, many: bool) -> DataFrame:
    """`rows` with `m` of their `key`, from `least(key, m, n)`, n being the rows of the key.

    Hubs are fewer than the rows by a factor of HUB_EDGES. They are broadcast, if they are at most
    BROADCAST_ROWS, and their rows stay where they are.
    """
    if many:
        hubs = written(least.where(F.col("n") >= HUB_EDGES).select(key, "m"), "hubs")
        if hubs.count() <= BROADCAST_ROWS:
            hubs = F.broadcast(hubs)
            others = rows.join(hubs, key, "left_anti").join(least.where(F.col("n") < HUB_EDGES).select(key, "m"), key)
            return rows.join(hubs, key).unionByName(others)
    return rows.join(least.select(key, "m"), key)


def _large_star(edges: DataFrame, many: bool) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("m"), F.count("*").alias("n"))
    out = _joined(both.where(F.col("b") > F.col("a")), "a", least, many)
    return out.select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame, many: bool) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.col("b").alias("node"), F.col("a").alias("s"))
    least = down.groupBy("node").agg(F.min("s").alias("m"), F.count("*").alias("n"))
    linked = _joined(down, "node", least, many).select(F.col("m").alias("a"), F.col("s").alias("b"))
    return linked.union(least.select(F.col("m").alias("a"), F.col("node").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """`id, component` for every node of `edges(a, b)`; component is the smallest id reachable.

    Rounds are written tables; they end when the edges no longer change, which for n nodes takes
    about log n rounds. Loops and repeated edges are harmless; no edges give no rows.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state, many = None, now.count() > MANY_EDGES
    for _ in range(max_rounds):
        now = written(_small_star(_large_star(now, many), many), "edges")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == state:
            break
        state, many = seen, seen["n"] > MANY_EDGES
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")).union(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
