"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

Each tree of the forest is a sorted order of all signatures, by its own sequence of coordinates.
Rows that share the first `FIRST` coordinates are a region; it is a run of the order. Candidates
come from the orders in two rounds:

1. A row meets its neighbours before and after it, those with the longest common prefix over all
   trees, and the first document of its part of a region. Parts deepen, coordinate by coordinate,
   until they hold at most PART_ROWS rows, so the depth follows how crowded a region is.
2. Confirmed links make components. What a region still holds across components is compared as a
   whole, in pairs of blocks if it is crowded, on the full sets: no pair is lost to crowding.
   In a crowded region sets travel as their differences from the region's common shingles.

So two documents are found if they share a region in any tree, whatever else lies in it. Documents
with equal shingle sets are one class from the start.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proteinscan.llm.common import joined_by_hot_key, slices, written
from proteinscan.llm.components import components

WORDS = 5
HASHES = 256
TREES = 24
#: Coordinates (of 8 bits) that a region shares. Two documents of similarity 0.85 share no region
#: of 24 trees with probability (1 - 0.85**5)**24, under one in a million; at 0.8, 7 in 100,000.
FIRST = 5
#: Coordinates of a row's place in an order.
DEPTH = 12
#: Rows that share their first document.
PART_ROWS = 256
#: Rows of a region, or thousands of their shingles, that make a block; two blocks are compared at once.
BLOCK = 512
#: Rows of a region, or thousands of their shingles, from which its common shingles are taken.
CORE_ROWS = 64
#: Regions of more rows are dealt over SALTS tasks when they are joined with what belongs to them.
CROWDED, SALTS = 4096, 16
#: Rows of a run that a task holds at once.
HELD = 65_536

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words (A-Z lower-cased, ASCII spaces)."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, tokens), np.uint64, len(tokens))
    size = min(words, len(tokens))
    count = len(tokens) - size + 1
    runs = np.zeros(count, np.uint64)
    for k in range(size):
        runs = (runs ^ (runs >> np.uint64(29))) * _MIX + hashes[k : k + count]
    return np.unique(runs ^ (runs >> np.uint64(32)))


@functools.lru_cache(maxsize=4)
def _family(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, hashes, dtype=np.uint32)


@functools.lru_cache(maxsize=4)
def tree_orders(hashes: int, trees: int) -> np.ndarray:
    """Coordinate sequence of each tree; the first ones of different trees are disjoint."""
    rng = np.random.default_rng(21)
    out = np.empty((trees, DEPTH), np.int64)
    for t in range(trees):
        own = (np.arange(FIRST) + t * FIRST) % hashes
        out[t] = np.concatenate([own, rng.permutation(np.setdiff1d(np.arange(hashes), own))[: DEPTH - FIRST]])
    return out


def signatures(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """MinHash values, cut to 8 bits, of non-empty sets; one row each."""
    multiply, add = _family(hashes)
    out = np.empty((hashes, len(sets)), np.uint8)
    flat = np.concatenate(sets)
    flat = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    for k in range(hashes):
        x = flat * multiply[k] + add[k]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        least = np.minimum.reduceat(x, starts)
        least ^= least >> np.uint32(16)
        out[k] = (least * np.uint32(0x297A2D39) >> np.uint32(24)).astype(np.uint8)
    return out.T.copy()


def _describe(docs: DataFrame, words: int) -> DataFrame:
    """`doc_id, n_shingles, digest, signature`; digest is null for documents without words."""

    def describe(batches):
        for batch in slices(batches, 64):
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            full = [s for s in sets if len(s)]
            rows = iter(signatures(full)) if full else iter(())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "digest", "signature"],
            )

    return docs.select("doc_id", "text").mapInArrow(describe, "doc_id long, n_shingles long, digest binary, signature binary")


def _orders(classes: DataFrame) -> DataFrame:
    """`id, region, deep` of each class in each tree, in signature order.

    `region` is the tree's number and the first FIRST coordinates, `deep` the coordinates after
    them; both as whole numbers, so that their order is the order of the coordinates. Ranges of the
    order are dealt to tasks, so a region of any size is spread.
    """
    orders = tree_orders(HASHES, TREES)

    def packed(coordinates: np.ndarray) -> np.ndarray:
        out = np.zeros(len(coordinates), np.int64)
        for k in range(coordinates.shape[1]):
            out = (out << 8) | coordinates[:, k].astype(np.int64)
        return out

    def spread(batches):
        for batch in slices(batches, 1024):
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(batch.num_rows, HASHES)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            region = np.concatenate([packed(sig[:, o[:FIRST]]) | (t << 8 * FIRST) for t, o in enumerate(orders)])
            deep = np.concatenate([packed(sig[:, o[FIRST:]]) for o in orders])
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, TREES)), pa.array(region), pa.array(deep)], names=["id", "region", "deep"])

    rows = classes.select("id", "signature").mapInArrow(spread, "id long, region long, deep long")
    return rows.repartitionByRange("region", "deep", "id").sortWithinPartitions("region", "deep", "id")


def shared_prefix(deep: np.ndarray) -> np.ndarray:
    """Coordinates that successive rows of one region have in common, first to last."""
    differ = deep[1:] ^ deep[:-1]
    return FIRST + sum((differ >> 8 * k == 0).astype(np.int64) for k in range(DEPTH - FIRST))


def part_starts(common: np.ndarray, most: int) -> np.ndarray:
    """Starts of the parts of a region: prefixes deepen until a part holds at most `most` rows.

    `common` holds what successive rows share. Rows that share all coordinates are cut by number.
    """
    starts, pending = [], [(0, len(common) + 1, FIRST)]
    while pending:
        first, end, depth = pending.pop()
        if end - first <= most:
            starts.append(first)
        elif depth == DEPTH:
            starts += range(first, end, most)
        else:
            bounds = [first, *(first + 1 + np.flatnonzero(common[first : end - 1] <= depth)), end]
            pending += [(int(a), int(b), depth + 1) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return np.array(sorted(starts))


#: `first`: smallest id of the row's part; neighbours in the order with what they share, null if alone.
MET_SCHEMA = "id long, region long, salt int, first long, before long, before_common int, after long, after_common int"


def _met(orders: DataFrame) -> DataFrame:
    """The rows that share their region with another one, each with whom it meets in it.

    A task walks through its range of the order and holds one run at a time. Rows at the ends of a
    range are kept, as their region may go on in the next one.
    """

    def run_of(region: int, ids: np.ndarray, deep: np.ndarray, long_before: bool) -> pa.RecordBatch:
        n = len(ids)
        common = shared_prefix(deep)
        starts = part_starts(common, PART_ROWS)
        first = np.repeat(np.minimum.reduceat(ids, starts), np.diff([*starts, n]))
        crowded = long_before or n >= CROWDED
        salt = ids % SALTS if crowded else np.zeros(n, np.int64)
        known = np.arange(n) > 0
        before, after = np.roll(ids, 1), np.roll(ids, -1)
        left, right = np.concatenate([[0], common]), np.concatenate([common, [0]])
        columns = [
            pa.array(ids), pa.array(np.full(n, region)), pa.array(salt.astype(np.int32)), pa.array(first),
            pa.array(before, mask=~known), pa.array(left.astype(np.int32)), pa.array(after, mask=~known[::-1]), pa.array(right.astype(np.int32)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in MET_SCHEMA.split(", ")])

    def walk(batches):
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 3
        at_start, long_before, cut = True, False, None  # whether the first held rows go on with a region that was cut
        for batch in batches:
            id_, region, deep = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("id", "region", "deep"), strict=True))
            starts = np.concatenate([[0], np.flatnonzero(region[1:] != region[:-1]) + 1]) if len(region) else np.zeros(1, np.int64)
            long_before = long_before and (not len(region) or region[0] == cut)
            ends = np.concatenate([starts[1:], [len(region)]])
            for s, e in zip(starts[:-1], ends[:-1], strict=True):
                if e - s > 1 or at_start or long_before:
                    yield run_of(region[s], id_[s:e], deep[s:e], long_before)
                at_start = long_before = False
            rest = starts[-1]
            if len(region) - rest >= HELD:
                yield run_of(region[rest], id_[rest:], deep[rest:], long_before)
                cut, rest, at_start, long_before = region[rest], len(region), False, True
            elif len(starts) > 1:
                long_before = False
            held = [id_[rest:], region[rest:], deep[rest:]]
        if len(held[0]):
            yield run_of(held[1][0], held[0], held[2], long_before)

    return orders.mapInArrow(walk, MET_SCHEMA)


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share at least `percent` in a hundred of their union."""
    shared = _shared(x, y)
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike enough."""

    def check(batches):
        for batch in slices(batches, 512):
            good = [
                _alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"), F.col("n").alias("n_a")), "a")
    joined = joined.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"), F.col("n").alias("n_b")), "b")
    # Sets whose sizes differ too much cannot be alike enough.
    joined = joined.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(check, "a long, b long")


def _blocks(weight: Column) -> Column:
    return F.ceil(weight / F.lit(float(BLOCK))).cast("int")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows `id, region, salt, comp, n` of regions with several components, each with its block of the region.

    Adds `mine`, the number of the row's block, `own`, the first block of its component and their
    number (null if it shares blocks), `all`, the blocks of the region, `salts` and `weight` of it.
    """
    weight = F.greatest(F.lit(1.0), F.col("n") / 1024.0)
    comps = rows.groupBy("region", "comp").agg(F.sum(weight).alias("w"), F.max("salt").alias("salt"))
    large = F.when(F.col("w") >= BLOCK, F.struct("comp", _blocks(F.col("w")).alias("blocks")))
    layout = comps.groupBy("region").agg(
        F.max("salt").alias("salts"), F.count("*").alias("comps"), F.sort_array(F.collect_list(large)).alias("large"), F.sum("w").alias("weight"),
        F.coalesce(F.sum(F.when(F.col("w") < BLOCK, F.col("w"))), F.lit(0.0)).alias("small"),
    )
    # A region's components with a block of their own are fewer than its rows by a factor of BLOCK.
    layout = layout.where("comps > 1").withColumn("shared", _blocks(F.col("small")))

    def blocks_of(some: Column) -> Column:
        return F.col("shared") + F.aggregate(some, F.lit(0), lambda s, x: s + x["blocks"])

    starts = F.transform("large", lambda x, i: F.struct(x["comp"].alias("comp"), x["blocks"].alias("blocks"), blocks_of(F.slice("large", F.lit(1), i)).alias("start")))
    layout = layout.select("region", "salts", "weight", "shared", starts.alias("large"), blocks_of(F.col("large")).alias("all"))
    layout = written(layout, "layout")
    # A region's rows have salts up to the largest that one of them has, whatever run gave it.
    rows = rows.join(layout.withColumn("salt", F.explode(F.sequence(F.lit(0), "salts"))), ["region", "salt"])
    own = F.try_element_at(F.filter("large", lambda x: x["comp"] == F.col("comp")), F.lit(1))
    rows = rows.withColumn("own", own)
    first, blocks = F.coalesce(F.col("own.start"), F.lit(0)), F.coalesce(F.col("own.blocks"), F.col("shared"))
    rows = rows.withColumn("mine", first + F.pmod(F.xxhash64("id"), blocks).cast("int"))
    return rows.select("id", "region", "salt", "comp", "mine", F.struct("own.start", "own.blocks").alias("own"), "all", "salts", "weight")


def _paired(placed: DataFrame) -> DataFrame:
    """Rows of `_placed`, with whatever they carry, once for each pair of blocks in which they are compared.

    Adds `lo, hi`, the numbers of the two blocks, and `side`: 0 or 1 for the block, 2 if both are
    one. A component that fills a block has blocks of its own, which are not paired with each other;
    smaller ones share blocks. Every two rows across components meet in one pair of blocks.
    """
    rows = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("all") - 1)))
    rows = rows.where(F.col("own.start").isNull() | (F.col("other") < F.col("own.start")) | (F.col("other") >= F.col("own.start") + F.col("own.blocks")))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    rows = rows.withColumns({"lo": lo, "hi": hi, "side": F.when(lo == hi, F.lit(2)).otherwise((F.col("mine") == hi).cast("int"))})
    return rows.drop("salt", "mine", "other", "own", "all", "salts", "weight")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows `id, region, salt, comp, n` of regions with several components, dealt into pairs of blocks."""
    return _paired(_placed(rows))


def difference(shingles: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, int]:
    """Sorted shingles that are in one of the two sets only, and how many of `core` are missing in the set.

    Two sets with differences x and y from one core, of which p and q shingles are missing, share
    len(core) - p - q + |x and y| shingles: exact, whatever the core is.
    """
    delta = np.setxor1d(shingles, core, assume_unique=True)
    return delta, (len(core) - len(shingles) + len(delta)) // 2


def _cores(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """`region, salts, core`: the shingles in over half of a few rows of each region of several blocks.

    The rows are chosen by the hash of their id, about CORE_ROWS rows or thousands of shingles of a
    region, so that any region's sample fits in a task. A region whose rows are too long to be
    chosen has no core; the sample changes how much travels, not what is found.
    """
    share = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) * F.col("weight") < F.lit(float(CORE_ROWS << 20))
    sample = placed.where(F.col("all") > 1).where(share).select("region", "salts", "id").join(sets.select("id", "set"), "id")

    def common(batches):
        for batch in slices(batches, 16):
            cores = []
            for of_region in batch.column("sets").to_pylist():
                values, times = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in of_region]), return_counts=True)
                cores.append(values[2 * times > len(of_region)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("salts"), pa.array(cores, pa.binary())], names=["region", "salts", "core"])

    return sample.groupBy("region", "salts").agg(F.collect_list("set").alias("sets")).mapInArrow(common, "region long, salts int, core binary")


def _differences(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of `_placed` with `core_size, missing, delta` of their sets against the region's core.

    Each row meets its set once, before it is dealt into pairs of blocks. A region of one block
    keeps full sets, as they travel once.
    """
    cores = written(_cores(placed, sets), "cores")
    rows = placed.join(sets.select("id", "set"), "id")
    whole = rows.where(F.col("all") == 1).withColumns({"core_size": F.lit(0), "missing": F.lit(0)}).withColumnRenamed("set", "delta")
    copies = cores.withColumn("salt", F.explode(F.sequence(F.lit(0), "salts"))).drop("salts")
    many = rows.where(F.col("all") > 1).join(copies, ["region", "salt"], "left")
    kept = [c for c in whole.columns if c not in ("core_size", "missing", "delta")]

    def against(batches):
        for batch in slices(batches, 256):
            made = [
                (len(c or b"") // 8, *difference(np.frombuffer(x, np.uint64), np.frombuffer(c or b"", np.uint64)))
                for x, c in zip(batch.column("set").to_pylist(), batch.column("core").to_pylist(), strict=True)
            ]
            columns = [pa.array([m[0] for m in made], pa.int32()), pa.array([m[2] for m in made], pa.int32()), pa.array([m[1].tobytes() for m in made], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], names=[*kept, "core_size", "missing", "delta"])

    schema = T.StructType([*(placed.schema[c] for c in kept), *(T.StructField(c, T.IntegerType()) for c in ("core_size", "missing")), T.StructField("delta", T.BinaryType())])
    return whole.select(*kept, "core_size", "missing", "delta").union(many.select(*kept, "set", "core").mapInArrow(against, schema))


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of `a` has in common with each of `b`, as a product of 0/1 matrices."""
    flat = np.concatenate([*a, *b])
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    often = times > 1
    number = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(a), len(b)), np.float32)
    width = 1024
    for at in range(0, int(often.sum()), width):
        s, e = np.searchsorted(column, (at, at + width))
        x = np.zeros((len(a) + len(b), width), np.float32)
        x[row[s:e], column[s:e] - at] = 1
        out += x[: len(a)] @ x[len(a) :].T
    return out.astype(np.int32)


def links_across(comp: np.ndarray, side: np.ndarray, core_size: int, missing: np.ndarray, deltas: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions, of different components and sides, whose sets are alike enough.

    Sets are given by their differences from a core of `core_size` shingles. Both ways of comparing
    are exact; the one with less work is taken.
    """
    one = bool(side[0] == 2)
    a, b = (np.arange(len(comp)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    width = np.fromiter(map(len, deltas), np.int64, len(deltas))
    missing = missing.astype(np.int64)
    n = core_size + width - 2 * missing
    x, y = n[a][:, None], n[b][None, :]
    wanted = (comp[a][:, None] != comp[b][None, :]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
    if one:
        wanted &= a[:, None] < b[None, :]
    i, j = np.nonzero(wanted)
    if len(i) * (400 + width.mean()) < 2 * len(a) * len(b) + 100 * width.sum():
        both = np.fromiter((_shared(deltas[p], deltas[q]) for p, q in zip(a[i], b[j], strict=True)), np.int64, len(i))
    else:
        both = shared_counts([deltas[p] for p in a], [deltas[q] for q in b])[i, j]
    shared = core_size - missing[a[i]] - missing[b[j]] + both
    good = 100 * shared >= percent * (n[a[i]] + n[b[j]] - shared)
    return a[i[good]], b[j[good]]


def _merged(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows (smallest component, component) of the components that links of positions connect."""
    names, at = np.unique(comp, return_inverse=True)
    label, before = np.arange(len(names)), None
    while before is None or (label != before).any():
        before = label.copy()
        least = np.minimum(label[at[a]], label[at[b]])
        np.minimum.at(label, at[a], least)
        np.minimum.at(label, at[b], least)
        label = label[label]
    moved = np.flatnonzero(label != np.arange(len(names)))
    return np.stack([names[label[moved]], names[moved]], axis=1)


def _across(dealt: DataFrame, percent: int) -> DataFrame:
    """`a, b`: components that are connected by a link inside a pair of blocks.

    The differences travel with the rows, so that a pair of blocks is decided where it meets.
    """

    def groups(batches):
        held = None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            name = np.stack([held.column(c).to_numpy() for c in ("region", "lo", "hi")])
            starts = [0, *(np.flatnonzero((name[:, 1:] != name[:, :-1]).any(axis=0)) + 1)]
            for s, e in zip(starts[:-1], starts[1:], strict=True):
                yield held.slice(s, e - s)
            held = held.slice(starts[-1])
        if held is not None and held.num_rows:
            yield held

    def compare(batches):
        for group in groups(batches):
            comp, side = group.column("comp").to_numpy(), group.column("side").to_numpy()
            if (comp == comp[0]).all() or (side[0] != 2 and (side == side[0]).all()):
                continue
            deltas = [np.frombuffer(x, np.uint64) for x in group.column("delta").to_pylist()]
            a, b = links_across(comp, side, group.column("core_size")[0].as_py(), group.column("missing").to_numpy(), deltas, percent)
            if len(a):
                found = _merged(comp, a, b)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    rows = dealt.select("region", "lo", "hi", "side", "comp", "core_size", "missing", "delta")
    rows = rows.repartition("region", "lo", "hi").sortWithinPartitions("region", "lo", "hi", "side")
    return rows.mapInArrow(compare, "a long, b long").distinct()


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """`id, n, set` of the documents whose doc_id is in `wanted`; one row for each text of a doc_id."""

    def sets_of(batches):
        for batch in slices(batches, 128):
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["id", "n", "set"],
            )

    texts = docs.select("doc_id", "text").join(wanted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    return texts.mapInArrow(sets_of, "id long, n long, set binary")


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = WORDS) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept` for every row.

    Documents are linked if their sets of `words`-word shingles share at least `percent` in a
    hundred of their union; `component_id` is the smallest doc_id reachable over links. Rows with
    equal sets are one class. Documents without words (null or empty text) are linked with nothing,
    not even each other. A row with a null doc_id has a null component and is not kept; rows that
    repeat a doc_id each get a row, with their own n_shingles, and are one document with several
    texts when it comes to links. An empty table gives no rows; other columns are ignored.
    """
    described = written(_describe(docs, words), "described")
    identified = described.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = identified.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"), F.count("*").alias("rows"))
    classes = written(classes, "classes")
    met = written(_met(_orders(classes)), "met")

    # First round: the first of a row's part and its neighbours of the longest prefix, over all trees.
    def nearest(side: str) -> Column:
        return F.max(F.when(F.col(side).isNotNull(), F.struct(f"{side}_common", side)))[side]

    near = met.groupBy("id").agg(F.min("first").alias("first"), nearest("before").alias("before"), nearest("after").alias("after"), F.count("*").alias("regions"))
    near = written(near, "near")
    pairs = near.select("id", F.explode(F.array("first", "before", "after")).alias("other")).where("other <> id")
    pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    repeats = identified.groupBy("doc_id").count().where("count > 1")
    repeated = not repeats.isEmpty()
    sets = _sets(docs, near.select("id"), words)
    sets = written(sets.dropDuplicates(["id", "set"]) if repeated else sets, "sets")
    links = confirmed(pairs, sets, percent)
    if repeated:  # a doc_id of several texts links the classes of these texts
        own = identified.join(repeats, "doc_id", "left_semi").join(classes.select("digest", "id"), "digest")
        links = links.union(own.select(F.col("id").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct())
    links = written(links, "links")
    found = written(components(links), "components")

    # Second round: whatever regions hold across the components found so far.
    sizes = sets.groupBy("id").agg(F.max("n").alias("n")).join(found, "id", "left").select("id", "n", F.coalesce("component", "id").alias("comp"))
    rows = written(met.select("id", "region", "salt").join(sizes, "id"), "regions")
    placed = written(_placed(rows), "placed")
    merged = written(_across(_paired(_differences(placed, sets)), percent), "merged")
    if not merged.isEmpty():
        found = written(components(links.union(merged)), "components")

    # Classes of one row that are linked with nothing keep their own doc_id.
    shared = classes.join(found, "id", "left").where((F.col("rows") > 1) | F.col("component").isNotNull())
    shared = written(shared.select("digest", F.coalesce("component", "id").alias("component")), "shared")
    out = joined_by_hot_key(described.select("doc_id", "n_shingles", "digest"), shared, "digest", F.col("doc_id"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
