"""Smith-Waterman scores with affine gaps: a gap of length L costs gap_open + L * gap_extend."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from proteinscan.functions import alphabet, matrices


def check_gaps(gap_open: int, gap_extend: int) -> None:
    for name, value in (("gap_open", gap_open), ("gap_extend", gap_extend)):
        if not 0 <= value <= 127:
            raise ValueError(f"{name} is {value}; it must be from 0 to 127")


class Tile:
    """Targets that lie side by side, codes by (position, lane), with the scores of every letter against them.

    Profiles and work space are made once for a kind of number, whatever the number of queries.
    """

    def __init__(self, lanes: np.ndarray, scores: np.ndarray):
        self.lanes, self.scores = lanes, scores
        self._profiles: dict[type, np.ndarray] = {}
        self._space: dict[tuple, list[np.ndarray]] = {}

    def profile(self, kind: type) -> np.ndarray:
        """Scores by (letter, position, lane)."""
        if kind not in self._profiles:
            self._profiles[kind] = np.take(self.scores.astype(kind), self.lanes, axis=1)
        return self._profiles[kind]

    def space(self, kind: type, gap_open: int, gap_extend: int) -> list[np.ndarray]:
        """Rising costs of extending and of closing a gap, zeros, and arrays of the program's rows, all zero where they start so."""
        n, lanes = self.lanes.shape
        key = (kind, gap_open, gap_extend)
        if key not in self._space:
            ramp = np.repeat((gap_extend * np.arange(n, dtype=kind))[:, None], lanes, axis=1)
            self._space[key] = [ramp, ramp + kind(gap_open), *(np.zeros((n + k, lanes), kind) for k in (0, 1, 0, 0, 0, 0, 0))]
        space = self._space[key]
        for part in space[3:6]:
            part.fill(0)
        return space


class Boundary:
    """What a query's program carries from one block of the targets to the next, by (query position, lane).

    `cells` holds the cells at the block's last position, after a row of zeros; `opened` what a gap
    that goes on from there is worth with its opening taken back: the cell, or the gap that ends in it.
    """

    def __init__(self, query_length: int, lanes: int):
        self.cells = np.zeros((query_length + 1, lanes), np.int32)
        self.opened = np.zeros((query_length, lanes), np.int32)


def score_tile(query: np.ndarray, tile: Tile, gap_open: int, gap_extend: int, carried: Boundary | None = None) -> np.ndarray:
    """Scores of one query against the targets of a tile.

    Rows of the dynamic program are whole arrays. A gap along the target is a running maximum of
    cells raised by their position; opening it from a cell that itself ends such a gap never pays,
    so the maximum may run over cells without it. It spans as many cells as a gap can have before it
    costs more than the largest cell of the row, in steps that double. Numbers have 8 or 16 bits
    where none can overflow.

    With `carried`, the tile is a block of longer targets: the program goes on from the block
    before, and leaves in `carried` what the next one needs.
    """
    m, (n, lanes) = len(query), tile.lanes.shape
    if not m or not n:
        return np.zeros(lanes, np.int32)
    bound = max((m if carried else min(m, n)) * int(tile.scores.max()) + gap_extend * (n + 1) + gap_open, gap_open + gap_extend * (n + 2), -int(tile.scores.min()))
    kind = np.int8 if bound < 127 else np.int16 if bound < 32_000 else np.int32
    profile = tile.profile(kind)
    ramp, closing, zeros, rows, column_gap, best, cell, raised, other = tile.space(kind, gap_open, gap_extend)
    first, more = kind(gap_open + gap_extend), kind(gap_extend)
    left = carried.cells.copy() if carried else None
    for i, a in enumerate(query):
        np.subtract(column_gap, more, out=column_gap)
        np.subtract(rows[1:], first, out=raised)
        np.maximum(column_gap, raised, out=column_gap)
        if carried:
            rows[0] = left[i]
        np.add(rows[:-1], profile[a], out=cell)
        np.maximum(cell, column_gap, out=cell)
        np.maximum(cell, zeros, out=cell)
        if carried:
            # The gap that comes in costs one extension more at each position.
            incoming = carried.opened[i] - (gap_open + gap_extend)
            if (reach := int(incoming.max())) > 0:
                width = min(n, reach // gap_extend + 1) if gap_extend else n
                np.maximum(cell[:width], incoming.astype(kind) - ramp[:width], out=cell[:width])
        np.maximum(best, cell, out=best)
        largest = int(cell.max())
        if largest <= gap_open + gap_extend:  # no gap pays
            rows[1:] = cell
            if carried:
                carried.cells[i + 1] = cell[-1]
                carried.opened[i] = np.maximum(cell[-1], incoming - gap_extend * (n - 1) + gap_open)
            continue
        np.add(cell, ramp, out=raised)
        span = min(n - 1, (largest - gap_open) // gap_extend) if gap_extend else n - 1
        now, then, step = raised, other, 1
        while step < span:
            np.maximum(now[step:], now[:-step], out=then[step:])
            then[:step] = now[:step]
            now, then, step = then, now, 2 * step
        np.subtract(now[:-1], closing[1:], out=then[:-1])
        rows[1] = cell[0]
        np.maximum(cell[1:], then[:-1], out=rows[2:])
        if carried:
            carried.cells[i + 1] = rows[n]
            inside = then[n - 2].astype(np.int32) + gap_open if n > 1 else rows[n]
            carried.opened[i] = np.maximum(np.maximum(rows[n], inside), incoming - gap_extend * (n - 1) + gap_open)
    return best.max(axis=0).astype(np.int32)


def score_long(queries: list[np.ndarray], target: np.ndarray, scores: np.ndarray, gap_open: int, gap_extend: int, block: int) -> np.ndarray:
    """Scores of queries against one target of any length, `block` positions at a time.

    Memory follows the block and the queries, not the target.
    """
    out = np.zeros(len(queries), np.int32)
    carried = [Boundary(len(q), 1) for q in queries]
    for at in range(0, len(target), block):
        tile = Tile(target[at : at + block, None], scores)
        for k, (query, boundary) in enumerate(zip(queries, carried, strict=True)):
            out[k] = max(out[k], int(score_tile(query, tile, gap_open, gap_extend, boundary)[0]))
    return out


def score_bounds(queries: list[np.ndarray], counts: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """No score of a query (row) against a target (column) is larger than this; `counts` are targets' letters by (target, code).

    Each letter of either side can add at most its best score with a letter of the other.
    """
    best = np.maximum(scores, 0).astype(np.int64)
    out = np.empty((len(queries), len(counts)), np.int64)
    held = counts > 0
    for k, query in enumerate(queries):
        own = np.bincount(query, minlength=len(scores))
        by_target = counts @ best[:, own > 0].max(axis=1, initial=0)
        by_query = np.zeros(len(counts), np.int64)
        for letter in np.flatnonzero(own):
            by_query += own[letter] * np.where(held, best[letter], 0).max(axis=1, initial=0)
        out[k] = np.minimum(by_target, by_query)
    return out


def score_lanes(query: np.ndarray, targets: np.ndarray, scores: np.ndarray, gap_open: int, gap_extend: int) -> np.ndarray:
    return score_tile(query, Tile(targets, scores), gap_open, gap_extend)


def lanes_of(sequences: list[np.ndarray]) -> np.ndarray:
    """Codes by (position, lane), shorter sequences padded."""
    out = np.full((max(map(len, sequences), default=0), len(sequences)), alphabet.PADDING, np.uint8)
    for lane, codes in enumerate(sequences):
        out[: len(codes), lane] = codes
    return out


def score_pair(query: str, target: str, matrix: str = matrices.DEFAULT, gap_open: int = 10, gap_extend: int = 2) -> int:
    check_gaps(gap_open, gap_extend)
    return int(score_lanes(alphabet.encode(query), lanes_of([alphabet.encode(target)]), matrices.load(matrix), gap_open, gap_extend)[0])


def score_expr(query: Column, target: Column, matrix: str = matrices.DEFAULT, gap_open: int = 10, gap_extend: int = 2) -> Column:
    """The same score as a built-in expression over anti-diagonals, for cross-checks: no Python, but slow."""
    check_gaps(gap_open, gap_extend)
    cost, size = gap_open + gap_extend, alphabet.DUMMY + 1
    table = F.lit(matrices.literal(matrix))

    def over(q: Column, t: Column) -> Column:
        m, n = F.size(q), F.size(t)
        zero = F.transform(q, lambda _: F.struct(F.lit(0).alias("h"), F.lit(-cost).alias("e"), F.lit(-cost).alias("f")))
        start = F.struct(zero.alias("now"), F.transform(q, lambda _: F.lit(0)).alias("before"), F.lit(0).alias("best"))

        def advance(state: Column, d: Column) -> Column:
            def cell(_: Column, k: Column) -> Column:
                j = d - k
                up = F.when(k > 0, F.try_element_at(state["now"], k))
                here = F.element_at(state["now"], k + 1)
                e = F.greatest(here["e"] - gap_extend, here["h"] - cost)
                f = F.greatest(F.coalesce(up["f"], F.lit(-cost)) - gap_extend, F.coalesce(up["h"], F.lit(0)) - cost)
                pair = F.element_at(table, F.element_at(q, k + 1) * size + F.try_element_at(t, F.greatest(j, F.lit(1))) + 1)
                diagonal = F.when(k > 0, F.element_at(state["before"], F.greatest(k, F.lit(1)))).otherwise(F.lit(0))
                h = F.when((j >= 1) & (j <= n), F.greatest(F.lit(0), diagonal + pair, e, f)).otherwise(F.lit(0))
                return F.struct(h.alias("h"), e.alias("e"), f.alias("f"))

            now = F.transform(q, cell)
            before = F.transform(state["now"], lambda x: x["h"])
            return F.struct(now.alias("now"), before.alias("before"), F.greatest(state["best"], F.array_max(F.transform(now, lambda x: x["h"]))).alias("best"))

        return F.when((m > 0) & (n > 0), F.aggregate(F.sequence(F.lit(1), m + n - 1), start, advance, lambda s: s["best"])).otherwise(F.lit(0))

    return F.element_at(F.transform(F.array(F.struct(alphabet.codes(query).alias("q"), alphabet.codes(target).alias("t"))), lambda x: over(x["q"], x["t"])), 1)
