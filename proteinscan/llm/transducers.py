"""Weighted acyclic automata over runs of numbered words, in numpy.

A `Trie` holds sorted runs level by level: a row of a level is a prefix, with the row of its own
prefix, its last word and a weight. As bytes it is a minimal automaton: states are closed from the
longest runs up, and states with equal arcs (word, weight, next state) are one.
"""

from __future__ import annotations

import dataclasses
import struct

import numpy as np

#: Odd multipliers that mix an arc's word, weight, next state and place into its state's hash.
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


@dataclasses.dataclass
class Level:
    """Prefixes of one length, sorted by `parent`, then `word`."""

    parent: np.ndarray
    word: np.ndarray
    weight: np.ndarray

    def starts(self, parents: int) -> np.ndarray:
        """Where each parent's rows begin, and the number of rows."""
        return np.searchsorted(self.parent, np.arange(parents + 1))


def counted(code: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, ascending, the place of each row's code among them, and the sums of their weights (rows without)."""
    distinct, place, times = np.unique(code, return_inverse=True, return_counts=True)
    if weight is None:
        return distinct, place, times.astype(np.int64)
    order = np.argsort(place, kind="stable")
    firsts = np.cumsum(times) - times
    return distinct, place, np.add.reduceat(weight[order], firsts) if len(firsts) else np.zeros(0, np.int64)


class Trie:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def of_text(cls, words: np.ndarray, longest: int) -> Trie:
        """All runs of up to `longest` words in a text of word numbers; 0 is a break that no run holds."""
        names, rank = np.unique(words, return_inverse=True)
        at = rank.astype(np.int64)
        held = words > 0
        distinct, place, times = counted(at[held])
        levels = [Level(np.zeros(len(distinct), np.int64), names[distinct], times)]
        row = np.full(len(words), -1, np.int64)
        row[held] = place
        for k in range(1, longest):
            ends = np.arange(k, len(words))
            ends = ends[(row[ends - k] >= 0) & held[ends]]
            distinct, place, times = counted(row[ends - k] * len(names) + at[ends])
            levels.append(Level(distinct // len(names), names[distinct % len(names)], times))
            row = np.full(len(words), -1, np.int64)
            row[ends - k] = place
        return cls(levels)

    def paths(self, level: int) -> list[np.ndarray]:
        """Words of the prefixes of a level, first to last."""
        out, row = [], np.arange(len(self.levels[level].word))
        for k in range(level, -1, -1):
            out.append(self.levels[k].word[row])
            row = self.levels[k].parent[row]
        return out[::-1]

    def rows_of(self, level: int, prefix: int) -> np.ndarray:
        """For each prefix of `level`, the row of its first `prefix` + 1 words."""
        row = np.arange(len(self.levels[level].word))
        for k in range(level, prefix, -1):
            row = self.levels[k].parent[row]
        return row

    def select(self, level: int, keep: np.ndarray) -> Trie:
        """The prefixes of `level` that `keep` marks, what they begin with, and what goes on from them."""
        marks = [np.zeros(len(x.word), bool) for x in self.levels]
        marks[level] = keep.copy()
        for k in range(level, 0, -1):
            marks[k - 1][self.levels[k].parent[marks[k]]] = True
        for k in range(level + 1, len(self.levels)):
            marks[k] = marks[k - 1][self.levels[k].parent]
        levels, number = [], np.zeros(1, np.int64)
        for x, mark in zip(self.levels, marks, strict=True):
            levels.append(Level(number[x.parent[mark]], x.word[mark], x.weight[mark]))
            number = np.cumsum(mark) - 1
        return Trie(levels)

    def at_least(self, least: int, level: int = 1) -> Trie:
        """Without the prefixes of `level` and longer that weigh less; shorter ones that lead to none go too."""
        out = self
        for k in range(level, len(self.levels)):
            light = out.levels[k].weight < least
            if k == level:
                out = out.select(k, ~light)
            else:
                kept = Level(*(x[~light] for x in (out.levels[k].parent, out.levels[k].word, out.levels[k].weight)))
                # What follows a light prefix weighs no more than it and is light itself.
                number = np.cumsum(~light) - 1
                rest = [Level(number[x.parent[m]], x.word[m], x.weight[m]) for x in out.levels[k + 1 : k + 2] for m in [~light[x.parent]]]
                out = Trie([*out.levels[:k], kept, *rest, *out.levels[k + 2 :]])
        return out

    def find(self, words: list[np.ndarray]) -> np.ndarray:
        """Rows of the prefixes with these words, one array for each place; -1 where there is none."""
        row = np.zeros(len(words[0]), np.int64)
        for x, word in zip(self.levels, words, strict=False):
            names, rank = np.unique(np.concatenate([x.word, word]), return_inverse=True)
            code = x.parent * len(names) + rank[: len(x.word)]
            wanted = np.where(row >= 0, row * len(names) + rank[len(x.word) :], -1)
            place = np.minimum(np.searchsorted(code, wanted), max(0, len(code) - 1))
            row = np.where(code[place] == wanted, place, -1) if len(code) else np.full(len(wanted), -1)
        return row

    def compose(self, words: list[np.ndarray]) -> np.ndarray:
        """Weights of the runs with these words: those of the paths that both sides share, 0 for others."""
        row = self.find(words)
        weight = self.levels[len(words) - 1].weight
        return np.where(row >= 0, weight[row], 0) if len(weight) else np.zeros(len(row), np.int64)


def union(tries: list[Trie]) -> Trie:
    """One trie with the runs of all, weights summed."""
    if len(tries) == 1:
        return tries[0]
    levels, row = [], [np.zeros(1, np.int64)] * len(tries)
    for parts in zip(*(t.levels for t in tries), strict=True):
        names, rank = np.unique(np.concatenate([x.word for x in parts]), return_inverse=True)
        parent = np.concatenate([r[x.parent] for r, x in zip(row, parts, strict=True)])
        distinct, place, weight = counted(parent * max(1, len(names)) + rank, np.concatenate([x.weight for x in parts]))
        levels.append(Level(distinct // max(1, len(names)), names[distinct % max(1, len(names))], weight))
        ends = np.cumsum([len(x.word) for x in parts])
        row = np.split(place, ends[:-1])
    return Trie(levels)


def _narrow(values: np.ndarray) -> np.ndarray:
    largest = int(values.max(initial=0))
    return values.astype(next(t for t, bits in (("<u1", 8), ("<u2", 16), ("<u4", 32), ("<u8", 64)) if largest < 2**bits))


def to_bytes(trie: Trie) -> bytes:
    """The minimal automaton: per level, from the longest runs up, arcs of distinct states and the state of each prefix."""
    parts: list[np.ndarray] = []
    state = None
    for k in range(len(trie.levels) - 1, -1, -1):
        x = trie.levels[k]
        parents = len(trie.levels[k - 1].word) if k else 1
        starts = x.starts(parents)
        sizes = np.diff(starts)
        arcs = [x.word.astype(np.uint64), x.weight.astype(np.uint64), (np.zeros(len(x.word)) if state is None else state).astype(np.uint64)]
        within = (np.arange(len(x.word)) - np.repeat(starts[:-1], sizes)).astype(np.uint64)
        h = np.zeros(len(within), np.uint64)
        for part, mix in zip((*arcs, within), _MIX, strict=True):
            h = (h ^ (part + np.uint64(1))) * np.uint64(mix)
            h ^= h >> np.uint64(32)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
        _, first, place = np.unique(sums[starts[1:]] - sums[starts[:-1]], return_index=True, return_inverse=True)
        # Equal hashes are held against the arcs themselves; if any differ, no states are shared.
        same = (sizes[first][place] == sizes).all()
        image = _rows(starts[first][place], sizes) if same else None
        if not same or not all((a[image] == a).all() for a in arcs):
            first = place = np.arange(parents)
        taken = _rows(starts[first], sizes[first])
        parts += [_narrow(sizes[first]), *(_narrow(a[taken]) for a in arcs)]
        state = place
    head = struct.pack(f"<I{2 * len(parts)}I", len(parts), *(v for p in parts for v in (p.dtype.itemsize, len(p))))
    return head + b"".join(p.tobytes() for p in parts)


def _rows(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Row numbers of runs of rows, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(sizes.sum())) + np.repeat(starts - (ends - sizes), sizes)


def from_bytes(data: bytes) -> Trie:
    count = struct.unpack_from("<I", data)[0]
    sizes = struct.unpack_from(f"<{2 * count}I", data, 4)
    parts, at = [], 4 + 8 * count
    for width, n in zip(sizes[::2], sizes[1::2], strict=True):
        parts.append(np.frombuffer(data, f"<u{width}", n, at).astype(np.int64))
        at += width * n
    levels, state = [], np.zeros(1, np.int64)
    for k in range(count - 4, -1, -4):
        size, word, weight, target = parts[k : k + 4]
        starts = np.cumsum(size) - size
        rows = _rows(starts[state], size[state])
        levels.append(Level(np.repeat(np.arange(len(state)), size[state]), word[rows], weight[rows]))
        state = target[rows]
    return Trie(levels)
