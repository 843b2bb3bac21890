"""Packing documents into fixed-length token sequences.

Documents are tokenised once and cut into full pieces and one remainder. Shortest-pack-first
works on the histogram of piece lengths alone (at most `max_len` counts, whatever the corpus
holds), and the resulting patterns are joined back to the pieces by their rank within a length.
"""

from __future__ import annotations

import base64
import dataclasses
import functools
import heapq
import json
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proteinscan.llm.common import slices, written

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
BUCKET_ROWS = 5000
MIN_BUCKETS = 64


@dataclasses.dataclass(frozen=True)
class Vocabulary:
    """Files of one vocabulary, by name or path, and the pattern that splits text before its merges.

    Names are looked up where a task runs.
    """

    ranks: str = "byte_bpe_50k.tiktoken"
    tokenizer: str = "byte_bpe_50k.json"
    pattern: str = public_tokenizers.PATTERN


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: Vocabulary):
    """Function from a text to its ids: those of the vocabulary's `tokenizers` file.

    The rank file is read much faster than that one but knows no special tokens; they are taken
    from the tokenizer's file, and their strings in a text are read as `tokenizers` reads them.
    """
    import tiktoken

    with open(public_tokenizers.path(vocabulary.ranks), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    with open(public_tokenizers.path(vocabulary.tokenizer)) as described:
        special = {t["content"]: t["id"] for t in json.load(described)["added_tokens"]}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens=special)
    return functools.partial(encoding.encode, allowed_special="all")


def document_pieces(docs: DataFrame, vocabulary: Vocabulary, max_len: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece of at most `max_len` ids: full pieces from the start, then the remainder.

    A document's ids are those of its text (null counts as empty) and `end_id`. `ids_crc32` is
    over the piece's ids as little-endian 32-bit values.
    """

    def cut(batches):
        encode = encoder(vocabulary)
        for batch in slices(batches):
            out = ([], [], [], [], [])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                for start in range(0, len(ids), max_len):
                    piece = ids[start : start + max_len]
                    for column, value in zip(out, (doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)), strict=True):
                        column.append(value)
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=list(names))

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE_SCHEMA)


def shortest_pack_first(histogram: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns with counts: lengths are placed longest first, each into the emptiest packs.

    A pattern is the tuple of lengths in a pack. Counts move in bulk, so the work depends on the
    number of distinct lengths, not of documents.
    """
    by_space: dict[int, dict[tuple[int, ...], int]] = {}
    spaces: list[int] = []  # max-heap of spaces that may hold patterns

    def put(space: int, pattern: tuple[int, ...], count: int) -> None:
        packs = by_space.setdefault(space, {})
        if not packs:
            heapq.heappush(spaces, -space)
        packs[pattern] = packs.get(pattern, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and spaces and -spaces[0] >= length:
            space = -spaces[0]
            packs = by_space[space]
            if not packs:
                heapq.heappop(spaces)
                continue
            pattern, count = packs.popitem()
            take = min(count, left)
            if take < count:
                packs[pattern] = count - take
            put(space - length, (*pattern, length), take)
            left -= take
        # Where none has room, a new pack takes as many of this length as fit; one each would stay
        # half empty if few shorter pieces follow.
        fit = max_len // length
        if left >= fit:
            put(max_len - fit * length, (length,) * fit, left // fit)
        if left % fit:
            put(max_len - (left % fit) * length, (length,) * (left % fit), 1)
    return sorted((p, n) for packs in by_space.values() for p, n in packs.items() if n)


def slot_table(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank, first sequence and offset of each run of ranks, in rank order."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    first_sequence = 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            slots.setdefault(length, []).append((taken.get(length, 0), first_sequence, offset))
            taken[length] = taken.get(length, 0) + count
            offset += length
        first_sequence += count
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in slots.items()}


def pack(docs: DataFrame, vocabulary: Vocabulary = Vocabulary(), max_len: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces with `sequence_id` and `offset`.

    Every row of `docs` is packed. Null and empty texts are one piece of one id, repeated rows are
    packed as often as they occur, ids may be null, and an empty table gives no rows. Other columns
    are ignored.
    """
    pieces = written(document_pieces(docs, vocabulary, max_len, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most max_len rows
    slots = slot_table(shortest_pack_first(histogram, max_len))

    # Rank within a length: ranks inside a bucket, plus the counts of the buckets before it.
    buckets = max(MIN_BUCKETS, sum(histogram.values()) // BUCKET_ROWS)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_rank"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(inside) - 1).join(counts, ["length", "bucket"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first_rank") + F.col("rank")).alias("rank"))

    def place(frames):
        for frame in frames:
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            lengths, ranks = frame["length"].to_numpy(), frame["rank"].to_numpy()
            for length in np.unique(lengths):
                first, base, at = slots[int(length)]
                mine = np.flatnonzero(lengths == length)
                run = np.searchsorted(first, ranks[mine], side="right") - 1
                sequence[mine] = base[run] + ranks[mine] - first[run]
                offset[mine] = at[run]
            yield pd.DataFrame({**{c: frame[c] for c in frame.columns if c != "rank"}, "sequence_id": sequence, "offset": offset})

    return ranked.mapInPandas(place, PIECE_SCHEMA + ", sequence_id long, offset long")
