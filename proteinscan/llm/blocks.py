"""Token blocks: documents as numbers of their block's words, and corpus counts brought back to the blocks.

A task cuts its documents into blocks of about BLOCK_BYTES of text and numbers the words of each
block. Only a block's distinct words, with their counts, travel: they are summed over the corpus
by word, and the sums are joined back to the words of every block. So vocabularies of any size are
counted whole, and no task or driver holds more than a block's own words.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proteinscan.llm.common import slices, written

#: Bytes of text after which a block ends; a longer document makes one of its own.
BLOCK_BYTES = 8 << 20
#: In the codes of a document, the number of a break, which is no word.
BREAK = 0
#: What a tokeniser yields for a break; no UTF-8 text holds this byte.
BREAK_TOKEN = b"\xff"

SCHEMA = "block long, doc_id long, label string, counted boolean, codes binary, word binary, number int, n long"


class _Block:
    """Numbers of a block's words, by label, and their counts in counted documents."""

    def __init__(self, number: int):
        self.number, self.bytes, self.words, self.codes = number, 0, {}, []
        self.counter = itertools.count(BREAK + 1)

    def encode(self, label: str | None, tokens: list[bytes], counted: bool) -> np.ndarray:
        words = self.words.get(label)
        if words is None:
            words = self.words[label] = _Numbers(self.counter)
        codes = np.fromiter(map(words.__getitem__, tokens), np.int32, len(tokens))
        if counted:
            self.codes.append(codes)
        return codes

    def rows(self):
        size = next(self.counter)
        counts = np.bincount(np.concatenate(self.codes), minlength=size) if self.codes else np.zeros(size, np.int64)
        for label, words in self.words.items():
            words.pop(BREAK_TOKEN)
            numbers = np.fromiter(words.values(), np.int32, len(words))
            whole = pa.array(list(words), pa.binary())
            for at in range(0, len(words), 1 << 16):
                part = numbers[at : at + (1 << 16)]
                yield _batch(len(part), block=np.full(len(part), self.number), label=[label] * len(part), word=whole.slice(at, 1 << 16), number=part, n=counts[part])


class _Numbers(dict):
    def __init__(self, counter):
        super().__init__({BREAK_TOKEN: BREAK})
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        number = self[word] = next(self.counter)
        return number


_TYPES = {"block": pa.int64(), "doc_id": pa.int64(), "label": pa.string(), "counted": pa.bool_(), "codes": pa.binary(), "word": pa.binary(), "number": pa.int32(), "n": pa.int64()}


def _batch(rows: int, **columns) -> pa.RecordBatch:
    arrays = [(c if isinstance(c, pa.Array) else pa.array(c, t)) if (c := columns.get(name)) is not None else pa.nulls(rows, t) for name, t in _TYPES.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(_TYPES))


def encode(docs: DataFrame, tokens: Callable[[bytes], list[bytes]], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Written rows of `docs` (`doc_id, label, counted, text`) and of their blocks' words.

    A row of a document has `block, doc_id, label, counted, codes` (32-bit numbers of its tokens, in
    order; null text: of the empty one); a row of a word has `block, label, word, number, n`, its
    occurrences in the block's counted documents of that label. Words of different labels differ.
    """

    def cut(batches):
        base = TaskContext.get().partitionId() << 32
        block = _Block(base)
        for batch in slices(batches, 64):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            labels, counted = batch.column("label").to_pylist(), batch.column("counted").to_pylist()
            codes, blocks = [], []
            for text, label, count in zip(texts, labels, counted, strict=True):
                if block.bytes >= block_bytes:
                    yield from block.rows()
                    block = _Block(block.number + 1)
                text = text or b""
                block.bytes += len(text) + 8
                codes.append(block.encode(label, tokens(text), bool(count)).tobytes())
                blocks.append(block.number)
            yield _batch(len(texts), block=blocks, doc_id=batch.column("doc_id"), label=batch.column("label"), counted=batch.column("counted"), codes=codes)
        yield from block.rows()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("label").cast("string"), F.coalesce("counted", F.lit(False)).alias("counted"), "text")
    return written(rows.mapInArrow(cut, SCHEMA), "blocks")


def documents_of(encoded: DataFrame) -> DataFrame:
    return encoded.where(F.col("codes").isNotNull()).select("block", "doc_id", "label", "counted", "codes")


def words_of(encoded: DataFrame) -> DataFrame:
    """Rows of words; the columns are new ones, so that they can meet the documents of the same table."""
    return encoded.where(F.col("word").isNotNull()).select(*(F.col(c).alias(c) for c in ("block", "label", "word", "number", "n")))


def cells(codes) -> list[np.ndarray]:
    """Codes of each row of an Arrow column as arrays."""
    return [np.frombuffer(c, np.int32) for c in codes.to_pylist()]
