"""Importance resampling towards a target distribution, over hashed word runs.

A document's weight is the log ratio of its features' probabilities under the target and under the
corpus. Gains are an array by bucket, so a document is scored by array lookups; Gumbel noise, fixed
by the document's id, turns the highest scores into a sample without replacement. The order of the
scores is found by a distributed radix sort.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proteinscan.llm import radix
from proteinscan.llm.common import slices, written

BUCKETS = 10_000
#: Longest run of words that is a feature, words of a document that may be drawn, and the percentage drawn.
LONGEST, LEAST_WORDS, PERCENT = 1, 20, 10
SEED = 2024

#: ASCII symbols that are no digits and no lower-case letters separate words.
_SEPARATORS = bytes(c for c in range(128) if not (chr(c).isdigit() or "a" <= chr(c) <= "z"))
_SPACED = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def words(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8: A to Z in lower case, cut at ASCII symbols other than digits and letters."""
    return (text or b"").lower().translate(_SPACED).split()


def buckets_of(found: list[bytes], buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Bucket of each run of up to `longest` words, repeats included."""
    runs = [np.fromiter(map(zlib.crc32, found), np.int64, len(found))]
    for n in range(2, min(longest, len(found)) + 1):
        runs.append(np.fromiter((zlib.crc32(b" ".join(found[i : i + n])) for i in range(len(found) - n + 1)), np.int64))
    return np.concatenate(runs) % buckets


def _texts(batches):
    for batch in slices(batches):
        yield batch, batch.column("text").cast(pa.binary()).to_pylist()


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features of all rows by bucket; a task sends its sums, a row for each bucket it met."""

    def count(batches):
        sums = np.zeros(buckets, np.int64)
        for _, rows in _texts(batches):
            for text in rows:
                sums += np.bincount(buckets_of(words(text), buckets, longest), minlength=buckets)
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(sums[met])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row per bucket
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the thousandths of the log ratio of target and corpus, both raised by one; floors go down."""
    n = len(corpus)
    s_all, t_all = float(corpus.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(corpus, target, strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel number that the id alone decides; a null id counts as empty."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """`doc_id, n_words, n_features, weight, score` of every row, by lookups in the array of gains."""

    def score(batches):
        for batch, texts in _texts(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                found = words(text)
                features = buckets_of(found, len(gain), longest)
                weight = int(gain[features].sum())
                out.append((doc_id, len(found), len(features), weight, weight + noise(doc_id, seed)))
            names = ["doc_id", "n_words", "n_features", "weight", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out) if out else [[]] * 5)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """`doc_id, n_words, n_features, weight, score, rank` of every row of `docs`.

    Gains compare the features of the texts of `target` with those of `docs`. Of the rows with at
    least `least_words` words, the `percent` in a hundred with the highest scores are drawn, which
    `rank` numbers from 1; of equal scores the smaller doc_id comes first, then rows without an id,
    then the order of reading. Rows that are not drawn have no rank. A null or empty text has no
    features and weight 0; repeated rows count as often as they occur; without target texts gains
    follow from the corpus alone; an empty table gives no rows; other columns are ignored.
    """
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    rows = written(scored(docs, gain, longest, seed).withColumn("row", F.monotonically_increasing_id()), "scored")
    able = rows.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    keys = able.select(
        "row", radix.descending(F.col("score")).alias("falling"), F.col("doc_id").isNull().cast("long").alias("lacks_id"), F.coalesce("doc_id", F.lit(0)).alias("id"),
    )
    order = radix.ranked(keys, ["falling", "lacks_id", "id"]).where(F.col("position") < drawn)
    ranks = order.select("row", (F.col("position") + 1).alias("rank"))
    return rows.join(ranks, "row", "left").select("doc_id", "n_words", "n_features", "weight", "score", "rank")
