"""The score and the best hits as functions of Spark SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from proteinscan.functions import alignment, alphabet, matrices

#: Positions times lanes that are scored at once.
TILE = 48_000


def scorer(matrix: str = matrices.DEFAULT, gap_open: int = 10, gap_extend: int = 2):
    """Function from two columns of sequences, in Arrow batches, to their scores; a null sequence has none.

    Rows of a batch that share a query are scored side by side, in order of length.
    """
    alignment.check_gaps(gap_open, gap_extend)
    table = matrices.load(matrix)

    def score(query: pd.Series, target: pd.Series) -> pd.Series:
        out = np.zeros(len(query), np.int64)
        known = (query.notna() & target.notna()).to_numpy()
        for text, rows in pd.Series(np.flatnonzero(known)).groupby(query[known].to_numpy()):
            codes = {i: alphabet.encode(target.iloc[i]) for i in rows}
            q, held = alphabet.encode(text), []
            for i in sorted(codes, key=lambda i: len(codes[i])):
                if len(codes[i]) > TILE:
                    out[i] = alignment.score_long([q], codes[i], table, gap_open, gap_extend, TILE)[0]
                    continue
                if held and (len(held) + 1) * len(codes[i]) > TILE:
                    out[held] = alignment.score_lanes(q, alignment.lanes_of([codes[k] for k in held]), table, gap_open, gap_extend)
                    held = []
                held.append(i)
            if held:
                out[held] = alignment.score_lanes(q, alignment.lanes_of([codes[k] for k in held]), table, gap_open, gap_extend)
        return pd.Series(out).astype("Int32").where(pd.Series(known))

    return F.pandas_udf(score, "int")


class BestHits:
    """The first `top` rows of each partition of an ordered table `query_no, input_pos, length, score`, with their rank."""

    def __init__(self):
        self.rank = 0

    def eval(self, row, top):
        from pyspark.sql.functions import SkipRestOfInputTableException

        if self.rank >= top:
            raise SkipRestOfInputTableException("the best are known")
        self.rank += 1
        yield row["query_no"], row["input_pos"], row["length"], row["score"], self.rank


def register(spark: SparkSession, name: str = "sw_score", matrix: str = matrices.DEFAULT, gap_open: int = 10, gap_extend: int = 2) -> None:
    """Make `name(query, target)` and the table function `best_hits(TABLE ..., top)` known to the session."""
    spark.udf.register(name, scorer(matrix, gap_open, gap_extend))
    spark.udtf.register("best_hits", F.udtf(BestHits, returnType="query_no long, input_pos long, length int, score int, rank int"))
