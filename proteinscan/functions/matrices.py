"""The substitution matrices."""

from __future__ import annotations

import functools
from importlib import resources

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from proteinscan.functions.alphabet import DUMMY, LETTERS, PADDING

MATRICES = ("blosum45", "blosum50", "blosum62", "blosum80", "blosum90", "pam30", "pam70", "pam250")
DEFAULT = "blosum62"


@functools.lru_cache(maxsize=None)
def load(name: str) -> np.ndarray:
    """Scores by code, 25 x 25; the dummy and the padding score 0 against everything."""
    if name not in MATRICES:
        raise ValueError(f"unknown matrix {name!r}: one of {', '.join(MATRICES)}")
    text = resources.files("proteinscan.functions").joinpath("matrices", f"{name}.txt").read_text()
    out = np.zeros((PADDING + 1, PADDING + 1), np.int32)
    for row, line in enumerate(x for x in text.splitlines()[2:] if x):
        values = [int(v) for v in line.split()[1:]]
        out[row, : row + 1] = out[: row + 1, row] = values
    return out


def as_rows(name: str) -> list[tuple[str, str, str, int]]:
    """(matrix, a, b, score) for all pairs of letters and the dummy `[`."""
    symbols, scores = LETTERS + "[", load(name)
    return [(name, a, b, int(scores[i, j])) for i, a in enumerate(symbols) for j, b in enumerate(symbols)]


def table(spark: SparkSession, names: tuple[str, ...] = MATRICES) -> DataFrame:
    return spark.createDataFrame([r for n in names for r in as_rows(n)], "matrix string, a string, b string, score int")


def literal(name: str) -> list[int]:
    """The 24 x 24 scores in row order, for use inside an expression."""
    return load(name)[: DUMMY + 1, : DUMMY + 1].ravel().tolist()
