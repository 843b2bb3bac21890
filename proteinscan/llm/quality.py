"""Quality by regularised quadratic discriminants over transformed document statistics."""

from __future__ import annotations

import dataclasses
import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proteinscan.llm.common import clean_labels, held_out, joined_by_hot_key, with_text_columns, written

SHRINKAGE = 0.1

STATISTICS = (
    "words", "word_length", "word_length_spread", "letter_share", "space_share", "symbol_share", "pipe_share", "digit_share",
    "stop_share", "distinct_share", "repeated_lines", "line_words", "capital_share", "edge_symbol_share",
)
_LETTER, _SPACE, _SYMBOL, _EDGE, _DIGIT, _PIPE, _CAPITAL = (1 << k for k in range(7))


@functools.cache
def _classes() -> np.ndarray:
    """What each code point is, as bits: an edge symbol is a symbol but no underscore."""
    out = np.zeros(0x110000, np.uint8)
    for code in range(len(out)):
        ch = chr(code)
        if ch.isspace():
            out[code] = _SPACE
        elif ch.isalnum():
            out[code] = _DIGIT if "0" <= ch <= "9" else 0 if ch.isdecimal() else _LETTER if "a" <= ch <= "z" else _LETTER | _CAPITAL
        elif ch == "_":
            out[code] = _SYMBOL
        elif ch not in ".,;:!?'\"()-":
            out[code] = _SYMBOL | _EDGE | (_PIPE if ch == "|" else 0)
    return out


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text, each through a log or a logit so that both tails count alike."""
    text = text or ""
    kinds = _classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    space = np.concatenate([[True], kinds & _SPACE > 0, [True]])
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:]) - 1
    n, chars = len(starts), max(1, len(text))
    lengths = ends - starts + 1 if n else np.zeros(1)
    lines = text.split("\n")

    def count(bit: int) -> int:
        return int(np.count_nonzero(kinds & bit))

    def logit(part: float, of: float) -> float:
        p = (part + 0.5) / (of + 1.0)
        return math.log(p / max(1e-9, 1 - p)) if p < 1 else 10.0

    capitals = int(np.count_nonzero(kinds[starts] & _CAPITAL))
    edges = int(np.count_nonzero((kinds[ends] & _EDGE > 0) & (lengths > 1))) if n else 0
    return [
        math.log1p(n), math.log1p(lengths.mean()), math.log1p(lengths.std()), logit(count(_LETTER), chars), logit(chars - lengths.sum() if n else 0, chars),
        logit(count(_SYMBOL), chars), logit(count(_PIPE), max(1, n)), logit(count(_DIGIT), chars), logit(int((lengths <= 3).sum()) if n else 0, max(1, n)),
        logit(len(set(text.split())), max(1, n)), logit(len(lines) - len(set(lines)), len(lines)), math.log1p(n / len(lines)), logit(capitals, max(1, n)), logit(edges, max(1, n)),
    ]


def solve_lower(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution y of `factor` y = b for a lower triangular factor, by forward substitution."""
    y = np.empty_like(b)
    for i in range(len(factor)):
        y[i] = (b[i] - factor[i, :i] @ y[:i]) / factor[i, i]
    return y


@dataclasses.dataclass(frozen=True)
class Discriminant:
    """Per class: log prior, mean, Cholesky factor of the shrunken covariance, its log determinant."""

    center: np.ndarray
    scale: np.ndarray
    priors: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1, from the difference of the Mahalanobis log densities.

        The factors are made once, when the model is fitted. The difference is divided by the
        number of statistics: these depend on each other, so densities overstate their evidence; a
        tempered difference keeps its sign and does not saturate.
        """
        if not len(self.priors):
            return np.full(len(x), 0.5)
        z = np.clip((x - self.center) / self.scale, -8, 8)
        log_density = []
        for prior, mean, factor, log_det in zip(self.priors, self.means, self.factors, self.log_dets, strict=True):
            y = solve_lower(factor, (z - mean).T)
            log_density.append(prior - 0.5 * (y * y).sum(axis=0) - 0.5 * log_det)
        return 1.0 / (1.0 + np.exp(-np.clip((log_density[1] - log_density[0]) / len(self.center), -30, 30)))


def fit_discriminant(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE) -> Discriminant:
    """From per-class counts, sums and sums of products. With a class missing, every score is 0.5."""
    d = len(STATISTICS)
    if set(moments) != {0, 1} or min(m[0] for m in moments.values()) < 2:
        empty = np.empty((0, d))
        return Discriminant(np.zeros(d), np.ones(d), np.empty(0), empty, np.empty((0, d, d)), np.empty(0))
    total = sum(m[0] for m in moments.values())
    center = sum(m[1] for m in moments.values()) / total
    second = sum(m[2] for m in moments.values()) / total
    scale = np.sqrt(np.maximum(np.diag(second) - center**2, 1e-6))
    priors, means, covariances = [], [], []
    for k in (0, 1):
        n, s, p = moments[k]
        mean = s / n
        covariances.append((p / n - np.outer(mean, mean)) / np.outer(scale, scale))
        means.append((mean - center) / scale)
        priors.append(np.log(n / total))
    pooled = sum(moments[k][0] * covariances[k] for k in (0, 1)) / total
    factors = []
    for c in covariances:
        shrunk = (1 - shrinkage) * c + 0.5 * shrinkage * pooled + (0.5 * shrinkage * np.trace(pooled) / d + 1e-3) * np.eye(d)
        factors.append(np.linalg.cholesky(shrunk))
    log_dets = [2 * np.log(np.diag(f)).sum() for f in factors]
    return Discriminant(center, scale, np.array(priors), np.array(means), np.array(factors), np.array(log_dets))


def fit(docs: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on all labelled documents that are not held out: sums of their statistics and of products of these."""
    known = clean_labels(labels, "quality").where(~held_out(F.col("doc_id"), 3, 1) & F.col("label").isin(0, 1))
    d = len(STATISTICS)

    def moments(frames):
        sums = {k: [0.0, np.zeros(d), np.zeros((d, d))] for k in (0, 1)}
        for frame in frames:
            for k, group in frame.groupby("label"):
                x = np.array([statistics(t) for t in group["text"]])
                sums[k][0] += len(x)
                sums[k][1] += x.sum(axis=0)
                sums[k][2] += x.T @ x
        yield pd.DataFrame({"label": list(sums), "n": [v[0] for v in sums.values()], "s": [v[1].tolist() for v in sums.values()], "p": [v[2].ravel().tolist() for v in sums.values()]})

    labelled = joined_by_hot_key(docs.select("doc_id", "text"), written(known, "known"), "doc_id", F.col("text")).select("label", "text")
    parts = labelled.mapInPandas(moments, "label int, n double, s array<double>, p array<double>")
    flat = parts.select("label", F.posexplode(F.concat(F.array("n"), "s", "p")).alias("at", "v"))
    sums: dict[int, np.ndarray] = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    for r in flat.groupBy("label", "at").agg(F.sum("v").alias("v")).collect():  # two rows a moment
        sums[r["label"]][r["at"]] = r["v"]
    return fit_discriminant({k: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in sums.items() if v[0]})


def score_quality(docs: DataFrame, model: Discriminant, keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with `score` (0 to 1) and `predicted`.

    Every row and whole text is scored, a null text like an empty one; with a class that has no
    labels every score is 0.5. Repeated rows score alike, ids may be null, columns that have the
    name of a new one are replaced; an empty table gives no rows.
    """

    def score(texts: list) -> tuple:
        x = np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS))
        scores = model.scores(x)
        return scores, (scores >= 0.5).astype(np.int32)

    return with_text_columns(docs, score, "score double, predicted int", keep)
