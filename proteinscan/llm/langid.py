"""Language of a text: first its family, then one-versus-one linear machines inside the family."""

from __future__ import annotations

import dataclasses
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proteinscan.llm import minimise
from proteinscan.llm.common import held_out, slices, with_text_columns, written

#: Passes over all texts that the machines take at most, and the largest part of the gradient that ends them.
PASSES, TOLERANCE, PENALTY = 40, 1e-4, 1e-4
DIMENSIONS = 2048
UNDETERMINED = "und"

#: Families of ISO 639-1 codes. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es pt it ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn mr gu pa ne ur si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he am mt",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_ALPHA: np.ndarray | None = None


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang, lang)


def _letters() -> np.ndarray:
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)
    return _ALPHA


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Hashed 1- to 3-grams of each whole text's letters and word ends: square roots of shares."""
    out = np.zeros((len(texts), dimensions), np.float32)
    alpha = _letters()
    for row, text in enumerate(texts):
        codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
        if not len(codes):
            continue
        is_letter = alpha[codes]
        codes = np.where(is_letter, codes, 32).astype(np.uint32)
        # Runs of anything but letters count as one word end.
        keep = is_letter.copy()
        keep[0] = True
        keep[1:] |= is_letter[:-1]
        codes = np.concatenate([[32], codes[keep], [32]]).astype(np.uint32)
        two = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + codes[2:]
        grams = np.concatenate([codes * np.uint32(0xC2B2AE3D), two * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)])
        counts = np.bincount((grams >> np.uint32(7)) % np.uint32(dimensions), minlength=dimensions)
        out[row] = np.sqrt(counts / counts.sum())
    return out


def linear_machines(rows: DataFrame, codes: dict[str, int], pairs: list[tuple[set[str], set[str]]]) -> np.ndarray:
    """Weights (last: intercept) of squared-hinge linear machines, a column for each pair of sets of languages.

    `rows` have `code`, the number of the language, and `x`, features in 16 bits. A machine tells the
    texts of the first set from those of the second, which weigh alike together. All machines share
    their passes, in which every row is read.
    """
    sizes = np.zeros(len(codes))
    for r in rows.groupBy("code").agg(F.count("*").alias("n")).collect():  # a row for each language
        sizes[r["code"]] = r["n"]
    side, share = np.zeros((2, len(codes), len(pairs)), np.float32)
    for k, sets in enumerate(pairs):
        for names, sign in zip(sets, (1, -1), strict=True):
            own = [codes[n] for n in sorted(names)]
            side[own, k], share[own, k] = sign, 0.5 / max(1.0, sizes[own].sum())

    def evaluate(w):
        narrow = w.astype(np.float32)

        def add(batches, total):
            gradient = total[1:].reshape(w.shape)
            for batch in slices(batches, 512):
                x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float16).astype(np.float32).reshape(batch.num_rows, -1)
                code = batch.column("code").to_numpy()
                y = side[code]
                slack = np.maximum(np.float32(0), np.float32(1) - y * (x @ narrow[:-1] + narrow[-1]))
                weighted = share[code] * slack
                total[0] += float((weighted * slack).sum(dtype=np.float64))
                back = weighted * y
                gradient[:-1] -= 2 * (x.T @ back)
                gradient[-1] -= 2 * back.sum(axis=0)

        total = minimise.summed(rows, add, 1 + w.size)
        return total[0] + 0.5 * PENALTY * float((w * w).sum()), total[1:].reshape(w.shape) + PENALTY * w

    return minimise.minimum(evaluate, np.zeros((DIMENSIONS + 1, len(pairs))), PASSES, TOLERANCE).astype(np.float32)


@dataclasses.dataclass(frozen=True)
class Hierarchy:
    """Machines between families, and inside each family between its languages."""

    families: dict[str, list[str]]
    between: dict[tuple[str, str], np.ndarray]
    inside: dict[str, dict[tuple[str, str], np.ndarray]]

    @staticmethod
    def _vote(x: np.ndarray, names: list[str], machines: dict[tuple[str, str], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Winner of the votes, of ties the one with the larger margins, and its least probability."""
        rank = np.zeros((len(x), len(names)))
        least = np.ones((len(x), len(names)))
        at = {n: i for i, n in enumerate(names)}
        for (a, b), w in machines.items():
            margin = (x @ w[:-1] + w[-1]).astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(4 * margin, -30, 30)))
            rank[:, at[a]] += (margin > 0) + 1e-3 * np.tanh(margin)
            rank[:, at[b]] += (margin <= 0) - 1e-3 * np.tanh(margin)
            least[:, at[a]] = np.minimum(least[:, at[a]], p)
            least[:, at[b]] = np.minimum(least[:, at[b]], 1 - p)
        best = rank.argmax(axis=1)
        return best, least[np.arange(len(x)), best]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names = sorted(self.families)
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        rows = np.array([i for i, t in enumerate(texts) if has_letter(t)], dtype=int)
        if not len(rows) or not names:
            return langs, scores
        x = features([texts[i] for i in rows])
        family, sure = self._vote(x, names, self.between)
        for k, name in enumerate(names):
            mine = np.flatnonzero(family == k)
            if len(mine):
                best, inner = self._vote(x[mine], self.families[name], self.inside[name])
                for i, b, s in zip(rows[mine], best, np.minimum(inner, sure[mine]), strict=True):
                    langs[i], scores[i] = self.families[name][b], s
        return langs, scores


def fit(docs: DataFrame) -> Hierarchy:
    """Fit on all documents that have a language and a letter and are not held out, rows that share a doc_id too.

    There is a machine for each pair of families, and of languages in one.
    """
    known = docs.select("lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    codes = {r["lang"]: k for k, r in enumerate(known.select("lang").distinct().orderBy("lang").collect())}

    def describe(batches):
        for batch in slices(batches, 256):
            told = batch.filter(pa.array([has_letter(t) for t in batch.column("text").to_pylist()], pa.bool_()))
            x = [v.tobytes() for v in features(told.column("text").to_pylist()).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([pa.array([codes[v] for v in told.column("lang").to_pylist()], pa.int32()), pa.array(x, pa.binary())], names=["code", "x"])

    rows = written(known.mapInArrow(describe, "code int, x binary"), "grams")
    met = {r["code"] for r in rows.select("code").distinct().collect()}
    families: dict[str, list[str]] = {}
    for lang in sorted(n for n, k in codes.items() if k in met):
        families.setdefault(family_of(lang), []).append(lang)
    between = list(itertools.combinations(sorted(families), 2))
    inside = {f: list(itertools.combinations(names, 2)) for f, names in families.items()}
    pairs = [(set(families[a]), set(families[b])) for a, b in between] + [({a}, {b}) for own in inside.values() for a, b in own]
    machines = iter(linear_machines(rows, codes, pairs).T if pairs else ())
    return Hierarchy(families, {p: next(machines) for p in between}, {f: {p: next(machines) for p in own} for f, own in inside.items()})


def predict_language(docs: DataFrame, model: Hierarchy, keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with `lang_pred` and `lang_score`.

    Whole texts are read. A null text, or one without a letter, is `und` with score 0; so is every
    text if no language was learned. Repeated rows are judged alike, ids may be null, columns that
    have the name of a new one are replaced; an empty table gives no rows.
    """
    return with_text_columns(docs, model.predict, "lang_pred string, lang_score double", keep)
