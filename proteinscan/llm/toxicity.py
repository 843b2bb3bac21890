"""Toxicity by a noisy channel: obfuscated words are restored first, then the text is scored.

A word with digits, symbols, stretched or doubled letters, and a run of spaced-out letters, becomes
a lattice: each position may be read as a letter that it resembles, as noise to drop, or as a word
end. A Viterbi search under a character bigram model picks the reading. A word of plain letters has
one reading only, itself, so it skips the search. The restored text is scored by a regularised
logistic model over its words and their first letters, with evidence for both classes.

Words and runs of any length are decoded: of a letter repeated more than three times three are
kept, and what is longer than `PIECE` is decoded in overlapping pieces, of whose readings the inner
parts are joined. A plain letter has one reading, so a piece reads as the whole does if each of its
margins holds one.
"""

from __future__ import annotations

import dataclasses
import functools
import itertools
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proteinscan.llm import minimise
from proteinscan.llm.common import clean_labels, held_out, joined_by_hot_key, slices, with_text_columns, written
from proteinscan.operators.ranking import with_prefix

#: Features: words, and their first letters, which catch inflected stems.
PREFIXES = (4, 5, 6, 7)
#: A feature counts if the likelihood ratio of its class difference is at least this.
EVIDENCE = 8.0
#: Words that clearly mark the toxic class: log ratio, and evidence rare even as the best of all.
CLEAR_LOG_RATIO, CLEAR_EVIDENCE = 4.0, 10.0
PENALTY = 1e-3
#: Passes over the labelled documents that a logistic model takes at most, and the relative change that ends them.
PASSES, TOLERANCE = 100, 1e-6
#: Features that a task counts before it sends the counts.
COUNTED = 1 << 19
#: Log odds are counted in bins, so many to one, up to MOST_ODDS.
BINS, MOST_ODDS = 1024, 30
#: What a false alarm costs, beside a toxic text that is missed, as shares of their classes.
FALSE_ALARM = 5.0
#: Texts that are scored together, and tokens whose features a task remembers.
ROWS = 192
REMEMBERED, REMEMBERED_CHARS = 200_000, 4_000_000
#: Letters of the shortest spaced-out run that is read as a word.
LEAST_SPACED = 2

#: Letters that a character is written for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
_COST_LOOKALIKE, _COST_DROP_MARK, _COST_DROP_DIGIT, _COST_DROP_REPEAT, _COST_DROP_GAP, _COST_KEEP_EDGE, _COST_KEEP_INSIDE = 1.0, 2.5, 6.0, 0.2, 1.0, 0.5, 4.0
_LETTERS = 28  # 0: word end, 1 to 26: a to z, 27: any other letter

#: Characters of a token that are decoded at once, and those at each inner end that another piece decides.
PIECE, MARGIN = 120, 30

#: Single characters with gaps of one or two marks or spaces, or of more if an underscore is among
#: them. Each character has one way to match, so time follows the length of the text. A run follows
#: white space, where the search for it starts, so a text's first run needs some before it; two
#: characters then tell most words from a run.
_GAP = r"(?=[ ._*\-]{1,2}(?![ ._*\-])|[ .*\-]*_)[ ._*\-]++"
_ONE = r"(?:[^\W_]|[@$!|+])"
_SPACED = re.compile(rf"\s(?=[\w@$!|+][ ._*\-])((?:_[ ._*\-]++)?{_ONE}(?:{_GAP}{_ONE})+(?![^\W_]))")
_MARK = re.compile(r"[\w@$!|+]")
_LONG_STRETCH = re.compile(r"([^\W\d_])\1{3,}")
_STRETCHED = re.compile(r"([^\W\d_])\1\1|(?:([^\W\d_])\2[^\W\d_]?){3}")  # or three doubled letters
_DOUBLED = re.compile(r"(?:([^\W\d_])\1[^\W\d_]?){3}")
_EDGE = re.compile(r"^[^\w@$|+(€£¡*]+|[.,;:?!\"')\]}]+$|([$*|+(])\1\1+$")
_WORD = re.compile(r"[^\W\d_]+")
_MARKS = ".,;:?!\"')]}"


def _code(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27 if ch.isalpha() else 0


def features_of(word: str) -> list[str]:
    """A word and its stems: its first letters, marked by a star."""
    size = len(word)
    if size < PREFIXES[0]:
        return [word]
    return [word, *[word[:n] + "*" for n in PREFIXES if size >= n]]


def roots_of(features) -> frozenset[str]:
    """The first letters of words that may have some of the features; words with other first letters have none."""
    return frozenset(f[: PREFIXES[0]] for f in features)


@dataclasses.dataclass(frozen=True)
class ToxicityModel:
    """`weights` of features, the log odds of a text without any, and the character model."""

    weights: dict[str, float]
    intercept: float
    bigrams: np.ndarray
    #: What a task remembers of tokens, as one reads the same wherever it stands: features of those
    #: that have some, and all that it met.
    known: dict[str, set[str]] = dataclasses.field(default_factory=dict, repr=False, compare=False)
    met: set[str] = dataclasses.field(default_factory=set, repr=False, compare=False)
    #: Characters of the remembered tokens.
    held: list[int] = dataclasses.field(default_factory=lambda: [0], repr=False, compare=False)

    def __reduce__(self):
        return _model, ("\n".join(self.weights), np.array(list(self.weights.values())), self.intercept, self.bigrams)

    @functools.cached_property
    def roots(self) -> frozenset[str]:
        return roots_of(self.weights)

    def restore(self, text: str | None) -> str:
        return restore_all([text], self.bigrams)[0]

    def _features(self, words) -> set[str]:
        """Features of words that have a weight."""
        roots, first = self.roots, PREFIXES[0]
        return {f for word in words if word[:first] in roots for f in features_of(word) if f in self.weights}

    def found(self, texts: list[str | None]) -> list[set[str]]:
        """The distinct features of each restored text that have a weight."""
        lowered = [(t or "").lower() for t in texts]
        tokens = [set(t.split()) for t in lowered]
        new = set().union(*tokens) - self.met
        plain, reading = token_readings(new, self.bigrams)
        roots, first = self.roots, PREFIXES[0]
        for word, own in plain.items():
            if word[:first] in roots and (features := self._features((word,))):
                self.known.update(dict.fromkeys(own, features))
        for token, read in reading.items():
            if features := self._features(_WORD.findall(read)):
                self.known[token] = features
        self.met.update(new)
        known = self.known.keys()
        out = [set().union(*map(self.known.__getitem__, own & known)) for own in tokens]
        for own, runs in zip(out, run_readings(lowered, self.bigrams), strict=True):
            for run in runs:
                own.update(self._features(_WORD.findall(run)))
        self.held[0] += sum(map(len, new))
        if len(self.met) > REMEMBERED or self.held[0] > REMEMBERED_CHARS:
            self.held[0] = 0
            self.known.clear()
            self.met.clear()
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        odds = np.array([self.intercept + sum(self.weights[f] for f in sorted(own)) for own in self.found(texts)])
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _model(features: str, weights: np.ndarray, intercept: float, bigrams: np.ndarray) -> ToxicityModel:
    """A model from its features, one a line, and their weights: as whole arrays these are sent without an object for each."""
    return ToxicityModel(dict(zip(features.split("\n"), weights.tolist(), strict=True)) if len(weights) else {}, intercept, bigrams)


@functools.lru_cache(maxsize=64)
def _letter_span(token: str) -> tuple[int, int]:
    """Positions of the first and last letter; of a token without letters, its ends, crossed over."""
    first = next((i for i, ch in enumerate(token) if ch.isalpha()), len(token))
    return first, next((i for i in reversed(range(first, len(token))) if token[i].isalpha()), -1)


@functools.lru_cache(maxsize=4096)
def _readings(ch: str, inside: bool) -> list[tuple[int, str, float]]:
    """The readings of a character: code, letter and cost; an empty letter drops it."""
    if ch.isalpha():
        return [(_code(ch), ch, 0.0)]
    kept = (0, " ", 0.0 if ch in " ._-" else _COST_KEEP_INSIDE if inside else _COST_KEEP_EDGE)
    dropped = (-1, "", _COST_DROP_GAP if ch in " ._*-" else _COST_DROP_DIGIT if ch.isdigit() else _COST_DROP_MARK)
    return [kept, dropped, *((_code(x), x, _COST_LOOKALIKE) for x in LOOKALIKES.get(ch, ""))]


def _lattice(token: str, start: int, stop: int) -> list[list[tuple[int, str, float]]]:
    """The readings of each position of a part of a token."""
    first, last = _letter_span(token)
    out = [_readings(token[i], first < i < last) for i in range(start, stop)]
    doubled = _DOUBLED.search(token) is not None
    for i in range(start, stop):
        ch = token[i]
        if i and token[i - 1] == ch and (doubled or (i > 1 and token[i - 2] == ch) or token[i + 1 : i + 2] == ch) and ch.isalpha():
            out[i - start] = [*out[i - start], (-1, "", _COST_DROP_REPEAT)]
    return out


def _cuts(length: int) -> list[tuple[int, int, int, int]]:
    """Pieces of a token: start and stop of the piece, and of the part of it that is kept."""
    if length <= PIECE:
        return [(0, length, 0, length)]
    step = PIECE - 2 * MARGIN
    starts = range(0, length - 2 * MARGIN, step)
    return [(i, min(i + PIECE, length), i + MARGIN if i else 0, i + MARGIN + step if i + PIECE < length else length) for i in starts]


def viterbi(tokens: list[str], bigrams: np.ndarray) -> list[str]:
    """The likeliest reading of each token."""
    steps = bigrams.tolist()
    out = []
    for token in tokens:
        parts = [(_decode(_lattice(token, start, stop), steps)[lo - start : hi - start]) for start, stop, lo, hi in _cuts(len(token))]
        out.append("".join(x for part in parts for x in part))
    return out


def _decode(lattice: list[list[tuple[int, str, float]]], steps: list[list[float]]) -> list[str]:
    """What each position of a lattice reads as.

    The state is the last letter written, so a dropped character keeps every state, and a position
    of one reading leaves one. States are kept in order: of equally good ones the first is taken.
    """
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # value, and what was read, the last first
    for readings in lattice:
        now: dict[int, tuple[float, tuple | None]] = {}
        for code, letter, cost in readings:
            if code < 0:
                for state, (value, way) in states.items():
                    value -= cost
                    if state not in now or value > now[state][0]:
                        now[state] = value, (letter, way)
                continue
            best, taken = -math.inf, None
            for state, (value, way) in states.items():
                value += steps[state][code]
                if value > best:
                    best, taken = value, way
            best -= cost
            if code not in now or best > now[code][0]:
                now[code] = best, (letter, taken)
        states = dict(sorted(now.items())) if len(now) > 1 else now
    way = max(states.items(), key=lambda s: s[1][0] + steps[s[0]][0])[1][1]
    letters = []
    while way is not None:
        letter, way = way
        letters.append(letter)
    return letters[::-1]


def _suspect(word: str) -> bool:
    return not word.isalpha() and any(map(str.isalnum, word)) or _STRETCHED.search(word) is not None


def token_readings(tokens: set[str], bigrams: np.ndarray) -> tuple[dict[str, list[str]], dict[str, str]]:
    """Words that read as they are, with the tokens that hold them between marks, and readings of all other tokens."""
    plain: dict[str, list[str]] = {}  # words of letters only
    reading: dict[str, str] = {}
    core: dict[str, str] = {}  # of the tokens that may be obfuscated
    for token in tokens:
        word = token if token.isalpha() else token.strip(_MARKS)
        if word.isalpha():
            if word in plain:
                plain[word].append(token)
            else:
                plain[word] = [token]
        else:
            reading[token] = token
            word = _LONG_STRETCH.sub(r"\1\1\1", _EDGE.sub("", token))
            if len(word) > 1 and _suspect(word):
                core[token] = word
    joined, end = " ".join(plain), 0
    while found := _STRETCHED.search(joined, end):
        start, end = joined.rfind(" ", 0, found.start()) + 1, joined.find(" ", found.start())
        end = end if end >= 0 else len(joined)
        word = joined[start:end]
        core |= dict.fromkeys(plain.pop(word), _LONG_STRETCH.sub(r"\1\1\1", word))
    return plain, reading | _read(core, bigrams)


def _read(core: dict[str, str], bigrams: np.ndarray) -> dict[str, str]:
    wanted = sorted(set(core.values()))
    reading = dict(zip(wanted, viterbi(wanted, bigrams), strict=True))
    return {w: reading[c] for w, c in core.items()}


def run_readings(lowered: list[str], bigrams: np.ndarray) -> list[list[str]]:
    """Readings of the runs of spaced-out letters in each text."""
    spaced = [[r for r in _SPACED.findall(f" {t}") if len(_MARK.findall(r)) >= LEAST_SPACED] for t in lowered]
    reading = _read({r: r for runs in spaced for r in runs}, bigrams)
    return [[reading[r] for r in runs] for runs in spaced]


def restore_all(texts: list[str | None], bigrams: np.ndarray) -> list[str]:
    """Lower-cased texts with obfuscated words replaced by their readings.

    Readings of spaced-out letters are added at the end: word order does not enter the score.
    """
    lowered = [(t or "").lower() for t in texts]
    tokens = [t.split() for t in lowered]
    _, reading = token_readings(set().union(*tokens), bigrams)
    return [" ".join([*(reading.get(w, w) for w in own), *runs]) for own, runs in zip(tokens, run_readings(lowered, bigrams), strict=True)]


def _bigram_model(counts: np.ndarray) -> np.ndarray:
    smoothed = counts + 0.5
    return np.log(smoothed / smoothed.sum(axis=1, keepdims=True))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on all labelled documents that are not held out.

    The character model is that of their words, in which the clearly toxic words weigh as much as
    all others together. The texts are restored under it, and the logistic model is fitted to those
    features whose classes differ by more than EVIDENCE. Its score is 0.5 where halves of the
    documents, each scored by a model of the other half, are told apart best. Texts stay in the
    tasks: counts, gradients and the histogram of the odds are summed over all rows.
    """
    known = clean_labels(labels, "toxic").where(~held_out(F.col("doc_id"), 5, 0) & F.col("label").isin(0, 1))
    known = known.select("doc_id", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("h"))
    known = with_prefix(known, ["label", "h", "doc_id"], "label").select("doc_id", "label", (F.col("position") % 2).cast("int").alias("half"))
    texts = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    rows = written(joined_by_hot_key(texts, written(known, "known"), "doc_id", F.col("text")).select("label", "half", "text"), "labelled")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return ToxicityModel({}, -30.0, _bigram_model(np.zeros((_LETTERS, _LETTERS))))
    bigrams = _characters(rows, sizes)
    found = written(rows.mapInArrow(functools.partial(_restored, bigrams=bigrams), RESTORED), "restored")
    counted = found.where("feature IS NOT NULL").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    features = _in_order(_two_sided(counted, sizes))  # of the model

    def numbered(batches):
        number = {f: k for k, f in enumerate(features.to_pylist())}
        of: dict[str, list[int]] = {}
        first, roots = PREFIXES[0], roots_of(number)
        for batch in slices(batches, ROWS):
            own = []
            for words in batch.column("words").to_pylist():
                mine: set[int] = set()
                for word in [w for w in words.split() if w[:first] in roots]:
                    if (some := of.get(word)) is None:
                        some = of[word] = [number[f] for f in features_of(word) if f in number]
                    mine.update(some)
                own.append(np.array(sorted(mine), np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("half"), pa.array(own, pa.binary())], names=["label", "half", "features"])
            if len(of) > REMEMBERED:
                of.clear()

    rows = written(found.where("words IS NOT NULL").select("label", "half", "words").mapInArrow(numbered, "label int, half int, features binary"), "numbered")
    weights, intercepts = _fitted(rows, len(features))
    cut = _histogram_cut(rows, weights, intercepts)
    return ToxicityModel(dict(zip(features.to_pylist(), weights[2].tolist(), strict=True)), float(intercepts[2]) - cut, bigrams)


RESTORED = "label int, half int, words string, feature string, toxic long, n long"


def _restored(batches, bigrams: np.ndarray):
    """The distinct words of each restored text, and rows of features with the texts, and toxic ones, that have them."""
    kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
    names = [f.split()[0] for f in RESTORED.split(", ")]
    most = 1 + len(PREFIXES)

    def begin():
        """Numbers of words and of features, the words, the features of each (-1: no more), and the numbers of a token's words."""
        return defaultdict(itertools.count().__next__), defaultdict(itertools.count().__next__), [], np.empty((0, most), np.int64), {}

    word_number, numbers, spelled, table, words_of = begin()
    counts = np.zeros((2, 0), np.int64)
    held = 0  # characters of the remembered tokens

    def counted():
        columns = [list(numbers), counts[1], counts.sum(axis=0)]
        arrays = [pa.nulls(len(numbers), t) for t in kinds[:3]] + [pa.array(v, t) for v, t in zip(columns, kinds[3:], strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for batch in slices(batches, ROWS):
        texts, labels = [t.lower() for t in batch.column("text").to_pylist()], batch.column("label").to_numpy()
        tokens = [set(t.split()) for t in texts]
        new = set().union(*tokens) - words_of.keys()
        plain, reading = token_readings(new, bigrams)
        for word, own in plain.items():
            words_of.update(dict.fromkeys(own, (word_number[word],)))
        for token, read in reading.items():
            words_of[token] = tuple(map(word_number.__getitem__, _WORD.findall(read)))
        held += sum(map(len, new))
        rows = [
            set().union(*map(words_of.__getitem__, mine), *(map(word_number.__getitem__, _WORD.findall(r)) for r in runs))
            for mine, runs in zip(tokens, run_readings(texts, bigrams), strict=True)
        ]
        added = list(itertools.islice(word_number, len(spelled), None))
        spelled += added
        table = np.concatenate([table, np.full((len(added), most), -1)])
        for at, word in enumerate(added, len(table) - len(added)):
            own = features_of(word)
            table[at, : len(own)] = [numbers[f] for f in own]
        flat, at = _flat(rows)
        present = table[flat]
        pairs = (at[:, None] * len(numbers) + present)[present >= 0]
        row, feature = np.divmod(np.unique(pairs), max(1, len(numbers)))
        counts = np.pad(counts, ((0, 0), (0, len(numbers) - counts.shape[1])))
        for label in (0, 1):
            counts[label] += np.bincount(feature[labels[row] == label], minlength=len(numbers))
        columns = [batch.column("label"), batch.column("half"), pa.array([" ".join(map(spelled.__getitem__, sorted(own))) for own in rows], pa.string())]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(texts), t) for t in kinds[3:])], names=names)
        if len(words_of) > REMEMBERED or len(numbers) > COUNTED or held > REMEMBERED_CHARS:
            yield counted()
            word_number, numbers, spelled, table, words_of = begin()
            counts, held = np.zeros((2, 0), np.int64), 0
    yield counted()


def _characters(rows: DataFrame, sizes: dict[int, int]) -> np.ndarray:
    words = rows.select("label", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), F.lit(1)))).alias("word"))
    words = written(words.groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("toxic")), "words")
    counts, clear = _bigram_counts(words), _bigram_counts(_clear(words, sizes).withColumn("n", F.lit(1)))
    if clear.sum():
        counts += clear * (counts.sum() / clear.sum())
    return _bigram_model(counts)


def _bigram_counts(words: DataFrame) -> np.ndarray:
    """Pairs of characters in words that occur `n` times."""
    counts = np.zeros((_LETTERS, _LETTERS))
    padded = words.select(F.concat(F.lit(" "), F.regexp_replace("word", "[^a-z]", "~"), F.lit(" ")).alias("p"), "n")
    pairs = padded.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("p") - 1), lambda i: F.substring("p", i, F.lit(2)))).alias("pair"), "n")
    for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most 28 * 28 rows
        a, b = (0 if c == " " else 27 if c == "~" else _code(c) for c in r["pair"])
        counts[a, b] += r["n"]
    return counts


def _rates(sizes: dict[int, int]) -> tuple[Column, Column]:
    n1, n0 = sizes[1], sizes[0]
    return (F.col("toxic") + 0.5) / (n1 + 1.0), (F.col("n") - F.col("toxic") + 0.5) / (n0 + 1.0)


def _clear(counted: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Words that clearly mark the toxic class, from `toxic`, the toxic texts among their `n` ones."""
    toxic, harmless = _rates(sizes)
    counted = counted.where("toxic >= 3")
    evidence = 2 * F.col("toxic") * F.ln(F.col("toxic") / (F.col("n") * (sizes[1] / (sizes[1] + sizes[0]))))
    least = CLEAR_EVIDENCE + 2 * math.log(max(1, counted.count()))
    return counted.where((F.ln(toxic / harmless) >= CLEAR_LOG_RATIO) & (evidence >= least))


def _two_sided(counted: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Features whose share of toxic texts differs from that of the sample, either way."""
    share = sizes[1] / (sizes[1] + sizes[0])
    other = F.col("n") - F.col("toxic")

    def part(of: Column, expected: float) -> Column:
        return F.when(of > 0, of * F.ln(of / (F.col("n") * expected))).otherwise(F.lit(0.0))

    return counted.where((F.col("n") >= 3) & (2 * (part(F.col("toxic"), share) + part(other, 1 - share)) >= EVIDENCE)).select("feature")


def _in_order(found: DataFrame) -> pa.Array:
    """The features of a table by code point. The driver holds their letters and no object for each, while Spark fits the model."""
    features = found.toArrow()["feature"].combine_chunks()
    return features.take(pc.sort_indices(features))


def _cut(rows: list[list[int]], y: np.ndarray, width: int) -> float:
    """`_best_cut` of rows at hand, whose halves alternate in each class."""
    odds = np.empty(len(rows))
    half = np.where(y == 1, np.cumsum(y), np.cumsum(1 - y)) % 2  # of each class
    for own in (0, 1):
        fitted = np.flatnonzero(half == own)
        w, b = logistic([rows[i] for i in fitted], y[fitted], width)
        for i in np.flatnonzero(half != own):
            odds[i] = w[rows[i]].sum() + b
    return _best_cut(odds, y, 1 - y)


def _histogram_cut(rows: DataFrame, weights: np.ndarray, intercepts: np.ndarray) -> float:
    """`_best_cut` of all rows of a table, each scored by the model of the other half; odds are counted in bins."""
    bins = 2 * MOST_ODDS * BINS + 1

    def add(batches, total):
        counts = total.reshape(2, bins)
        for flat, at, y, half in _present(batches):
            odds = np.where(half == 0, np.bincount(at, weights[1][flat], len(y)) + intercepts[1], np.bincount(at, weights[0][flat], len(y)) + intercepts[0])
            place = np.rint((np.clip(odds, -MOST_ODDS, MOST_ODDS) + MOST_ODDS) * BINS).astype(np.int64)
            for label in (0, 1):
                counts[label] += np.bincount(place[y == label], minlength=bins)

    other, toxic = minimise.summed(rows, add, 2 * bins).reshape(2, bins)
    held = np.flatnonzero(other + toxic)
    return _best_cut(held / BINS - MOST_ODDS, toxic[held], other[held])


def _best_cut(odds: np.ndarray, toxic: np.ndarray, other: np.ndarray) -> float:
    """Log odds, under a model that has not seen the row, at which the classes are told apart best.

    Rows are counted by their odds. Best is the share of toxic rows above, less FALSE_ALARM times
    the share of others above; of cuts that are equally good, the one in the widest gap.
    """
    order = np.argsort(-odds, kind="stable")
    odds, toxic, other = odds[order], toxic[order], other[order]
    gain = np.cumsum(toxic) / max(1.0, toxic.sum()) - FALSE_ALARM * np.cumsum(other) / max(1.0, other.sum())
    gap = odds[:-1] - odds[1:]
    if not len(gap) or gap.max() <= 0:
        return 0.0
    gain = np.where(gap > 0, gain[:-1], -np.inf)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    at = best[gap[best].argmax()]
    return float(odds[at] + odds[at + 1]) / 2


def _loss(w: np.ndarray, flat: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic loss of weighted rows, and its gradient; `w` ends with the intercept."""
    odds = np.bincount(at, w[flat], minlength=len(y)) + w[-1]
    off = weight * (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y)
    return float(weight @ (np.logaddexp(0, odds) - y * odds)), np.append(np.bincount(flat, off[at], minlength=len(w) - 1), off.sum())


def _flat(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Features of rows one after another, and the row of each."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter((f for r in rows for f in r), np.int64, int(sizes.sum())), np.repeat(np.arange(len(rows)), sizes)


def _present(batches):
    """Features and rows, classes and halves of the batches of numbered rows."""
    for batch in slices(batches, 4096):
        own = [np.frombuffer(f, np.int32) for f in batch.column("features").to_pylist()]
        flat = np.concatenate(own).astype(np.int64) if own else np.empty(0, np.int64)
        yield flat, np.repeat(np.arange(len(own)), [len(f) for f in own]), batch.column("label").to_numpy().astype(float), batch.column("half").to_numpy()


def _fitted(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of logistic models of half 0, of half 1 and of all rows; without both classes a half tells nothing."""
    sizes = np.zeros((3, 2))
    for r in rows.groupBy("half", "label").agg(F.count("*").alias("n")).collect():  # at most 4 rows
        sizes[[r["half"], 2], r["label"]] += r["n"]
    weights, intercepts = np.zeros((3, width)), np.zeros(3)
    vector = F.udf(lambda f: Vectors.sparse(width, np.frombuffer(f, np.int32), np.ones(len(f) // 4)), VectorUDT(), useArrow=False)
    vectors = rows.select("half", F.col("label").cast("double").alias("label"), vector("features").alias("features"))
    vectors = written(vectors, "vectors")  # read in several passes of each model
    machine = LogisticRegression(regParam=PENALTY, standardization=False, maxIter=PASSES, tol=TOLERANCE, family="binomial")
    for k, own in enumerate((vectors.where("half = 0"), vectors.where("half = 1"), vectors)):
        if not sizes[k].all():
            continue
        if width:
            model = machine.fit(own)
            weights[k], intercepts[k] = model.coefficients.toArray(), model.intercept
        else:
            intercepts[k] = math.log(sizes[k, 1] / sizes[k, 0])
    return weights, intercepts


def _penalised(w: np.ndarray, value: float, gradient: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    gradient = gradient.copy()
    gradient[..., :-1] += penalty * w[..., :-1]
    return value + 0.5 * penalty * float((w[..., :-1] ** 2).sum()), gradient


def logistic(rows: list[list[int]], y: np.ndarray, width: int, steps: int = 400, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and intercept of a penalised logistic model over rows of present features that are at hand."""
    if not rows:
        return np.zeros(width), 0.0
    flat, at = _flat(rows)
    weight = np.full(len(rows), 1 / len(rows))
    w = minimise.minimum(lambda w: _penalised(w, *_loss(w, flat, at, y, weight), penalty), np.zeros(width + 1), steps, 1e-8)
    return w[:-1], float(w[-1])


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with `toxicity` (0 to 1) and `toxic`.

    Every row and whole text is scored, a null text like an empty one; without labels of both
    classes nothing is toxic. Repeated rows score alike, ids may be null, columns that have the name
    of a new one are replaced; an empty table gives no rows.
    """

    def score(texts: list) -> tuple:
        scores = model.scores(texts)
        return scores, (scores >= 0.5).astype(np.int32)

    return with_text_columns(docs, score, "toxicity double, toxic int", keep, ROWS)
