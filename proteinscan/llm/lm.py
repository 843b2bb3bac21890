"""Language-model scores of whole documents by a gated recurrent network over the corpus's own words.

Words and their counts are gathered from all documents that may be learned from, without a bound
on their number. The most frequent words are words of their own to the network; every other word
belongs to a class by its last letters, inside which the counts decide (Witten-Bell: a class gives
its unseen words as much as it has different words). So P(token) = P(class | state) P(word | class).
All unseen words of a class are one event, as all unseen words are one in the unigram base.

Training is truncated backpropagation in the tasks that hold the documents: a start on a bounded
sample, then rounds over parts of every document that make up the whole of it, each round's
weights averaged by tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proteinscan.llm import blocks, recurrent
from proteinscan.llm.common import slices, written
from proteinscan.llm.recurrent import Shape

#: Words of their own, classes of other words by their last LETTERS bytes, cells of the state.
HEAD, TAIL, HIDDEN, LETTERS = 1024, 32, 16, 2
#: Documents of the start, and tokens of each that it reads. It fixes where training begins; what follows reads all documents.
START_DOCS, START_TOKENS = 2000, 512
#: Lanes whose gradients make one step of training: of the start and of a round.
START_LANES, ROUND_LANES = 64, 128
#: Rounds of training, each on a part of every document; together they read every token once.
ROUNDS = 3
#: Tokens that run side by side: of a task that scores, and of a step of training.
CHUNK = 1 << 21
FIT_CHUNK = 1 << 19
#: Weights in a row that goes to the average.
PART = 4096
#: Follows the words of every document; no word holds a line break.
END = b"\n"


def tokens(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8, A to Z in lower case, cut at ASCII white space, then the end."""
    found = text.lower().split()
    found.append(END)
    return found


def tail_class(word: Column) -> Column:
    """Class of a word that is none of the most frequent ones."""
    ending = F.substring(word, -LETTERS, LETTERS)
    return (F.crc32(ending) % F.lit(TAIL)).cast("int")


class Vocabulary:
    """Counts of the words to learn from: `word, c, own` (own: number of a most frequent word), and sums over them."""

    def __init__(self, words: DataFrame):
        counts = written(words.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "words")
        sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        self.tokens, self.types = sums["n"], sums["v"]
        head = counts.orderBy(F.desc("c"), "word").limit(HEAD).collect()  # HEAD rows at most
        own = counts.sparkSession.createDataFrame([(bytes(r["word"]), i) for i, r in enumerate(head)], "word binary, own int")
        self.counts = counts.join(F.broadcast(own), "word", "left")
        tail = self.counts.where("own IS NULL").groupBy(tail_class(F.col("word")).alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # TAIL rows
        self.frequencies, self.tail_types = np.zeros(HEAD + TAIL, np.int64), np.zeros(TAIL, np.int64)
        self.frequencies[: len(head)] = [r["c"] for r in head]
        for r in tail:
            self.frequencies[HEAD + r["k"]], self.tail_types[r["k"]] = r["c"], r["v"]


RESOLVED = "doc_id long, counted boolean, n_tokens long, n_known long, base_score double, tail_score double, ids binary"


def resolved(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Documents as ids of the network, two bytes each, with what counts alone decide: a row each.

    The counts of a block's words are joined by word, then meet the block's documents.
    """
    n, v, tail_tokens, tail_types = vocabulary.tokens, vocabulary.types, vocabulary.frequencies[HEAD:], vocabulary.tail_types

    def resolve(documents, words):
        c = np.zeros(words.num_rows + 1, np.int64)
        ids = np.zeros(words.num_rows + 1, np.uint16)
        number = words.column("number").to_numpy()
        c[number], ids[number] = words.column("c").to_numpy(), words.column("id").to_numpy()
        base = np.log10((c + 1.0) / (n + v + 1.0))
        kind = np.maximum(ids.astype(np.int64) - HEAD, 0)
        inside = np.where(c > 0, c, tail_types[kind]) / np.maximum(1, tail_tokens + tail_types)[kind]
        inside[(ids < HEAD) | (inside <= 0)] = 1.0
        inside = np.log10(inside)
        out: list[tuple] = []
        for codes in blocks.cells(documents.column("codes")):
            out.append((len(codes), int((c[codes] > 0).sum()), float(base[codes].sum()), float(inside[codes].sum()), ids[codes].tobytes()))
        types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
        columns = [pa.array(list(x), t) for x, t in zip(zip(*out) if out else [[]] * 5, types, strict=True)]
        return pa.table([documents.column("doc_id"), documents.column("counted"), *columns], names=[f.split()[0] for f in RESOLVED.split(", ")])

    words = blocks.words_of(encoded).join(vocabulary.counts, "word", "left")
    words = words.select("block", "number", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("own", HEAD + tail_class(F.col("word"))).cast("int").alias("id"))
    documents = blocks.documents_of(encoded).select("block", "doc_id", "counted", "codes")
    return written(documents.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(resolve, RESOLVED), "resolved")


def _parts(ids: np.ndarray, start: int, round_: int, rounds: int) -> tuple[np.ndarray, int]:
    """The part of a document that a round reads, and the id before it.

    The parts of all rounds are the whole document, each token once. Which part comes first is told by the ids.
    """
    k = (round_ + int(ids[: 1 << 12].astype(np.int64).sum())) % rounds
    at, end = len(ids) * k // rounds, len(ids) * (k + 1) // rounds
    return ids[at:end], (int(ids[at - 1]) if at else start)


def _documents(batches, most: int):
    """Lists of (ids, row in batch, batch) of at most about `most` tokens, in the order of reading."""
    for batch in slices(batches, 4096):
        held, size = [], 0
        for i, ids in enumerate(batch.column("ids").to_pylist()):
            held.append((np.frombuffer(ids, np.uint16), i))
            size += len(ids) // 2
            if size >= most:
                yield batch, held
                held, size = [], 0
        if held:
            yield batch, held


def _flat(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in model.values()])


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, v in like.items():
        out[name], at = flat[at : at + v.size].reshape(v.shape), at + v.size
    return out


SENT = "part int, tokens long, weights binary"


def _sent(trainer: recurrent.Trainer):
    """Weights, then sums of squared gradients, in rows of PART, with the tokens that they come from."""
    flat = np.concatenate([_flat(trainer.model), _flat(trainer.sums)]).astype(np.float32)
    parts = [flat[at : at + PART].tobytes() for at in range(0, len(flat), PART)]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([trainer.tokens] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["part", "tokens", "weights"])


def averaged(sent: DataFrame, like: dict[str, np.ndarray]) -> tuple[dict, dict] | None:
    """Weights and sums, averaged over tasks by tokens; each part is averaged in a task of its own. None if nothing was sent."""

    def mean(key, group):
        tokens = group.column("tokens").to_numpy().astype(np.float64)
        total = sum(t * np.frombuffer(w.as_py(), np.float32) for t, w in zip(tokens, group.column("weights"), strict=True))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "weights": pa.array([(total / tokens.sum()).astype(np.float32).tobytes()], pa.binary())})

    rows = sorted(sent.where("tokens > 0").groupBy("part").applyInArrow(mean, "part int, weights binary").collect())  # the weights, once
    if not rows:
        return None
    flat = np.frombuffer(b"".join(bytes(r["weights"]) for r in rows), np.float32)
    return _shaped(flat[: len(flat) // 2], like), _shaped(flat[len(flat) // 2 :], like)


def fit(documents: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> tuple[dict[str, np.ndarray], Shape]:
    """Weights of the network, from the rows of `resolved` that are counted; without any, those that counts give."""
    shape = Shape(HEAD, TAIL, HIDDEN)
    model = recurrent.initial(shape, vocabulary.frequencies)
    learned = documents.where("counted")

    def begin(batches):
        trainer = recurrent.Trainer(shape, model)
        for _, held in _documents(batches, FIT_CHUNK):
            trainer.fit([ids[:START_TOKENS] for ids, _ in held], [shape.start] * len(held), START_LANES)
        yield from _sent(trainer)

    sample = learned.select("ids", F.xxhash64("doc_id", "n_tokens").alias("h")).orderBy("h").limit(START_DOCS).select("ids")
    found = averaged(sample.coalesce(1).mapInArrow(begin, SENT), model)
    for k in range(rounds if found else 0):
        now, sums = found

        def go_on(batches, now=now, sums=sums, k=k):
            trainer = recurrent.Trainer(shape, now, sums)
            for _, held in _documents(batches, CHUNK):
                parts = [_parts(ids, shape.start, k, rounds) for ids, _ in held]
                trainer.fit([p for p, _ in parts], [first for _, first in parts], ROUND_LANES)
            yield from _sent(trainer)

        found = averaged(learned.select("ids").mapInArrow(go_on, SENT), model) or found
    return (found[0] if found else model), shape


def score_documents(docs: DataFrame, counted: Column) -> DataFrame:
    """`doc_id, counted, n_tokens, n_known, train_tokens, base_score, score` of every row of `docs`.

    The rows that `counted` marks (null: not) are learned from. Tokens are the words of the whole
    text, in lower case, and one end (null and empty texts: the end alone); known ones occur in
    counted texts, which have `train_tokens` tokens. `base_score` is their log10 probability by
    raised counts, `score` that of the network. Rows that repeat or lack a doc_id are scored like
    others and equal texts alike; without counted rows both scores come from the smoothing alone;
    an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", F.lit(None).cast("string").alias("label"), F.coalesce(counted, F.lit(False)).alias("counted"), "text")
    encoded = blocks.encode(rows, tokens)
    vocabulary = Vocabulary(blocks.words_of(encoded))
    documents = resolved(encoded, vocabulary)
    model, shape = fit(documents, vocabulary)
    n = vocabulary.tokens

    def score(batches):
        for batch, held in _documents(batches, CHUNK):
            part = batch.slice(held[0][1], len(held))
            found = recurrent.log_likelihoods(model, shape, [ids for ids, _ in held]) + part.column("tail_score").to_numpy()
            names = ["doc_id", "counted", "n_tokens", "n_known", "base_score"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(np.full(len(held), n, np.int64)), pa.array(found)], names=[*names, "train_tokens", "score"])

    return documents.mapInArrow(score, "doc_id long, counted boolean, n_tokens long, n_known long, base_score double, train_tokens long, score double")
