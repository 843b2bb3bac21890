"""Phrases whose words occur together more often than their parts let expect, by language.

Counts are weighted automata over word numbers. Each block of documents builds one from its sorted
runs of words, cut by the range of the first word; automata of a range are united, their weights
summed. Parts of phrases are looked up by composing them with the automaton of the range in which
they begin.

A phrase that occurs often enough has parts that do, so words that are rarer are breaks from the
start; that loses no phrase and no count of a part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proteinscan.llm import blocks
from proteinscan.llm.common import checked_broadcast, written
from proteinscan.llm.transducers import Trie, from_bytes, to_bytes, union
from proteinscan.operators.ranking import with_prefix

LONGEST, LEAST, SHARE, TOP = 3, 10, 50, 2000
UNKNOWN = "und"
#: Occurrences of the words in which phrases of a range begin; a more frequent word has ranges of its own, by the second word.
RANGE_WORDS = 1 << 22
#: Runs that a task gathers before it unites them with what it has.
HELD_BYTES = 16 << 20
SALTS = 64

_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_CUT = bytes.maketrans(_SEPARATORS, blocks.BREAK_TOKEN * len(_SEPARATORS))
_SPACED_BREAK = b" " + blocks.BREAK_TOKEN + b" "


def tokens(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8, A to Z in lower case, with a break where a piece ends."""
    return text.lower().translate(_CUT).replace(blocks.BREAK_TOKEN, _SPACED_BREAK).split()


def frequent_words(encoded: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """`label, word, f, id, range, splits` of words that occur `least` times, and `label, n` of every language.

    Ids count from 1 in the order of language and word, so words of a range are neighbours.
    """
    counts = blocks.words_of(encoded).groupBy("label", "word").agg(F.sum("n").alias("f"))
    counts = written(counts, "words")
    totals = counts.groupBy("label").agg(F.sum("f").alias("n"))
    placed = with_prefix(counts.where(F.col("f") >= least), ["label", "word"], "f")
    splits = F.ceil(F.col("f") / F.lit(RANGE_WORDS)).cast("int")
    placed = placed.select("label", "word", "f", F.col("position").alias("id"), F.floor(F.col("before") / RANGE_WORDS).alias("range"), splits.alias("splits"))
    return written(placed, "frequent"), totals


SHARD = "range long, sub int, automaton binary"


def shard_automata(encoded: DataFrame, words: DataFrame, longest: int) -> DataFrame:
    """The automata of each block's runs, one for each range."""

    def count(documents, vocabulary):
        number = vocabulary.column("number").to_numpy()
        ids, ranges, splits = (np.zeros(int(number.max(initial=0)) + 1, np.int64) for _ in range(3))
        for column, into in (("id", ids), ("range", ranges), ("splits", splits)):
            into[number] = vocabulary.column(column).to_numpy()
        order = np.argsort(ids, kind="stable")
        pause = np.zeros(1, np.int64)
        held = [ids[np.where(codes < len(ids), codes, 0)] for codes in blocks.cells(documents.column("codes"))]
        trie = Trie.of_text(np.concatenate([x for h in held for x in (h, pause)]) if held else pause, longest)
        first, second = trie.paths(1)
        known = order[np.searchsorted(ids[order], first)] if len(first) else np.zeros(0, np.int64)
        place, sub = ranges[known], second % np.maximum(1, splits[known])
        out = []
        for r, s in sorted(set(zip(place.tolist(), sub.tolist(), strict=True))):
            out.append((r, s, to_bytes(trie.select(1, (place == r) & (sub == s)))))
        return pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["range", "sub", "automaton"])

    vocabulary = blocks.words_of(encoded).select("block", "label", "word", "number").join(words.select("label", "word", "id", "range", "splits"), ["label", "word"])
    documents = blocks.documents_of(encoded).select("block", "codes")
    return documents.groupBy("block").cogroup(vocabulary.select("block", "number", "id", "range", "splits").groupBy("block")).applyInArrow(count, SHARD)


def united(shards: DataFrame, least: int) -> DataFrame:
    """One automaton for each range, of the runs that occur `least` times."""

    def groups(batches):
        key, held = None, []
        for batch in batches:
            for r, s, data in zip(*(batch.column(c).to_pylist() for c in ("range", "sub", "automaton")), strict=True):
                if (r, s) != key:
                    if held:
                        yield key, union([from_bytes(d) if isinstance(d, bytes) else d for d in held])
                    key, held, size = (r, s), [], 0
                held.append(data)
                size += len(data)
                if size > HELD_BYTES:
                    held, size = [union([from_bytes(d) if isinstance(d, bytes) else d for d in held])], 0
        if held:
            yield key, union([from_bytes(d) if isinstance(d, bytes) else d for d in held])

    def unite(batches):
        for (r, s), trie in groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64()), pa.array([s], pa.int32()), pa.array([to_bytes(trie.at_least(least))], pa.binary())], names=["range", "sub", "automaton"])

    dealt = shards.repartition("range", "sub").sortWithinPartitions("range", "sub")
    return written(dealt.mapInArrow(unite, SHARD), "automata")


#: Words as ids, the last one apart; `f_head` is the count without the last word, `f_rest` without the first, `longer` the largest count of a longer phrase around it.
PHRASE = "w0 long, w1 long, w2 long, last long, f long, f_head long, f_rest long, longer long"


def _long_phrases(automata: DataFrame) -> DataFrame:
    """Phrases of three words with the word at which their rest begins."""

    def explode(batches):
        for batch in batches:
            for data in batch.column("automaton").to_pylist():
                trie = from_bytes(data)
                deep = trie.levels[2]
                yield pa.RecordBatch.from_arrays([*map(pa.array, trie.paths(2)), pa.array(deep.weight), pa.array(trie.levels[1].weight[deep.parent])], names=["w0", "w1", "w2", "f", "f_head"])

    return automata.mapInArrow(explode, "w0 long, w1 long, w2 long, f long, f_head long")


def with_parts(automata: DataFrame, words: DataFrame) -> DataFrame:
    """All phrases of two and three words with the counts of the parts that are runs of two, as PHRASE."""
    names = [f.split()[0] for f in PHRASE.split(", ")]

    def compose(automaton, wanted):
        trie = from_bytes(automaton.column("automaton")[0].as_py()) if automaton.num_rows else None
        w0, w1, w2, f, f_head = (wanted.column(c).to_numpy() for c in ("w0", "w1", "w2", "f", "f_head"))
        row = trie.find([w1, w2]) if trie and len(w1) else np.full(len(w1), -1)
        f_rest = trie.levels[1].weight[row] if len(w1) else np.zeros(0, np.int64)
        columns = [[w0, w1, w2, w2, f, f_head, f_rest, np.zeros(len(f), np.int64)]]
        if trie:
            two, three = trie.levels[1], trie.levels[2]
            longer = np.zeros(len(two.word), np.int64)
            np.maximum.at(longer, three.parent, three.weight)
            np.maximum.at(longer, row, f)
            a, b = trie.paths(1)
            nothing = np.zeros(len(a), np.int64)
            columns.append([a, b, nothing, b, two.weight, nothing, nothing, longer])
        return pa.table([np.concatenate(x).astype(np.int64) for x in zip(*columns, strict=True)], names=names)

    # A rest's count lies in the automaton of the range in which it begins.
    route = words.select(F.col("id").alias("w1"), "range", "splits")
    wanted = _long_phrases(automata).join(route, "w1").select("w0", "w1", "w2", "f", "f_head", "range", F.pmod("w2", "splits").cast("int").alias("sub"))
    here = automata.select(F.col("range").alias("range"), F.col("sub").alias("sub"), "automaton")
    return written(here.groupBy("range", "sub").cogroup(wanted.groupBy("range", "sub")).applyInArrow(compose, PHRASE), "phrases")


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame, share: int) -> DataFrame:
    """Phrases that no longer one holds `share` in a hundred of, as `lang, phrase, a, l, r, n, score`."""
    kept = phrases.where(100 * F.col("longer") < share * F.col("f"))
    for at, key in (("last", "last"), ("first", "w0"), ("middle", "w1")):
        known = words.select(F.col("id").alias(key), F.col("word").cast("string").alias(f"{at}_word"), F.col("f").alias(f"{at}_f"), *(["label"] if at == "first" else []))
        kept = kept.join(known, key)
    two = F.col("w2") == 0
    f = F.col("f")
    early = _score(f, F.col("first_f"), F.when(two, F.col("last_f")).otherwise(F.col("f_rest")))
    late = _score(f, F.when(two, F.lit(1)).otherwise(F.col("f_head")), F.col("last_f"))
    kept = kept.withColumn("early", early).withColumn("late", late).withColumn("first_cut", two | (F.col("early") <= F.col("late")))
    phrase = F.when(two, F.concat_ws(" ", "first_word", "last_word")).otherwise(F.concat_ws(" ", "first_word", "middle_word", "last_word"))
    left = F.when(F.col("first_cut"), F.col("first_f")).otherwise(F.col("f_head"))
    right = F.when(two | ~F.col("first_cut"), F.col("last_f")).otherwise(F.col("f_rest"))
    kept = kept.join(checked_broadcast(totals), "label")
    score = F.when(F.col("first_cut"), F.col("early")).otherwise(F.col("late"))
    return kept.select(F.col("label").alias("lang"), phrase.alias("phrase"), f.alias("a"), left.alias("l"), right.alias("r"), "n", score.alias("score"))


def _score(f: Column, left: Column, right: Column) -> Column:
    """floor(1000000 f f / (left right)) in whole numbers; 38 digits hold the product of counts up to 10**15."""
    count = "decimal(15,0)"
    square = F.lit(1_000_000).cast("decimal(7,0)") * f.cast(count) * f.cast(count)
    product = left.cast(count) * right.cast(count)
    return ((square - square % product) / product).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score`: the first `top` phrases of two and three words of each language.

    Candidates occur at least `least` times in the pieces of a language's texts; `a` counts a
    phrase, `l` and `r` its parts at the cut that scores lowest (of equal scores the first cut),
    `n` all words of the language. A candidate is left out if a longer one around it has `share` in
    a hundred of its count. Order: score, then `a`, both descending, then the phrase in byte order.
    Null languages count as `und`; null and empty texts have no words; repeated rows count as often
    as they occur, and ids play no part; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.lit(0).alias("doc_id"), F.coalesce("lang", F.lit(UNKNOWN)).alias("label"), F.lit(True).alias("counted"), "text")
    encoded = blocks.encode(rows, tokens)
    words, totals = frequent_words(encoded, least)
    automata = united(shard_automata(encoded, words, LONGEST), least)
    found = scored(with_parts(automata, words), words, totals, share)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # The best of each salt first, so that no task gets all phrases of a language.
    found = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
