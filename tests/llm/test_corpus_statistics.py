"""Radix ranks, importance resampling, token blocks, automata, phrases and the recurrent network against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from proteinscan.llm import blocks, collocations, importance, lm, radix, recurrent
from proteinscan.llm.transducers import Trie, from_bytes, to_bytes, union
from tests.llm.conftest import documents, words


def test_radix_ranks(spark):
    """Ties, negative keys and the ends of the range, in several blocks; equal keys keep their order."""
    rng = random.Random(1)
    keys = [(rng.choice((-(2**63), -5, 0, 7, 2**63 - 1, rng.randrange(-(10**6), 10**6))), rng.choice((3, -1, 2**40))) for _ in range(300)]
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "row long, a long, b long").coalesce(2)
    for digit_bits, block_bits in ((11, 18), (4, 5)):
        found = radix.ranked(rows, ["a", "b"], digit_bits, block_bits).orderBy("position").collect()
        assert [r["position"] for r in found] == list(range(300)) and [(r["a"], r["b"], r["row"]) for r in found] == sorted((*k, i) for i, k in enumerate(keys))
    assert radix.ranked(rows.where("false"), ["a"]).count() == 0
    same = radix.ranked(rows.select("row", F.lit(4).cast("long").alias("a")), ["a"]).collect()
    assert sorted(r["position"] for r in same) == list(range(300))
    assert radix.digits_between(0, 0) == [] and radix.digits_between(-1, 0, 16) == [0, 16, 32, 48]


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_equals_brute_force(spark, texts, none, longest):
    target = ["abc dee ABC 12", None, "", texts[10][:300], "é dee-dee"]
    rows = [*texts, "É abc" * 30, "x1_y2 " * 40]
    found = importance.resample(documents(spark, rows), documents(spark, target), buckets=50, longest=longest, least_words=5, percent=30).collect()

    def features(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        own = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lowered)
        runs = [" ".join(own[i : i + n]) for n in range(1, longest + 1) for i in range(len(own) - n + 1)]
        return len(own), [zlib.crc32(r.encode()) % 50 for r in runs]

    s, t = (Counter(b for x in side for b in features(x)[1]) for side in (rows, target))
    s_all, t_all = s.total() + 50, t.total() + 50
    gain = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(50)]
    expected = {}
    for i, text in enumerate(rows):
        n, own = features(text)
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        expected[i] = [n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None]
    able = sorted((i for i, e in expected.items() if e[0] >= 5), key=lambda i: (-expected[i][3], i))
    for rank, i in enumerate(able[: len(able) * 30 // 100], 1):
        expected[i][4] = rank
    assert {r["doc_id"]: [r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in found} == expected
    assert importance.resample(none, documents(spark, target)).count() == 0
    assert importance.resample(documents(spark, rows), none).count() == len(rows)


def test_token_blocks(spark, texts, docs):
    """Codes and words of many small blocks give the tokens back; counts are those of the counted rows."""
    rows = docs.select("doc_id", (F.col("doc_id") % 3).cast("string").alias("label"), (F.col("doc_id") % 2 == 0).alias("counted"), "text")
    encoded = blocks.encode(rows, lm.tokens, 2000)
    names = {(r["block"], r["label"], r["number"]): bytes(r["word"]) for r in blocks.words_of(encoded).collect()}
    found = blocks.documents_of(encoded).collect()
    assert len({r["block"] for r in found}) > 5 and sorted(r["doc_id"] for r in found) == list(range(len(texts)))
    for r in found:
        assert [names[r["block"], r["label"], int(c)] for c in np.frombuffer(r["codes"], np.int32)] == lm.tokens((texts[r["doc_id"]] or "").encode())
    counts = {(r["label"], bytes(r["word"])): r["n"] for r in blocks.words_of(encoded).groupBy("label", "word").agg(F.sum("n").alias("n")).collect()}
    plain = Counter((str(i % 3), w) for i, t in enumerate(texts) if i % 2 == 0 for w in lm.tokens((t or "").encode()))
    assert {k: n for k, n in counts.items() if n} == plain


def runs(text, longest=3):
    out = Counter()
    for n in range(1, longest + 1):
        out.update(tuple(text[i : i + n]) for i in range(len(text) - n + 1) if all(text[i : i + n]))
    return out


def held(trie):
    return Counter({tuple(map(int, p)): int(w) for k, x in enumerate(trie.levels) for p, w in zip(zip(*trie.paths(k), strict=True), x.weight, strict=True)})


def test_automata():
    """Runs, bytes, union, pruning and composition against counters."""
    rng = random.Random(2)
    for _ in range(60):
        texts = [[rng.choice([0, 1, 2, 3, 5, 9, 10**10]) for _ in range(rng.randint(0, 60))] for _ in range(4)]
        tries = [Trie.of_text(np.array(t, np.int64), 3) for t in texts]
        for text, trie in zip(texts, tries, strict=True):
            assert held(trie) == runs(text) == held(from_bytes(to_bytes(trie)))
        total, both = sum(map(runs, texts), Counter()), union(tries)
        assert held(both) == total
        assert {k: n for k, n in held(both.at_least(3)).items() if len(k) > 1} == {k: n for k, n in total.items() if len(k) > 1 and n >= 3}
        asked = [(rng.choice([1, 2, 3, 7]), rng.choice([1, 2, 3, 5])) for _ in range(9)]
        assert both.compose([np.array(x) for x in zip(*asked, strict=True)]).tolist() == [total.get(x, 0) for x in asked]
    one = Trie.of_text(np.array([7] * 3000 + [0] + list(range(1, 2000))), 3)
    assert len(to_bytes(one)) < 40_000 < 16 * sum(len(x.word) for x in one.levels)  # equal states are one


def plain_phrases(rows, least, share, top):
    f = {}
    for text, lang in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", lowered):
            f.setdefault(lang or "und", Counter()).update(runs(re.findall("[^\\x20\\x09]+", piece)))
    out = []
    for lang, count in f.items():
        n, found = sum(c for p, c in count.items() if len(p) == 1), []
        phrases = {p: c for p, c in count.items() if len(p) > 1 and c >= least}
        for p, a in phrases.items():
            if any(p in (q[:2], q[1:]) and 100 * c >= share * a for q, c in phrases.items() if len(q) > len(p)):
                continue
            score, _, left, right = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n, -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def test_phrases_equal_brute_force(spark, none, monkeypatch):
    """In small ranges, with a word so frequent that it has several, ties, control characters and letters of all kinds."""
    rng = random.Random(4)
    for name, value in {"RANGE_WORDS": 300, "HELD_BYTES": 500}.items():
        monkeypatch.setattr(collocations, name, value)
    kinds = ["the", "of", "New", "york", "É", "a\x01", "b", "日本", "|", "x-y"]
    rows = []
    for i in range(160):
        own = [rng.choices(kinds, weights=[9, 5, 2, 2, 2, 1, 3, 2, 1, 1])[0] for _ in range(rng.randint(0, 40))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "!"]) for w in own) + "new york city" * (i % 3)
        rows.append((text, rng.choice(["en", "en", None, "de"])))
    rows += [(None, "en"), ("", None), *rows[:5]]
    table = spark.createDataFrame([(i, t, lang, 1) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, f long").repartition(5)
    found = collocations.collocations(table, least=4, share=50, top=40).collect()
    assert sorted(map(tuple, found)) == plain_phrases(rows, 4, 50, 40) and len(found) > 60
    assert collocations.collocations(none).count() == 0


SHAPE = recurrent.Shape(64, 5, 4)


def test_way_back_through_a_window_equals_single_steps():
    """Gradients by gates made for all steps of a window at once, against those made a step at a time."""
    rng = np.random.default_rng(9)
    steps, lanes, n = 7, 5, SHAPE.hidden
    model = recurrent.initial(SHAPE, np.ones(SHAPE.head + SHAPE.tail))
    before, keep = rng.integers(0, SHAPE.start + 1, (steps, lanes)), (rng.random((steps, lanes)) > 0.2).astype(np.float32)
    run = recurrent._Window(model, before, keep, rng.normal(0, 1, (lanes, n)).astype(np.float32))
    by_state = rng.normal(0, 1, (steps, lanes, n)).astype(np.float32)
    by_weights, fed = run.back(model, by_state, keep)
    expected, carried = np.zeros((n, 3 * n)), np.zeros((lanes, n))
    for t in reversed(range(steps)):
        held = run.states[t] * keep[t][:, None]
        across = held @ model["state"]
        z, r = np.split(1 / (1 + np.exp(-(across + model["inputs"][before[t]])[:, : 2 * n])), 2, axis=1)
        new = np.tanh(r * across[:, 2 * n :] + model["inputs"][before[t]][:, 2 * n :])
        assert np.allclose(run.states[t + 1], z * held + (1 - z) * new, atol=1e-5)
        carried = carried + by_state[t]
        d_new = carried * (1 - z) * (1 - new * new)
        gates = [carried * (held - new) * z * (1 - z), d_new * across[:, 2 * n :] * r * (1 - r)]
        assert np.allclose(fed[t], np.concatenate([*gates, d_new], axis=1), atol=1e-5)
        through = np.concatenate([*gates, d_new * r], axis=1)
        expected += held.T @ through
        carried = (carried * z + through @ model["state"].T) * keep[t][:, None]
    assert np.allclose(by_weights, expected, atol=1e-4)



def small_model():
    rng = np.random.default_rng(3)
    model = recurrent.initial(SHAPE, rng.integers(1, 50, SHAPE.head + SHAPE.tail))
    return {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in model.items()}


def plain_log(model, ids, before=SHAPE.start):
    """Natural log probability of ids, one at a time."""
    n, total, h = SHAPE.hidden, 0.0, np.zeros(SHAPE.hidden)
    for i in ids:
        x, a = model["inputs"][before].astype(float), h @ model["state"]
        z, r = (1 / (1 + np.exp(-(x[s] + a[s]))) for s in (slice(0, n), slice(n, 2 * n)))
        new = np.tanh(x[2 * n :] + r * a[2 * n :])
        h = z * h + (1 - z) * new
        classes = np.exp(h @ model["out"] + model["bias"])
        k = int(SHAPE.class_of(np.array([i]))[0])
        total += math.log(classes[k] / classes.sum())
        if i < SHAPE.head:
            own = np.exp(h @ model["words"][k] + model["word_bias"][k])
            total += math.log(own[i % recurrent.PER] / own.sum())
        before = i
    return total


def test_state_is_carried_over_windows_and_lanes():
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, SHAPE.head + SHAPE.tail, n).astype(np.uint16) for n in (0, 1, 3, 200, 37, 64, 500, *([9] * 40))]
    model = small_model()
    for window in (7, 32):
        found = recurrent.log_likelihoods(model, SHAPE, docs, window)
        assert np.allclose(found, [plain_log(model, d.tolist()) / math.log(10) for d in docs], rtol=1e-4)


def test_probabilities_add_up():
    model = small_model()
    ends = [math.exp(plain_log(model, [5, 66, i]) - plain_log(model, [5, 66])) for i in range(SHAPE.head + SHAPE.tail)]
    assert math.isclose(sum(ends), 1.0, rel_tol=1e-4)


def test_gradients_are_those_of_differences(monkeypatch):
    """One window over two lanes, one with a start inside it and one that ends early."""
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, SHAPE.head + SHAPE.tail, n).astype(np.uint16) for n in (6, 4, 7)]
    first = [SHAPE.start, 3, 66]
    model = small_model()
    got = {}
    monkeypatch.setattr(recurrent.Trainer, "_move", lambda self, name, rows, grad: got.setdefault(name, (rows, grad.copy())))
    recurrent.Trainer(SHAPE, model).fit(docs, first, 2, 16)

    def value(changed):
        return sum(plain_log(changed, d.tolist(), f) for d, f in zip(docs, first, strict=True)) / sum(map(len, docs))

    wide = {k: v.astype(np.float64) for k, v in model.items()}
    for name, (rows, grad) in got.items():
        full = np.zeros(model[name].shape)
        full[rows] = grad
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in full.shape) if rng.random() < 0.4 else np.unravel_index(rng.choice(np.argsort(-np.abs(full), axis=None)[:20]), full.shape)
            step = {k: v.copy() for k, v in wide.items()}
            step[name][at] += 1e-5
            back = {k: v.copy() for k, v in wide.items()}
            back[name][at] -= 1e-5
            assert math.isclose((value(step) - value(back)) / 2e-5, full[at], rel_tol=2e-2, abs_tol=2e-5), name


def test_training_learns_an_order():
    docs = [np.tile(np.arange(1, 9, dtype=np.uint16), 30) for _ in range(40)]
    model = recurrent.initial(SHAPE, np.bincount(np.concatenate(docs), minlength=SHAPE.head + SHAPE.tail))
    trainer = recurrent.Trainer(SHAPE, model)
    for _ in range(10):
        trainer.fit(docs, [SHAPE.start] * len(docs))
    before, after = (recurrent.log_likelihoods(m, SHAPE, docs[:1])[0] for m in (model, trainer.model))
    assert before < -200 and after > -40


def test_rounds_train_on_every_token_once():
    rng = np.random.default_rng(9)
    for size in (1, 2, 3, 47, 400, 5001):
        ids = rng.permutation(size).astype(np.uint16)
        parts = [lm._parts(ids, SHAPE.start, k, lm.ROUNDS) for k in range(lm.ROUNDS)]
        assert sorted(np.concatenate([p for p, _ in parts]).tolist()) == list(range(size))
        for part, before in parts:
            if len(part):
                at = int(np.flatnonzero(ids == part[0])[0])
                assert ids[at : at + len(part)].tolist() == part.tolist() and before == (int(ids[at - 1]) if at else SHAPE.start)


def test_lm_without_rows_to_learn_from(spark, docs, none):
    rows = lm.score_documents(docs, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0.0 and r["score"] < 0 for r in rows) and len(rows) == docs.count()
    assert lm.score_documents(none, F.lit(True)).count() == 0


def test_equal_texts_score_alike(spark):
    rng = random.Random(6)
    text = words(rng, 90)
    rows = spark.createDataFrame([(i, text if i % 7 == 0 else words(rng, 60)) for i in range(100)], "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["score"] for r in lm.score_documents(rows, F.col("doc_id") < 70).collect()}
    assert max(found[i] for i in range(0, 100, 7)) - min(found[i] for i in range(0, 100, 7)) < 1e-3
