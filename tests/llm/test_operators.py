"""The operators on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables."""

import hashlib
import io
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from proteinscan.llm import common, components, langid, media, mixing, packing, quality, sharding, sketch, toxicity, warc
from proteinscan.llm.queries import QUERIES
from tests.llm.conftest import brute_components, documents, words

def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_packing(docs, texts):
    exact = tokenizer()
    rows = packing.pack(docs).collect()
    filled = Counter()
    for i, text in enumerate(texts):
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own[:-1])]).tolist() and sum(r["length"] for r in own) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids) for r in own)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert filled[r["sequence_id"]] == r["offset"]
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= 1024


def test_ids_are_those_of_the_tokenizer(spark):
    """Special tokens in a text, white space, marks and letters of all kinds, and all texts of the small table."""
    exact, encode = tokenizer(), packing.encoder(packing.Vocabulary())
    odd = ["<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> \n<|endoftext|><|endoftext|>", "<|endoftext|", "  x\t\n\r\n  y ", "naïve façade — 日本語 ١٢٣ 🙂🏽", "don't WE'LL I'M", "\x00\x7f\u200b\u0301", "１２３½²"]
    found = [r["text"] for r in common.table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    for text in [*odd, *(t or "" for t in found)]:
        assert encode(text) == exact.encode(text, add_special_tokens=False).ids, text[:80]


def test_packing_of_no_rows_and_repeated_rows(docs, none):
    assert packing.pack(none).count() == 0
    assert packing.pack(docs.union(docs)).count() == 2 * packing.pack(docs).count()


def test_shortest_pack_first_places_all():
    rng = random.Random(1)
    histogram = {n: rng.randint(1, 50) for n in range(1, 1025, 7)}
    placed, packs = Counter(), 0
    for pattern, count in packing.shortest_pack_first(histogram, 1024):
        assert sum(pattern) <= 1024
        packs += count
        for length in pattern:
            placed[length] += count
    assert placed == histogram and packs * 1024 <= 1.05 * sum(k * v for k, v in histogram.items())
    assert packing.shortest_pack_first({100: 25}, 1024) == [((100,) * 5, 1), ((100,) * 10, 2)]


@pytest.mark.parametrize("many", [10**6, 0])
def test_components(spark, monkeypatch, many):
    """Chains, a loop, a hub; also with hubs joined apart."""
    from proteinscan.llm import components as module

    monkeypatch.setattr(module, "MANY_EDGES", many)
    monkeypatch.setattr(module, "HUB_EDGES", 5)
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 50), (70, 70)] + [(i, 500) for i in range(100, 140)] + [(500, 400)]
    found = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, **{i: 100 for i in (*range(100, 140), 400, 500)}}


def test_mixing(spark, docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and rows[0].asDict().keys() >= {"size", "source_size", "target", "taken"}
    by_source = {}
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        by_source.setdefault(r["source"], [0, r["target"], r["source_size"]])[0] += r["taken"]
    assert all(abs(taken - target) <= 1 for taken, target, _ in by_source.values())
    assert math.isclose(sum(t for _, t, _ in by_source.values()), sum(r["size"] for r in rows))
    again = mixing.mix(docs.repartition(3)).collect()
    assert {(r["doc_id"], r["taken"]) for r in again} == {(r["doc_id"], r["taken"]) for r in rows}
    assert mixing.mix(none).count() == 0 and mixing.repeat_rows(none).count() == 0 and mixing.repeat_rows(docs).columns == docs.columns


def brute_mix(rows, quality_of):
    """Words taken of (doc_id, text, source), row by row."""
    sizes = [len((t or "").encode().split()) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for _, _, s in rows) else [])
    source_size = {n: sum(z for z, (_, _, s) in zip(sizes, rows, strict=True) if s == n) for n in names}
    weight = {n: k % 3 + 1 for k, n in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes)
    while free:
        level = left / sum(weight[n] for n in free)
        over = [n for n in free if level * weight[n] > 3 * source_size[n]]
        for n in over or list(free):
            target[n] = 3.0 * source_size[n] if over else level * weight[n]
            free.discard(n)
            left -= target[n]
    taken = [0] * len(rows)
    for n in names:
        mine = [i for i, r in enumerate(rows) if r[2] == n]
        epochs = int(target[n] // source_size[n]) if source_size[n] else 0
        rest = round(target[n] - epochs * source_size[n])

        def key(i):
            u = (int(hashlib.md5(str(rows[i][0]).encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            return -math.log(u) / max(mixing.LEAST_WEIGHT, round(quality_of[i], 4))

        for i in sorted(mine, key=key):
            part = min(sizes[i], rest) if epochs < 3 else 0
            taken[i], rest = epochs * sizes[i] + part, rest - part
    return {r[0]: (z, source_size[r[2]], round(target[r[2]], 6), t) for r, z, t in zip(rows, sizes, taken, strict=True)}


def test_op4_mixing_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = common.table(spark, sf_dir, "documents")
    model = quality.fit(docs, common.table(spark, sf_dir, "labels"))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    scores = model.scores(np.array([quality.statistics(t) for _, t, _ in rows]))
    assert len(set(scores.round(3))) > 10
    found = {r["doc_id"]: (r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in QUERIES["op4_mixing"](spark, sf_dir).collect()}
    assert found == brute_mix(rows, scores)


def test_mixing_of_rows_without_ids(spark):
    rows = [(None, "a b c", "x"), (None, "d e f", "x"), (1, "g h i", "x"), (1, "j k l m", "x"), (2, "", "x"), (3, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS times", "2 AS copy", "3 AS size", "4 AS `row`", "5 AS score")
    out = mixing.repeat_rows(docs).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out) == sorted((i or 0, t) for i, t, _ in rows if t)
    assert {(r["times"], r["copy"], r["size"], r["row"], r["score"]) for r in out} == {(1, 2, 3, 4, 5)}


def test_targets_stop_at_three_times_a_source(spark):
    texts = ["w " * 1000, "w " * 10, "w " * 10, None, ""]
    docs = documents(spark, texts, lambda i: ("a", "b", "c", None, "d")[i])
    targets = {r["source"]: r["target"] for r in mixing.mix(docs).collect()}
    assert targets == {"a": 960.0, "b": 30.0, "c": 30.0, None: 0.0, "d": 0.0}


def test_sharding(docs, texts, none):
    rows = sharding.shard(docs.union(docs), 5).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data))
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert {r["shard"] for r in rows} <= set(range(5)) and sharding.shard(none).count() == 0


def test_shards_are_balanced_despite_a_large_group(spark):
    rng = random.Random(2)
    docs = documents(spark, ["same text"] * 400 + [words(rng, 2) for _ in range(800)])
    total = Counter()
    for r in sharding.shard(docs, 6).collect():
        total[r["shard"]] += r["size"]
    assert max(total.values()) < 1.1 * min(total.values())


def test_fingerprints(docs, texts, none):
    rows = {r["doc_id"]: r for r in sketch.fingerprints(docs).collect()}
    ids = sorted(rows, reverse=True)
    for k, i in enumerate(ids):
        text, after = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        cut = len(text) // 3
        assert rows[i]["n_chars"] == len(text) and rows[i]["edited"] == text[: len(text) - cut] + after[:cut]
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    assert rows[6]["sketch"] == rows[7]["sketch"] and rows[0]["sketch"] == [] and len(rows[9]["sketch"]) > 1000
    assert rows[9]["near_edited"] > 0.95  # the next text is short, so the edited one is a part of this one
    assert 0.4 < rows[10]["near_edited"] < 0.9 and rows[7]["near_next"] == 1.0
    assert sketch.fingerprints(none).count() == 0
    one = sketch.fingerprints(docs.where("doc_id = 9")).first()
    assert one["near_next"] == 1.0


def test_likeness_is_read_from_sketches_alone(spark):
    """Short texts without a hash below the limit: alike if they are the same, and to nothing else."""
    def empty(text):
        hashes = [hashlib.md5(" ".join(text.split()[k : k + 5]).encode()).hexdigest() for k in range(max(1, len(text.split()) - 4))]
        return all(h[0] != "0" for h in hashes)

    a, b = [t for t in (f"these are six words of {k}" for k in range(40)) if empty(t)][:2]
    full = " ".join(f"w{k}" for k in range(200))
    rows = spark.createDataFrame([(4, a), (3, a), (2, b), (1, full)], "doc_id long, text string")
    near = {r["doc_id"]: r["near_next"] for r in sketch.fingerprints(rows).collect()}
    assert near == {4: 1.0, 3: 0.0, 2: 0.0, 1: 0.0}


LABELS = "doc_id long, quality int, toxic int"


def labelled(spark, n=240):
    """Prose, with pipes in every third text and insults in every fourth."""
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(n):
        own = words(rng, 60).split()
        if i % 4 == 0:
            own[::12] = ["idiot"] * len(own[::12])
        rows.append((i, (" | " if i % 3 == 0 else " ").join(own)))
        labels.append((i, int(i % 3 != 0), int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], LABELS)


def test_quality(spark):
    docs, labels = labelled(spark)
    out = quality.score_quality(docs, quality.fit(docs, labels)).collect()
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 != 0) for r in held]) > 0.97
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "x" * 200_000)], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in quality.score_quality(odd, quality.fit(docs, labels)).collect())
    assert {r["score"] for r in quality.score_quality(docs, quality.fit(docs, labels.where("false"))).collect()} == {0.5}


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    out = toxicity.score_toxicity(docs, model).collect()
    assert all(r["toxic"] == (r["doc_id"] % 4 == 0) for r in out)
    for text in ("You 1d10t", "iiidiooot!", "an i d i o t, really", "1di0t.", "iddiioott"):
        assert "idiot" in model.restore(text)
        assert model.scores([text])[0] > 0.5
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "x" * 200_000), (3, "$$$ 111 !!!")], "doc_id long, text string")
    assert {r["toxic"] for r in toxicity.score_toxicity(odd, model).collect()} == {0}
    assert toxicity.score_toxicity(docs, toxicity.fit(docs, labels.where("false"))).where("toxic = 1").count() == 0


def test_toxicity_of_long_and_gapped_obfuscations(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    spelled = "  ".join(" ".join(w) for w in words(random.Random(4), 30).split())
    many_marks = "i" + "*" * 45 + "diot"
    forms = ["i.d i.o t", "i. d. i. o. t", "i_d i_o t", "iii" + "d" * 50 + "iot", "i" * 90 + "d1ot!", f"{spelled}  i d i o t  {spelled}", many_marks]
    for text in forms:
        assert "idiot" in model.restore(text), text
        assert model.scores([text])[0] > 0.5, text
    assert model.scores([spelled, "_" * 500 + "a", "a " + "_" * 500 + "... b", "a." * 20_000])[0] < 0.5


def test_viterbi_equals_enumeration():
    rng = random.Random(11)
    bigrams = toxicity._bigram_model(np.array([[rng.random() * 9 for _ in range(28)] for _ in range(28)]))

    def value(path):
        last, total = 0, 0.0
        for code, _, cost in path:
            total -= cost
            if code >= 0:
                total, last = total + bigrams[last, code], code
        return total + bigrams[last, 0]

    tokens = ["1d10t", "aabbcc", "i.d-i", "s*u!d", "eee3e", "é1_a", *("".join(rng.choices("abe1034*.$!", k=rng.randint(1, 6))) for _ in range(60))]
    for token, reading in zip(tokens, toxicity.viterbi(tokens, bigrams), strict=True):
        paths = list(itertools.product(*toxicity._lattice(token, 0, len(token))))
        best = max(map(value, paths))
        assert reading in {"".join(letter for _, letter, _ in p) for p in paths if value(p) > best - 1e-9}, token


def test_logistic_model_is_at_its_optimum():
    rng = np.random.default_rng(2)
    rows = [sorted(set(rng.integers(0, 6, 3).tolist())) for _ in range(300)]
    y = np.array([float(0 in r or rng.random() < 0.2) for r in rows])
    w, b = toxicity.logistic(rows, y, 6, steps=20_000, penalty=0.01)
    x = np.array([[f in r for f in range(6)] for r in rows], float)
    off = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.abs(x.T @ off / 300 + 0.01 * w).max() < 1e-6 and abs(off.mean()) < 1e-6 and w[0] > max(w[1:])


def test_cut_lies_in_the_gap_between_the_classes():
    rng = np.random.default_rng(4)
    y = np.arange(200) % 4 == 0
    rows = [sorted({0, *rng.integers(1, 4, 2).tolist()}) if k else sorted(set(rng.integers(1, 6, 2).tolist())) for k in y]
    cut = toxicity._cut(rows, y.astype(float), 6)
    w, b = toxicity.logistic(rows, y.astype(float), 6)
    assert [w[r].sum() + b > cut for r in rows] == y.tolist()
    assert toxicity._cut([[], []], np.array([0.0, 1.0]), 0) == 0.0


def test_toxicity_forms_features_only_of_words_that_may_have_weights(monkeypatch):
    weights, real, asked = {"stupid": 2.0, "stup*": 1.0, "so": 0.5}, toxicity.features_of, []
    model = toxicity.ToxicityModel(weights, 0.0, toxicity._bigram_model(np.ones((28, 28))))
    monkeypatch.setattr(toxicity, "features_of", lambda word: (asked.append(word), real(word))[1])
    texts = ["So plain, stupidly said", "(stupid) sole words", "other words 12 a-b", "s t u p o r", None] * 2
    plain = [{f for w in re.findall(r"[^\W\d_]+", (t or "").lower()) for f in real(w) if f in weights} for t in texts]
    plain[3] = plain[8] = {"stup*"}
    monkeypatch.setattr(toxicity, "run_readings", lambda lowered, _: [["stupor"] if t.startswith("s t") else [] for t in lowered])
    assert model.found(texts) == plain
    assert set(asked) == {"so", "stupidly", "stupid", "stupor"}


def test_spaced_runs_begin_after_white_space_or_at_the_start():
    plain = re.compile(toxicity._SPACED.pattern.replace(r"\s(?=[\w@$!|+][ ._*\-])(", r"(?<!\S)(", 1))
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1$ ._*-\n\t\u00a0\u00e9") for _ in range(rng.randrange(30))) for _ in range(4000)]
    found = [toxicity._SPACED.findall(f" {t}") for t in texts]
    assert found == [plain.findall(t) for t in texts] and sum(map(len, found)) > 1000


def test_toxicity_is_fitted_on_every_labelled_row(spark):
    """Words that only all six of their texts together give enough evidence, in more texts than any sample held."""
    rng = random.Random(12)
    ids = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 5]
    marks = rng.sample(["".join(w) for w in itertools.product("bcdfgh", "aeiou", "klmnpqrstvwxyz")] + ["".join(w) for w in itertools.product("klmnp", "aeiou", "bcdfghjkqrst")], 700)
    rows = [(i, marks[k // 6], 1) for k, i in enumerate(ids[: 6 * len(marks)])] + [(i, "zz" + rng.choice("abc"), 0) for i in ids[6 * len(marks) : 12 * len(marks)]]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = toxicity.fit(table, table)
    assert len(rows) == 8400 and set(marks) <= model.weights.keys()
    assert min(model.weights[m] for m in marks) > 0 > model.weights["zza"]


def test_models_of_a_table_equal_those_of_rows_at_hand(spark):
    rng = np.random.default_rng(6)
    rows = [sorted(set(rng.integers(0, 9, 4).tolist())) for _ in range(400)]
    y = np.array([float(rng.random() < (0.8 if 0 in r else 0.1)) for r in rows])
    half = (np.where(y == 1, np.cumsum(y), np.cumsum(1 - y)) % 2).astype(int)
    table = spark.createDataFrame([(int(k), int(h), bytes(np.array(r, np.int32))) for r, k, h in zip(rows, y, half, strict=True)], "label int, half int, features binary").repartition(5)
    weights, intercepts = toxicity._fitted(table, 9)
    for k, own in enumerate((half == 0, half == 1, half >= 0)):
        w, b = toxicity.logistic([rows[i] for i in np.flatnonzero(own)], y[own], 9)
        assert np.abs(weights[k] - w).max() < 0.01 and abs(intercepts[k] - b) < 0.01
    assert abs(toxicity._histogram_cut(table, weights, intercepts) - toxicity._cut(rows, y, 9)) < 0.02


def test_decoding_in_pieces_equals_decoding_whole(monkeypatch):
    rng = random.Random(8)
    bigrams = toxicity._bigram_model(np.array([[rng.random() * 9 for _ in range(28)] for _ in range(28)]))
    tokens = ["".join(rng.choices("abcdefghij1034*. -", k=rng.randint(100, 900))) for _ in range(20)]
    cut = toxicity.viterbi(tokens, bigrams)
    monkeypatch.setattr(toxicity, "PIECE", 1000)
    assert cut == toxicity.viterbi(tokens, bigrams)


def test_language(spark):
    rng = random.Random(9)
    letters = {"en": "thewaornd", "de": "ißüchenst", "fr": "éèauxleoi", "es": "ñóciolasr"}
    rows = [(i, " ".join("".join(rng.choices(letters[g], k=5)) for _ in range(40)), g) for i, g in enumerate(list(letters) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.families == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert all(r["lang_pred"] == r["lang"] for r in langid.predict_language(docs, model).collect())
    odd = spark.createDataFrame([(1, None, None), (2, "", "x"), (3, "123 !?", "x"), (4, "ñ" * 100_000, "x")], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in langid.predict_language(odd, model).orderBy("doc_id").collect()] == ["und", "und", "und", "es"]
    assert {r["lang_pred"] for r in langid.predict_language(docs, langid.fit(docs.where("false"))).collect()} == {"und"}


def test_language_is_fitted_on_every_row(spark):
    """A form of a language that two of its 1300 texts have is learned, wherever their rows lie."""
    rng = random.Random(10)

    def text(letters):
        return " ".join("".join(rng.choices(letters, k=5)) for _ in range(8))

    ids = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 3 != 1][:2600]
    rows = [(i, text("thewaornd" if k % 2 else "üchenstiß"), "en" if k % 2 else "de") for k, i in enumerate(ids)]
    # The last ids by the hash, which no sample of the lowest ones reaches.
    late = sorted(ids, key=lambda i: rows[ids.index(i)][2])
    order = {r["doc_id"]: r["h"] for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").selectExpr("doc_id", "pmod(xxhash64(doc_id), 1073741824) AS h").collect()}
    for lang, letters in (("en", "кгдж"), ("de", "αβγδ")):
        own = sorted((i for i in late if rows[ids.index(i)][2] == lang), key=order.get)
        for i in own[-40:]:
            rows[ids.index(i)] = (i, text(letters), lang)
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))
    assert model.predict([text("кгдж") for _ in range(5)] + [text("αβγδ") for _ in range(5)])[0] == ["en"] * 5 + ["de"] * 5


def test_language_machines_are_at_their_optimum(spark):
    rng = np.random.default_rng(8)
    x = rng.random((90, langid.DIMENSIONS)).astype(np.float16)
    x[:, 3:] = 0
    code = np.arange(90) % 3
    x[code == 0, 0] += np.float16(0.5)
    table = spark.createDataFrame([(int(c), v.tobytes()) for c, v in zip(code, x, strict=True)], "code int, x binary").repartition(4)
    w = langid.linear_machines(table, {"a": 0, "b": 1, "c": 2}, [({"a"}, {"b", "c"}), ({"b"}, {"c"})]).astype(float)
    wide = np.hstack([x.astype(float), np.ones((90, 1))])
    for k, y in enumerate((np.where(code == 0, 1.0, -1.0), np.where(code == 1, 1.0, np.where(code == 2, -1.0, 0.0)))):
        share = np.where(y > 0, 0.5 / (y > 0).sum(), np.where(y < 0, 0.5 / (y < 0).sum(), 0))
        slack = np.maximum(0, 1 - y * (wide @ w[:, k]))
        assert np.abs(langid.PENALTY * w[:, k] - 2 * (share * slack * y) @ wide).max() < 1e-3


def test_quality_is_fitted_on_every_labelled_row(spark, monkeypatch):
    monkeypatch.setattr(quality, "fit_discriminant", lambda moments: {k: m[0] for k, m in moments.items()})
    ids = [i for i in range(70_000) if zlib.crc32(str(i).encode()) % 3 != 1][:41_000]
    table = spark.createDataFrame([(i, "a b", k % 2) for k, i in enumerate(ids)], "doc_id long, text string, quality int")
    assert quality.fit(table, table) == {0: 20_500, 1: 20_500}


def test_samples_are_bounded(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "int(id % 10 = 0) AS label")
    found = {r["label"]: r["count"] for r in common.bounded_sample(rows, "label", 100).groupBy("label").count().collect()}
    assert found == {0: 100, 1: 100}
    # Exactly the lowest hashes; a class under the bound is kept whole.
    many = spark.range(5000).selectExpr("id AS doc_id", "int(if(id < 30, 2, id % 2)) AS label")
    chosen = common.bounded_sample(many, "label", 100)
    assert {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()} == {0: 100, 1: 100, 2: 30}
    ranked = many.where("label = 1").orderBy(F.expr("pmod(xxhash64(doc_id), 1073741824)"), "doc_id").limit(100)
    assert sorted(r["doc_id"] for r in chosen.where("label = 1").collect()) == sorted(r["doc_id"] for r in ranked.collect())


def test_media(docs, texts, none):
    rows = {r["doc_id"]: r for r in media.media_columns(docs, keep_media=True).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        back = media.from_wav(bytes(rows[i]["media"]))
        assert back == media.padded(data) and len(back) % 576 == 0 and len(back) >= 576
        assert rows[i]["tail_crc32"] == zlib.crc32(back[-32:]) and rows[i]["n_bytes"] == len(data)
        times = [p["frame"] for p in rows[i]["pairs"]]
        assert times and times == sorted(times)
    assert rows[6]["pairs"] == rows[7]["pairs"] and rows[6]["pairs"] != rows[9]["pairs"]
    assert media.media_columns(none).count() == 0


def test_spectral_peak_of_a_tone():
    tone = (128 + 100 * np.sin(2 * np.pi * 50 * np.arange(media.FRAME * 4) / media.FRAME)).astype(np.uint8)
    pairs = media.spectral_pairs(tone.tobytes())
    assert {(50, 50)} == {(int(p[1]), int(p[2])) for p in pairs if 40 <= p[1] < 160}
    flat = media.spectral_pairs(bytes([128]) * media.FRAME * 4)
    assert len(flat) == 1 and flat[0, 3] == 0  # no bin of silence exceeds its band's mean


def brute_pairs(samples):
    """The same pairs from sums over every sample of every frame."""
    x = np.frombuffer(samples, np.uint8).astype(float) - 128
    x = np.pad(x, (0, max(0, media.FRAME - len(x))))
    k, t = np.arange(media.FRAME // 2 + 1)[:, None], np.arange(media.FRAME)
    wave = np.exp(-2j * np.pi * k * t / media.FRAME)
    power = np.array([np.abs(wave @ (x[s : s + media.FRAME] * np.hanning(media.FRAME))) for s in range(0, len(x) - media.FRAME + 1, media.HOP)])
    peaks = set()
    for low, high in media.BANDS:
        mean = power[:, low:high].mean()
        for f, row in enumerate(power):
            b = max(range(low, high), key=lambda i: row[i])
            if row[b] > mean and row[b] >= row[b - 1] and row[b] >= row[b + 1]:
                peaks.add((f, b, (low, high)))
    return sorted((f, b, c, g - f) for f, b, band in peaks for g, c, other in peaks if band == other and 1 <= g - f <= media.FAN_OUT)


def test_spectral_pairs_equal_brute_force():
    rng = random.Random(3)
    for n in (3, 5, 9):
        samples = media.padded(words(rng, 110 * n).encode()[: 576 * n])
        assert sorted(tuple(p) for p in media.spectral_pairs(samples).tolist()) == brute_pairs(samples)


def test_warc(spark, tmp_path):
    pages = [(1, "u1", "<p>a</p>"), (2, "u2", "<p>a</p>"), (3, None, None), (4, "u\r\n4", ""), (5, "u5", "é" * 70_000), (6, "u6", "<p>a</p>\r\n\r\n"), (None, "u7", "z")]
    docs = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, h string")
    archives = warc.write_archives(docs, str(tmp_path / "w"))
    rows = {r["page_id"]: r for r in warc.read_archives(archives, with_payload=True).collect()}
    assert len(rows) == len(pages) and {i: r["refers_to"] for i, r in rows.items() if r["record_type"] == "revisit"} == {1: 2, 3: 4}
    for page_id, _, html in pages:
        data = (html or "").encode()
        assert (rows[page_id]["payload_bytes"], rows[page_id]["payload_digest"]) == (len(data), warc.payload_digest(data))
        assert bytes(rows[page_id]["payload"]) == (b"" if rows[page_id]["record_type"] == "revisit" else data)
    assert warc.read_archives(warc.write_archives(docs.where("false"), str(tmp_path / "e"))).count() == 0


def test_warc_headers_and_ties(spark, tmp_path, monkeypatch):
    """Rows that repeat page_id and payload are responses with ids of their own; a large lookup is salted."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    pages = spark.createDataFrame([(1, "a", "x"), (3, "b", "x"), (3, "c", "x"), (3, "c", "x"), (4, "d", "y"), (4, "d", "z"), (None, "e", "x")], "page_id long, url string, html string")
    archives = warc.write_archives(pages, str(tmp_path / "w"), date="2020-02-02T00:00:00Z")
    heads = []
    for path in (tmp_path / "w").glob("*.gz"):
        with open(path, "rb") as stream:
            heads += [warc.parse_record(m)[0] for m in warc.members(stream)]
    assert len({h["warc-record-id"] for h in heads}) == 7 and {h["warc-date"] for h in heads} == {"2020-02-02T00:00:00Z"}
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert sorted(h["x-page-id"] for h in revisits) == ["", "1"] and all((h["warc-refers-to-target-uri"], h["x-refers-to-page-id"]) == ("c", "3") for h in revisits)
    assert warc.read_archives(archives).count() == 7


def test_warc_reader_refuses_broken_archives():
    page = {"page_id": 1, "url": "u", "html": "payload", "refers_to": None, "refers_to_url": None}
    whole = warc.record("<urn:uuid:1>", "2020-01-01T00:00:00Z", page) + warc.record("<urn:uuid:2>", "2020-01-01T00:00:00Z", page | {"refers_to": 1, "refers_to_url": "u"})
    assert [warc.parse_record(m)[0]["warc-type"] for m in warc.members(io.BytesIO(whole), 7)] == ["response", "revisit"]
    with pytest.raises(EOFError):
        list(warc.members(io.BytesIO(whole[:-9])))
    raw = next(warc.members(io.BytesIO(whole)))
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(raw.replace(b"payload\r\n", b"payloaf\r\n"))
    with pytest.raises(ValueError, match="length"):
        warc.parse_record(raw[:-1])


def test_pipeline_equals_its_stages(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = common.table(spark, sf_dir, "documents")
    first = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        first = common.written(stage(spark, first, sf_dir), name)
        assert first.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in first.collect()}
    groups = brute_components([kept[i] for i in sorted(kept)], corpus_pipeline.NEAR_COPY_PERCENT)
    assert all(k == component for k, (_, component) in groups.items())
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.count() > 0 and {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} <= set(kept)
    assert set(QUERIES) == {n for n in QUERIES if n.startswith("op")} and len(QUERIES) == 10
