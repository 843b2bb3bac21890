"""Registered queries against versions that work row by row, or against their SQL, on a small table."""

import hashlib
import io
import itertools
import math
import re
import wave
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from proteinscan.llm import common, langid, media, quality, toxicity
from proteinscan.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in common.table(spark, SF, "documents").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in common.table(spark, SF, "labels").collect()}


def held_out(doc_id, modulus, remainder):
    return zlib.crc32(str(doc_id).encode()) % modulus == remainder


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    rows = [tuple(plain(r[c]) for c in columns) for r in found.collect()]
    assert sorted(rows, key=repr) == sorted((tuple(map(plain, r)) for r in expected), key=repr)


def test_quality_query(spark, docs, labels):
    """Densities from inverse and determinant of the shrunken covariances, one row at a time."""
    chosen = [(docs[i]["text"], r["quality"]) for i, r in labels.items() if i in docs and r["quality"] in (0, 1) and not held_out(i, 3, 1)]
    x, y = np.array([quality.statistics(t) for t, _ in chosen]), np.array([k for _, k in chosen])
    center, scale, d = x.mean(axis=0), np.sqrt(np.maximum(x.var(axis=0), 1e-6)), x.shape[1]
    z = (x - center) / scale
    cov = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).mean() * cov[k] for k in (0, 1))
    s = quality.SHRINKAGE
    shrunk = [(1 - s) * c + s / 2 * pooled + (s / 2 * np.trace(pooled) / d + 1e-3) * np.eye(d) for c in cov]

    def score(text):
        v = np.clip((np.array(quality.statistics(text)) - center) / scale, -8, 8)
        logs = []
        for k in (0, 1):
            off = v - z[y == k].mean(axis=0)
            logs.append(math.log((y == k).mean()) - 0.5 * off @ np.linalg.inv(shrunk[k]) @ off - 0.5 * np.linalg.slogdet(shrunk[k])[1])
        return 1 / (1 + math.exp(-max(-30, min(30, (logs[1] - logs[0]) / d))))

    rows = QUERIES["op2_quality_classifier"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert math.isclose(r["score"], score(docs[r["doc_id"]]["text"]), rel_tol=1e-6, abs_tol=1e-9)
        assert (r["predicted"], r["held_out"]) == (int(r["score"] >= 0.5), held_out(r["doc_id"], 3, 1))


def test_statistics_of_a_text():
    """Counted by patterns, character by character."""
    for text in ("Tost né_1 | a|b$$$ x## . (Über) 42%\nx\nx", "", "   ", "$$ $", "日本 ²x ٣ ß\n\n"):
        words, chars, lines = text.split(), max(1, len(text)), text.split("\n")
        n = max(1, len(words))

        def logit(count, of):
            p = (count + 0.5) / (of + 1)
            return math.log(p / (1 - p)) if p < 1 else 10.0

        mark = r"[^\w\s.,;:!?'\"()-]"
        found = dict(zip(quality.STATISTICS, quality.statistics(text), strict=True))
        assert math.isclose(found["words"], math.log1p(len(words)))
        for name, count, of in (
            ("letter_share", len(re.findall(r"[^\W\d_]", text)), chars), ("symbol_share", len(re.findall(mark + "|_", text)), chars), ("pipe_share", text.count("|"), n),
            ("digit_share", len(re.findall("[0-9]", text)), chars), ("distinct_share", len(set(words)), n), ("repeated_lines", len(lines) - len(set(lines)), len(lines)),
            ("capital_share", len(re.findall(r"(?<!\S)[^\W\d_a-z]", text)), n), ("edge_symbol_share", len(re.findall(rf"\S{mark}+(?=\s|$)", text)), n),
        ):
            assert math.isclose(found[name], logit(count, of)), (text, name)


def test_toxicity_query(spark, docs, labels):
    """Each text restored and scored by itself."""
    tables = (common.table(spark, SF, t) for t in ("documents", "labels"))
    model = toxicity.fit(*tables)
    assert model.weights
    for r in QUERIES["op5_toxicity"](spark, SF).collect():
        restored = model.restore(docs[r["doc_id"]]["text"])
        words = set(re.findall(r"[^\W\d_]+", restored))
        features = words | {f"{w[:n]}*" for w in words for n in toxicity.PREFIXES if len(w) >= n}
        odds = model.intercept + sum(w for f, w in model.weights.items() if f in features)
        assert math.isclose(r["score"], 1 / (1 + math.exp(-odds)), rel_tol=1e-6)
        assert (r["predicted"], r["held_out"]) == (int(r["score"] >= 0.5), held_out(r["doc_id"], 5, 0))


def test_media_query(spark, docs):
    rows = QUERIES["op6_media_columns"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        data = (docs[r["doc_id"]]["text"] or "").encode()
        payload = data + b"\xff" * ((-len(data)) % 576 if data else 576)
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, media.RATE, 0, "NONE", ""))
            w.writeframes(payload)
        stored = out.getvalue()
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(data), len(payload), len(stored))
        assert (r["payload_sha256"], r["media_sha256"], r["tail_crc32"]) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(stored).hexdigest(), zlib.crc32(payload[-32:]))
        pairs = media.spectral_pairs(payload).tolist()
        assert r["feature"] == " ".join(f"{a}:{b}-{c}+{d}" for a, b, c, d in pairs) and [list(p) for p in r["pairs"]] == pairs


def gram_shares(text):
    """Shares of hashed 1- to 3-grams, one by one."""
    letters = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))
    codes = [32, *map(ord, letters), 32]
    wrap, out = 2**32, np.zeros(langid.DIMENSIONS)
    two = [(a * 0x9E3779B1 + b) % wrap for a, b in itertools.pairwise(codes)]
    three = [((t ^ (t >> 15)) * 0x85EBCA77 + c) % wrap for t, c in zip(two, codes[2:], strict=False)]
    for grams, factor in ((codes, 0xC2B2AE3D), (two, 0x27D4EB2F), (three, 0x165667B1)):
        for g in grams:
            out[(g * factor % wrap >> 7) % langid.DIMENSIONS] += 1
    return np.sqrt(out / out.sum())


def test_language_query(spark, docs):
    """The same machines, asked pair by pair: first between families, then inside the winner."""
    model = langid.fit(common.table(spark, SF, "documents"))

    def winner(names, machines, x):
        votes, least = dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
        for (a, b), w in machines.items():
            margin = x @ w[:-1] + w[-1]
            p = 1 / (1 + math.exp(-max(-30, min(30, 4 * margin))))
            votes[a] += (margin > 0) + 1e-3 * math.tanh(margin)
            votes[b] += (margin <= 0) - 1e-3 * math.tanh(margin)
            least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
        first = max(names, key=lambda n: votes[n])
        return first, least[first]

    rows = QUERIES["op8_language_id"](spark, SF).collect()
    assert len(rows) == len(docs) and len(model.families) > 1
    for r in rows:
        text = docs[r["doc_id"]]["text"]
        assert r["held_out"] == held_out(r["doc_id"], 3, 1)
        if not text or not any(map(str.isalpha, text)):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        x = gram_shares(text)
        assert np.abs(x - langid.features([text])[0]).max() < 1e-6
        family, sure = winner(sorted(model.families), model.between, x)
        lang, inner = winner(model.families[family], model.inside[family], x)
        assert r["lang_pred"] == lang and math.isclose(r["score"], min(sure, inner), rel_tol=1e-3, abs_tol=1e-6)


def test_lm_query(spark, docs):
    """Tokens, known tokens and base scores from counts of whole words; on held-out texts the network beats the base."""
    def tokens(text):
        return [*(text or "").encode().lower().split(), b"\n"]

    counts = Counter(w for i, r in docs.items() if not held_out(i, 7, 2) for w in tokens(r["text"]))
    n, v = sum(counts.values()), len(counts)
    rows = QUERIES["op12_lm_scoring"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = tokens(docs[r["doc_id"]]["text"])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held_out(r["doc_id"], 7, 2), len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
