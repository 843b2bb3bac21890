"""What the operator tests share: random words, document tables, brute-force components."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, length long, bucket string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def documents(spark, texts, source=lambda i: f"s{i % 3}"):
    """Rows with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", source(i), 0, 1, 2, "x") for i, t in enumerate(texts)], SCHEMA)


def brute_components(texts, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    group, before = {i: i for i in sets}, None
    while group != before:
        before = dict(group)
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    return {i: (len(sets[i]), group[i]) for i in sets}


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(3)
    base = words(rng, 120)
    near = base.replace(base.split()[60], "changed", 1)
    return [None, "", " ", "one", "One", "a b c d", base, base, near, words(rng, 30_000), *(words(rng, rng.randint(1, 400)) for _ in range(50)), base.upper()]


@pytest.fixture(scope="session")
def docs(spark, texts):
    return documents(spark, texts)


@pytest.fixture(scope="session")
def none(spark, docs):
    return docs.where("false")
