"""Near-duplicates against brute force: crowded regions, hubs, families, repeated and missing ids."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proteinscan.llm import common, neardup
from tests.llm.conftest import brute_components, documents, words


def found_in(docs, percent=85):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, percent).collect()}


def near_copies(rng, base, n, changes):
    """Copies of a text with some words changed, each by a word of its own."""
    base = base.split()
    for i in range(n):
        copy = list(base)
        for k in rng.sample(range(2, len(base) - 2, 6), changes):
            copy[k] = f"new{i}x{k}"
        yield " ".join(copy)


@pytest.fixture
def crowding(monkeypatch):
    """Limits so low that small tables have crowded regions, parts, blocks and runs in pieces."""
    for name, value in {"BLOCK": 20, "PART_ROWS": 8, "CROWDED": 16, "HELD": 24, "SALTS": 3}.items():
        monkeypatch.setattr(neardup, name, value)


def test_near_duplicates(docs, texts, none):
    assert found_in(docs) == brute_components(texts, 85)
    assert neardup.near_duplicates(none).count() == 0


def test_a_hub_with_the_largest_id_loses_no_copy(spark, crowding):
    """Copies are like the hub, not like each other; the hub is the last document."""
    rng = random.Random(5)
    base = words(rng, 200)
    texts = [*near_copies(rng, base, 600, 3), base]
    found = found_in(documents(spark, texts))
    assert {c for _, c in found.values()} == {0} and len(found) == 601
    assert {found[i][0] for i in range(0, 601, 100)} == {196}


def test_a_large_group_in_which_all_are_alike(spark, crowding):
    rng = random.Random(6)
    texts = [*near_copies(rng, words(rng, 200), 150, 1), *(words(rng, 60) for _ in range(50))]
    assert found_in(documents(spark, texts)) == brute_components(texts, 85)


def test_a_crowded_family(spark, crowding):
    """Variants of one text, each alike enough to one other only: no link goes through a hub."""
    rng = random.Random(6)
    base, slots = words(rng, 190).split(), range(4, 186, 5)
    texts, used = [], set()

    def variant(changed, tag):
        return " ".join(f"{w}{tag}x" if k in changed else w for k, w in enumerate(base))

    for unit in range(4000):
        a, b, c, d = rng.sample(slots, 4)
        pairs = {frozenset(p) for p in ((a, b), (a, c), (b, c), (a, d), (b, d))}
        if not pairs & used:
            used |= pairs
            texts += [variant({a, b, c}, unit), variant({a, b, d}, f"{unit}y")]
    rng.shuffle(texts)
    expected = brute_components(texts, 80)
    assert len(texts) > 120 and 2 * len({c for _, c in expected.values()}) == len(texts)
    assert found_in(documents(spark, texts), 80) == expected


def test_missing_and_repeated_ids(spark):
    rng = random.Random(7)
    a, b, c = (words(rng, 80) for _ in range(3))
    rows = [(5, a), (5, a), (3, a), (None, a), (7, b), (7, c), (6, c), (None, None), (9, "")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in out), key=str)
    # The two texts of document 7 are one document: c links it with 6.
    assert found == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (None, None, False), (7, 6, False), (7, 6, False), (6, 6, True), (None, None, False), (9, 9, True)], key=str)


def test_parts_deepen_where_rows_are_crowded():
    # Rows 0 to 5 share eight coordinates, the others the first five only.
    common = np.array([8, 8, 8, 8, 8, 5, 5, 5])
    assert neardup.part_starts(common, 8).tolist() == [0, 6, 7, 8] and neardup.part_starts(common, 9).tolist() == [0]
    assert neardup.part_starts(np.full(9, neardup.DEPTH), 4).tolist() == [0, 4, 8]
    deep = np.array([0x01_02_03_04_05_06_07, 0x01_02_03_04_05_06_07, 0x01_02_03_04_05_06_08, 0x01_00_00_00_00_00_00, 0x02_00_00_00_00_00_00])
    assert neardup.shared_prefix(deep).tolist() == [12, 11, 6, 5]


def test_both_ways_of_comparing_agree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.choice(300, 200)).astype(np.uint64) for _ in range(40)]
    counts = neardup.shared_counts(sets[:15], sets[15:])
    assert counts.tolist() == [[len(np.intersect1d(a, b)) for b in sets[15:]] for a in sets[:15]]


def test_a_region_after_a_cut_run_loses_no_row(spark, monkeypatch):
    """A crowded run that ends where an Arrow batch ends, then a small region: every row meets its block."""
    monkeypatch.setattr(neardup, "HELD", 35)
    monkeypatch.setattr(neardup, "CROWDED", 30)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "35")
    try:
        rows = [(i, 1 if i < 70 else 2, i) for i in range(90)]
        met = common.written(neardup._met(spark.createDataFrame(rows, "id long, region long, deep long").coalesce(1)), "met")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert {r["salt"] for r in met.where("region = 2").collect()} == {0} and met.where("region = 1 AND salt > 0").count() > 0
    described = F.lit(3).cast("long").alias("n"), F.col("id").alias("comp")
    for salted in (met, met.withColumn("salt", F.when(F.col("region") == 2, F.col("id") % neardup.SALTS).otherwise(F.col("salt")).cast("int"))):
        dealt = neardup._dealt(salted.select("id", "region", "salt", *described))
        assert {r["id"] for r in dealt.collect()} == set(range(90))


def test_differences_from_any_core_give_exact_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.choice(300, 200)).astype(np.uint64) for _ in range(30)]
    comp, side = np.arange(30), np.where(np.arange(30) < 12, 0, 1)
    for core in (np.empty(0, np.uint64), sets[3], np.arange(150, dtype=np.uint64), np.arange(1000, 1100, dtype=np.uint64)):
        deltas, missing = zip(*(neardup.difference(s, core) for s in sets), strict=True)
        for i, s in enumerate(sets):
            assert missing[i] == len(np.setdiff1d(core, s)) and deltas[i].tolist() == sorted(set(s.tolist()) ^ set(core.tolist()))
        for percent in (40, 45, 50, 60):
            expected = {(i, j) for i in range(12) for j in range(12, 30) if neardup._alike(sets[i], sets[j], percent)}
            a, b = neardup.links_across(comp, side, len(core), np.array(missing), list(deltas), percent)
            assert set(zip(a.tolist(), b.tolist(), strict=True)) == expected


def test_a_crowded_region_of_long_rows_needs_no_core(spark, crowding, monkeypatch):
    """No row is chosen for the core: full sets travel, and the links are the same."""
    monkeypatch.setattr(neardup, "CORE_ROWS", 0)
    rng = random.Random(6)
    texts = [*near_copies(rng, words(rng, 200), 90, 4), *(words(rng, 60) for _ in range(10))]
    assert found_in(documents(spark, texts)) == brute_components(texts, 85)
