"""Every registered query and pipeline stage on a table of odd rows, and on empty tables.

Null and repeated ids, repeated rows, null, empty and very long texts, ties, and further columns
whose names are used inside the operators.
"""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from proteinscan.llm import common
from proteinscan.llm.queries import QUERIES
from tests.llm.conftest import words

CLASHES = (
    "score predicted toxicity toxic lang_pred lang_score label _hash _size _bucket _salt words row copy times key h part cut range guest number region comp id n set size w "
    "bucket rank start length n_chars next_text doc_tokens shard slot first feature features html url"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` long" for c in CLASHES)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(12)
    long = words(rng, 25_000)
    rows = [
        (None, None), (None, ""), (None, "no id here at all"), (None, "no id here at all"), (1, "one text"), (1, "another text"), (1, "one text"), (2, ""), (3, None), (4, long), (4, long),
        (5, "123 !? --"), (6, "\t\r\n"), (7, "<|endoftext|> é 日本 🙂"), (-8, "negative id"), (2**62, "large id"),
    ]
    rows += [(100 + i, words(rng, rng.randint(20, 90)) + (" idiot moron" if i % 4 == 0 else "") + (" | # $" * 9 if i % 3 == 0 else "")) for i in range(120)]
    return [(i, t, (None, "en", "de")[k % 3], ("a", "a", "b", None)[k % 4], *range(len(CLASHES))) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def odd(spark, odd_rows, tmp_path_factory):
    """Folder with the odd tables; `empty` beside it with the same tables without rows."""
    base = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame(odd_rows, SCHEMA)
    ids = [i for i in range(100, 220)]
    labels = spark.createDataFrame([*((i, int(i % 3 != 1), int(i % 4 == 0), 5) for i in ids), (None, 1, 1, 5), (101, None, None, 5), (100, 1, 1, 5)], "doc_id long, quality int, toxic int, label long")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x").alias("url"), F.col("text").alias("html"), F.lit(1).alias("h"), F.lit(2).alias("kept"))
    benchmark = docs.select(F.col("doc_id").alias("item_id"), "text", F.lit(1).alias("bucket"))
    for name, df in {"documents": docs, "labels": labels, "pages": pages, "benchmark": benchmark}.items():
        df.repartition(3).write.parquet(f"{base}/full/{name}.parquet")
        df.where("false").write.parquet(f"{base}/empty/{name}.parquet")
    return str(base)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op1_packing", "op13_collocations")])
def test_each_row_has_a_result(spark, odd, odd_rows, name):
    key = "page_id" if name == "op7_warc" else "doc_id"
    rows = QUERIES[name](spark, f"{odd}/full").collect()
    assert Counter(r[key] for r in rows) == Counter(r[0] for r in odd_rows)
    assert QUERIES[name](spark, f"{odd}/empty").count() == 0


def test_packing_of_odd_rows(spark, odd, odd_rows):
    rows = QUERIES["op1_packing"](spark, f"{odd}/full").collect()
    assert Counter(r["doc_id"] for r in rows if r["start"] == 0) == Counter(r[0] for r in odd_rows)
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 1024 and QUERIES["op1_packing"](spark, f"{odd}/empty").count() == 0


@pytest.mark.parametrize(("name", "columns"), [
    ("op2_quality_classifier", "score predicted"), ("op5_toxicity", "score predicted"), ("op8_language_id", "lang_pred score"),
    ("op6_media_columns", "n_bytes payload_sha256 media_sha256 feature"), ("op10_document_fingerprints", "n_chars fingerprint"),
])
def test_rows_of_one_id_and_text_agree(spark, odd, name, columns):
    by_id = {}
    for r in QUERIES[name](spark, f"{odd}/full").collect():
        by_id.setdefault(r["doc_id"], []).append(tuple(r[c] for c in columns.split()))
    assert len(set(by_id[4])) == 1 and by_id[2] == by_id[3]  # repeated rows; empty and null texts
    assert len(by_id[None]) == 4 and len(set(by_id[None])) <= 2 and len(set(by_id[1])) <= 2
    assert by_id[2][0] in by_id[None]


def test_phrases_of_odd_rows(spark, odd):
    """The marks of every third text make phrases; null languages are one of their own."""
    rows = QUERIES["op13_collocations"](spark, f"{odd}/full").collect()
    assert {r["lang"] for r in rows} == {"und", "en", "de"} and all(r["a"] >= 10 and r["a"] <= min(r["l"], r["r"]) for r in rows)
    assert QUERIES["op13_collocations"](spark, f"{odd}/empty").count() == 0


def test_resampling_of_odd_rows(spark, odd):
    rows = QUERIES["op11_importance_resampling"](spark, f"{odd}/full").collect()
    drawn = sorted((r["rank"], -r["score"], r["doc_id"] is None, r["doc_id"]) for r in rows if r["rank"])
    assert [k for k, *_ in drawn] == list(range(1, len(drawn) + 1)) and [x[1:] for x in drawn] == sorted(x[1:] for x in drawn)
    assert len(drawn) == sum(r["n_features"] >= 20 for r in rows) // 10 and {r["weight"] for r in rows if r["n_features"] == 0} == {0}
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append((r["weight"], r["score"]))
    assert len(set(by_id[4])) == 1


def test_lm_scores_of_odd_rows(spark, odd):
    rows = QUERIES["op12_lm_scoring"](spark, f"{odd}/full").collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append((r["n_tokens"], r["n_known"], round(r["base_score"], 6)))
    assert len(set(by_id[4])) == 1 and by_id[2] == by_id[3] == [(1, 1, by_id[2][0][2])]
    assert all(r["score"] < 0 and r["n_known"] <= r["n_tokens"] for r in rows) and len({r["train_tokens"] for r in rows}) == 1


def test_shards_of_odd_rows(spark, odd):
    rows = QUERIES["op9_sharding"](spark, f"{odd}/full").collect()
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_mix_of_odd_rows(spark, odd):
    rows = QUERIES["op4_mixing"](spark, f"{odd}/full").collect()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - sum(r["size"] for r in rows)) <= 4


def test_pages_that_share_an_id(spark, odd):
    """Equal payloads refer to the largest page_id; rows with that id are responses."""
    rows = [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in QUERIES["op7_warc"](spark, f"{odd}/full").collect()]
    assert sorted((r for r in rows if r[1] == 0), key=str) == sorted([(None, 0, "revisit", 3), (None, 0, "revisit", 3), (2, 0, "revisit", 3), (3, 0, "response", None)], key=str)
    assert [r[2] for r in rows if r[0] == 4] == ["response", "response"]
    assert [r[2:] for r in rows if r[0] is None and r[1] > 0] == [("response", None)] * 2


@pytest.fixture(scope="module")
def stages(spark, odd):
    """Rows before and after each pipeline stage."""
    docs = common.table(spark, f"{odd}/full", "documents")
    out = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        after = common.written(stage(spark, docs, f"{odd}/full"), name)
        assert name == "packing" or after.columns == docs.columns
        docs = after
        out[name] = docs.collect()
    return out


def test_stages_keep_all_columns(stages):
    for name in ("language_id", "toxicity", "minhash_near_dedup", "mixing"):
        assert all(tuple(r)[4:] == tuple(range(len(CLASHES))) for r in stages[name])


def test_language_stage_drops_texts_without_letters(stages):
    kept = Counter((r["doc_id"], r["text"]) for r in stages["language_id"])
    assert kept == Counter((r["doc_id"], r["text"]) for r in stages["documents"] if r["text"] and any(map(str.isalpha, r["text"])))


def test_toxicity_stage_drops_marked_rows(stages):
    gone = Counter(r["text"] for r in stages["language_id"]) - Counter(r["text"] for r in stages["toxicity"])
    assert gone == Counter(r["text"] for r in stages["language_id"] if "idiot" in r["text"].split())


def test_near_copy_stage_keeps_one_row_of_each_group(stages):
    before, after = (Counter(r["text"] for r in stages[n]) for n in ("toxicity", "minhash_near_dedup"))
    # No two texts here are alike but equal ones; null and shared ids do not matter.
    assert after == Counter(set(before)) and before["no id here at all"] == 2 and before["one text"] == 2


def test_mixing_stage_repeats_rows(stages):
    before, after = (Counter((r["doc_id"], r["text"]) for r in stages[n]) for n in ("minhash_near_dedup", "mixing"))
    assert set(after) <= set(before) and max(after.values()) <= 3 and (None, "no id here at all") in before

    def total(rows):
        return sum(n * len(t.split()) for (_, t), n in rows.items())

    assert 0.5 * total(before) < total(after) < 1.5 * total(before)


def test_packing_stage_holds_every_row(stages):
    starts = Counter(r["doc_id"] for r in stages["packing"] if r["start"] == 0)
    assert starts == Counter(r["doc_id"] for r in stages["mixing"])


def test_pipeline_of_empty_tables(spark, odd):
    assert corpus_pipeline.run(spark, f"{odd}/empty").count() == 0


def test_near_copies_without_ids_are_found(spark):
    rng = random.Random(13)
    base = words(rng, 150)
    near = base.replace(base.split()[70], "changed", 1)
    docs = spark.createDataFrame([(None, base), (None, near), (1, near), (1, words(rng, 150)), (None, "a"), (None, None), (None, None)], "doc_id long, text string")
    kept = [r["text"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert len(kept) == 5 and sum(t in (base, near) for t in kept) == 1 and kept.count(None) == 2


def test_held_out_rows(spark, odd):
    for name, modulus, remainder in (("op2_quality_classifier", 3, 1), ("op5_toxicity", 5, 0), ("op8_language_id", 3, 1)):
        for r in QUERIES[name](spark, f"{odd}/full").select("doc_id", "held_out").collect():
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % modulus == remainder)
