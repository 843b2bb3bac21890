"""Label tables that are too large to broadcast: their salted copies are merged, and only texts that may have a label are moved."""

import pickle
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from proteinscan.llm import common, mixing, quality, toxicity


@pytest.fixture
def large(monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("bits", [1 << 27, 64])  # with few bits most rows pass
def test_copies_are_not_broadcast(spark, large, monkeypatch, how, bits):
    monkeypatch.setattr(common, "MOST_BITS", bits, raising=False)
    ids = [None, None, *([7] * 40), *range(-200, 1000, 3), 5_000_000_000]
    rows = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate(ids)], "doc_id long, text string")
    labels = {k: k % 2 for k in [*range(-50, 400), 5_000_000_000]}
    small = common.written(spark.createDataFrame(list(labels.items()), "doc_id long, label int"), "small")
    joined = common.joined_by_hot_key(rows, small, "doc_id", F.col("text"), how)
    found = Counter((r["doc_id"], r["text"], r["label"]) for r in joined.collect())
    assert found == Counter((k, f"t{i}", labels.get(k)) for i, k in enumerate(ids) if how == "left" or k in labels)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_texts_without_label_are_left_out_before_the_join(spark, large):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    small = common.written(spark.range(0, 20_000, 100).select(F.col("id").alias("doc_id"), F.lit(1).alias("label")), "small")
    left = {r["doc_id"] for r in common._with_partners(rows, small, "doc_id", 200).collect()}
    assert left >= set(range(0, 20_000, 100)) and len(left) < 4000  # one in 16 of the others, about
    assert common._with_partners(rows, small, "doc_id", 200).columns == rows.columns


def _labelled(spark):
    """Documents of which many share an id, and one label each."""
    texts = [("a bad vile word" if k % 2 else "some plain good lines") + f" number {k} of text" * (1 + k % 5) for k in range(120)]
    docs = spark.createDataFrame([(k if k % 7 else 3, t, "s", "en") for k, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    return docs, spark.createDataFrame([(k, k % 2, k % 2) for k in range(120)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("model", [quality, toxicity])
def test_models_are_those_of_few_labels(spark, monkeypatch, model):
    docs, labels = _labelled(spark)
    texts = [r["text"] for r in docs.collect()]

    def scored():
        fitted = model.fit(docs, labels)
        return fitted.scores(texts) if model is toxicity else fitted.scores([quality.statistics(t) for t in texts])

    few = scored()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    assert scored() == pytest.approx(few, abs=1e-6)


def test_mixing_is_that_of_few_labels(spark, monkeypatch):
    docs, labels = _labelled(spark)
    few = sorted(mixing.mix(docs, quality.fit(docs, labels)).collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    assert sorted(mixing.mix(docs, quality.fit(docs, labels)).collect()) == few


def test_the_model_travels_and_is_fitted_without_an_object_for_each_feature(spark):
    found = spark.createDataFrame([(f,) for f in ["zeta", "b*", "\u00e9t\u00e9", "b", "\U00010400x", "\uffee"]], "feature string").repartition(3)
    assert toxicity._in_order(found).to_pylist() == sorted(r["feature"] for r in found.collect())
    assert toxicity._in_order(found.where("false")).to_pylist() == []
    for weights in ({}, {"bad": 1.5, "b*": -0.25, "\u00e9t\u00e9": 0.1}):
        model = toxicity.ToxicityModel(weights, -1.0, toxicity._bigram_model(np.zeros((28, 28))))
        make, parts = model.__reduce__()
        assert all(isinstance(p, str | float | np.ndarray) for p in parts)
        assert make(*parts).weights == weights and pickle.loads(pickle.dumps(model)).intercept == -1.0


def test_drop_toxic_is_that_of_few_labels(spark, monkeypatch, tmp_path):
    docs, labels = _labelled(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    few = sorted(corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
    assert sorted(corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()) == few and len(few) < docs.count()
