"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proteinscan.llm import collocations, importance, langid, lm, media, mixing, neardup, packing, quality, sharding, sketch, toxicity, warc
from proteinscan.llm.common import held_out, new_path, table
from proteinscan.llm.oracles import ORACLES


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").alias("predicted"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_columns(table(spark, sf_dir, "documents"))
    return out.withColumn("feature", media.feature_text(F.col("pairs")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict_language(docs, langid.fit(docs), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sketch.fingerprints(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketch.as_text(F.col("sketch")).alias("fingerprint"), sketch.as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the distribution of the benchmark's words, with their weights and scores."""
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of whole documents under counts and under the recurrent network; documents with hash remainder 2 of 7 are held out."""
    scored = lm.score_documents(table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id"), 7, 2))
    return scored.select("doc_id", (~F.col("counted")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_quality_classifier, op3_minhash_near_dedup, op4_mixing, op5_toxicity,
        op6_media_columns, op7_warc, op8_language_id, op9_sharding, op10_document_fingerprints,
        op11_importance_resampling, op12_lm_scoring, op13_collocations,
    )
}

__all__ = ["ORACLES", "QUERIES"]
