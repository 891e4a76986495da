"""Queries of the operators over the documents table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, gridjoin, infill, jaccard, langid, lmscore, periodic, quality, rules, sharding, substring, suffix
from .common import held, table
from .oracles import ORACLES  # noqa: F401


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.find(table(spark, sf_dir, "documents"))
    sources = F.array_sort(F.array_distinct(F.transform("passages", lambda p: p["source"])))
    return found.select("doc_id", "n_words", "n_removed", F.size("passages").cast("long").alias("n_passages"), sources.alias("sources"), "passages", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_50k.json")
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), path, out_col="decoded"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held("doc_id", 3, 1)))
    return langid.predict(docs, model).select("doc_id", F.coalesce(held("doc_id", 3, 1), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held("doc_id", 4, 2)))
    return quality.score(docs, model).select("doc_id", F.coalesce(held("doc_id", 4, 2), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.groups(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = lmscore.score(docs, tokenizer_file("piece_bpe_32k.model"), ~held("doc_id", 7, 2))
    return out.select("doc_id", F.coalesce(held("doc_id", 7, 2), F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(suffix.remove_repeats(table(spark, sf_dir, "documents")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find(periodic.planted(table(spark, sf_dir, "documents"))))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.transform(table(spark, sf_dir, "documents")))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridjoin.groups(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_bpe, op3_language_id, op4_quality, op5_jaccard_join, op6_lm_score, op7_decontamination, op8_sharding, op9_suffix_dedup, op10_quality_rules, op11_periodic_runs, op12_infill, op13_embedding_near_dedup, pipeline)}
