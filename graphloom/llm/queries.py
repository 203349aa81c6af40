"""The opN_<name> queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, langid, minhash, mixing, oracles, packing, quality, sharding, substring, toxicity, url_filter


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.digest_groups(_documents(spark, sf_dir))
    return groups.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_documents(spark, sf_dir))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = substring.substring_dedup(_documents(spark, sf_dir))
    return rest.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op4_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = sharding.shard_plan(_documents(spark, sf_dir))
    return plan.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = toxicity.score_toxicity(_documents(spark, sf_dir), labels)
    kept = F.col("expected_severity") < toxicity.LIMIT
    return found.select(F.col("id").alias("doc_id"), "expected_severity", "grade", kept.alias("kept"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    profiles = langid.learn_profiles(docs.where(~langid.held_out("doc_id")))
    found = langid.identify(docs, profiles)
    return found.select(F.col("id").alias("doc_id"), langid.held_out("id").alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op5_toxicity": op5_toxicity,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_url_filter": op9_url_filter,
    "op10_language_id": op10_language_id,
}

#: The others learn, fit or pack beyond SQL; tests hold them against brute force and held-out labels.
ORACLE_SQL = {
    "op1_exact_dedup": oracles.EXACT,
    "op2_mix_sources": oracles.MIXING,
    "op3_substring_dedup": oracles.SUBSTRING,
    "op4_hilbert_shards": oracles.SHARDING,
    "op6_minhash_near_dedup": oracles.NEAR,
    "op9_url_filter": oracles.url_sql(url_filter.RULES),
    "op10_language_id": oracles.LANGUAGE,
}
