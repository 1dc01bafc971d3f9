"""The queries of this subpackage: thin uses of its operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balltree, decontam, html_tree, langid, lexical, licenses, masked_lm, mixing, oracles, quality, secrets, simhash, substring, topk
from .common import table


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(secrets.as_text(F.col("base")), 256).alias("base_sha256"),
        secrets.as_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score_documents(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    best = F.get("matches", 0)
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"), best["id"].alias("license_id"),
        best["dice"].alias("dice"), best["unit"].alias("matched_text"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["id"]))), ",").alias("licenses"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_tree.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.cluster(table(spark, sf_dir, "embeddings"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_secret_scans, op2_lm_scoring, op3_simhash_near_dedup, op4_quality_rules, op5_license_scans,
        op6_substring_dedup, op7_benchmark_decontamination, op8_html_extraction, op9_mixing, op10_language_id,
        op11_centroid_clustering, op12_exact_top_k, op13_lexical_search,
    )}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
