"""Registered queries of the training-data operators, with production parameters.

Each takes (spark, sf_dir), runs its operator over the whole table and derives
the digest columns from the operator's own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortkit.llm import oracle
from cohortkit.llm.clustering import cluster_vectors
from cohortkit.llm.common import read
from cohortkit.llm.decontaminate import decontaminate
from cohortkit.llm.exact_dedup import exact_dedup
from cohortkit.llm.langid import fit_languages, predict_language
from cohortkit.llm.mixing import mix
from cohortkit.llm.near_dedup import near_duplicates
from cohortkit.llm.pii import find_personal_data, personal_digest
from cohortkit.llm.quality import fit_cotraining, score_quality
from cohortkit.llm.secret_scan import scan_secrets, secret_digest
from cohortkit.llm.source_audit import audit_sources
from cohortkit.llm.substring_dedup import remove_repeats
from cohortkit.llm.toxicity import fit_chain, score_toxicity
from cohortkit.llm.url_filter import judge_urls

#: (host, path, verdict)
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan_secrets(read(spark, sf_dir, "documents")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(read(spark, sf_dir, "pages"), rules)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    chain = fit_chain(docs, labels, {"junk": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    return score_toxicity(docs, chain)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_digest(find_personal_data(read(spark, sf_dir, "documents")))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    return predict_language(docs, fit_languages(docs, ~held_out), "doc_id", "text", held_out.alias("held_out"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return score_quality(docs, fit_cotraining(docs, labels)).select("doc_id", "_quality.*")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=2)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"), output="sha256").drop("spans")


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(read(spark, sf_dir, "documents"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(read(spark, sf_dir, "embeddings"))[0]


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_url_filter, op3_toxicity, op4_personal_data, op5_language, op6_decontaminate, op7_mix,
    op8_exact_dedup, op9_quality, op10_near_dedup, op11_substring_dedup, op12_source_audit, op13_clusters)}

ORACLE = {
    "op1_secret_scan": oracle.secret_scan_sql(),
    "op2_url_filter": oracle.url_filter_sql(URL_RULES),
    "op6_decontaminate": oracle.DECONTAMINATE,
    "op7_mix": oracle.MIX,
    "op8_exact_dedup": oracle.EXACT_DEDUP,
    "op10_near_dedup": oracle.NEAR_DEDUP,
    "op11_substring_dedup": oracle.SUBSTRING_DEDUP,
    "op12_source_audit": oracle.SOURCE_AUDIT,
    "op13_clusters": oracle.clusters_sql(),
}
