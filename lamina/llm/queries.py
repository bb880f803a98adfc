"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, html_extract, kneser_ney, packing, quality, secret_scan, simhash, toxicity, url_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(_table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.kept(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.accepted(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.blocked(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.perplexity(_table(spark, sf_dir, "documents"), kneser_ney.ORDER)


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_simhash, op3_quality, op4_decontamination, op5_secrets, op6_url_rules, op7_html, op8_packing, op9_toxicity, op10_lm_score)}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents
        GROUP BY trim(regexp_replace(text, '\s+', ' ', 'g')), CASE WHEN text IS NULL THEN doc_id END""",
}
