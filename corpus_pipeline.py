"""From raw documents to packed ones, in five stages; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import decontaminate, exact_dedup, packing, quality, simhash
from lamina.llm.common import dropped, scratch_at, scratch_table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def fill_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("decontamination", drop_benchmark), ("packing", fill_bins)]

#: The stages train a model, build trees and plan bins, which SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slots of the documents that the stages keep; each stage's rows are written to the shared folder and read again, until the next stage's are there."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        at = scratch_at(spark, name.replace(" ", "-"))
        docs = scratch_table(stage(spark, docs, sf_dir), at)
        if last:
            dropped(spark, last)
        last = at
    return STAGES[-1][1](spark, docs, sf_dir)
