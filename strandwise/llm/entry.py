"""The queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import dac, exact_dedup, host_reputation, lang_id, partenum, raking, secret_scan, suffix_decontam, toxicity, warc_fixity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages laid out as WARC files, audited against a replica with planted faults."""
    records = warc_fixity.page_records(table(spark, sf_dir, "pages"))
    return warc_fixity.audit(records, warc_fixity.faulty(records))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.find(table(spark, sf_dir, "documents")))


def op4_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.report(table(spark, sf_dir, "documents"))


def op5_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.report(table(spark, sf_dir, "documents"))


def op6_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.report(table(spark, sf_dir, "documents"))


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label that carries its id."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return host_reputation.judge(table(spark, sf_dir, "pages"), outcomes).drop("bound")


def op8_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.report(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return suffix_decontam.report(found)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_fixity, op2_exact_dedup, op3_secret_scan, op4_dac, op5_partenum, op6_lang_id, op7_host_reputation, op8_raking, op9_toxicity, op10_suffix_decontam)}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_fixity": warc_fixity.ORACLE, "op2_exact_dedup": exact_dedup.ORACLE, "op7_host_reputation": host_reputation.ORACLE}
