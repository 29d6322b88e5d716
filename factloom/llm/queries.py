"""The queries of this subpackage: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import brown_lm, entropy_mix, html_consensus, importance, langid, secret_scan, simhash_bk, svd_whitening, telephony, template_decontam, toxicity, url_rules, warc_zip
from ._shared import table


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.op1(table(spark, sf_dir, "documents"))


def op2_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_consensus.extract(table(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op3(table(spark, sf_dir, "documents"))


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.op4(table(spark, sf_dir, "pages"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.op5(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op6(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.op8(table(spark, sf_dir, "documents"))


def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.op9(table(spark, sf_dir, "documents"))


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_decontam.op10(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_svd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return svd_whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.op13(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_telephony, op2_html_consensus, op3_secret_scan, op4_warc_zip, op5_url_rules, op6_language_id, op7_toxicity, op8_simhash_bk_trees, op9_entropy_mix, op10_template_decontamination, op11_importance_resampling, op12_svd_whitening, op13_brown_lm)}

ORACLES: dict[str, str] = {"op4_warc_zip": warc_zip.ORACLE, "op5_url_rules": url_rules.ORACLE, "op11_importance_resampling": importance.ORACLE}
