"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import collocations, decontamination, html_extraction, line_dedup, lm_scoring, mixing, periodic_runs, quality_classifier, quality_rules, secret_scans, simhash, substring_dedup, url_filters
from tessella.llm.shared import table


def _bad() -> Column:
    """A labelled outcome: bad if of low quality or toxic; null without a label."""
    return F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's host is its source, its path there its language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    return quality_classifier.classify(docs, table(spark, sf_dir, "labels").select("doc_id", _bad().alias("bad")))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.scan(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document with its id: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), _bad().alias("bad"))
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), labels)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.top(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_secret_scans, op3_decontamination, op4_mixing, op5_quality_rules, op6_line_dedup, op7_lm_scoring, op8_simhash, op9_substring_dedup, op10_url_filters, op11_html_extraction, op12_collocations, op13_periodic_runs)}

ORACLES = {"op3_decontamination": decontamination.oracle(), "op4_mixing": mixing.oracle(), "op6_line_dedup": line_dedup.oracle(), "op9_substring_dedup": substring_dedup.oracle(), "op5_quality_rules": quality_rules.oracle(), "op10_url_filters": url_filters.oracle(), "op12_collocations": collocations.oracle()}
