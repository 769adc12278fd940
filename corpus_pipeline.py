"""A corpus pipeline over documents: quality rules, line dedup, near-dedup, decontamination, mixing.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All return the columns of documents, and other columns that docs has go through.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows and empty tables; what becomes of them
is said at each. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontamination, line_dedup, mixing, quality_rules, simhash
from tessella.llm.shared import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host fails, go. Null, empty and short texts fail; repeated rows are judged each."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that stand elsewhere go; n_chars follows the text (null: null). All rows stay; repeated rows are one document."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of the least id, null before all. Texts without words are one group."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of the benchmark go. Null and empty texts have none and stay."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as many times as it has copies by entropy balancing of the sources; those without go.

    Texts without words have one copy. Rows equal in id, source and text share theirs.
    """
    return mixing.mixed(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix)]

#: Hashes choose chunks, near-duplicates and copies, so SQL has no equal; tests/llm compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
