"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """spark.checkpoint.dir; a temporary folder on a local master without it; None elsewhere."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return named.rstrip("/") if named else tempfile.gettempdir() if spark.sparkContext.master.startswith("local") else None


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back, so that what is built on it several times is computed once.

    Without a folder to share it is df itself, which gives the same rows by a longer plan.
    """
    folder = shared_folder(df.sparkSession)
    if folder is None:
        return df
    path = f"{folder}/tessella-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
