"""Panels in the shape of the operators, derived from the orders and lineitem tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BENCHMARK, BONDS = "1-URGENT", ("4-NOT SPECIFIED", "5-LOW")
SPLIT_DAY = "1998-01-01"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticker, Date, Open, High, Low, Close, Volume: daily bars of order prices by priority.

    Line quantities are summed per order first, so the join meets one row an order; bars combine map-side.
    """
    volume = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    o = read(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("Ticker"), F.col("o_orderdate").cast("date").alias("Date"), F.col("o_orderkey").alias("k"),
        (100 + F.col("o_totalprice") / 50000).alias("p"),
    )
    return (
        o.join(volume, F.col("k") == F.col("l_orderkey"), "left")
        .groupBy("Ticker", "Date")
        .agg(
            F.min_by("p", "k").alias("Open"), F.max("p").alias("High"), F.min("p").alias("Low"), F.max_by("p", "k").alias("Close"),
            F.coalesce(F.sum("q"), F.lit(0.0)).alias("Volume"),
        )
    )


def with_adjusted_close(df: DataFrame) -> DataFrame:
    """Adj Close: a two-percent step before a fixed day."""
    return df.withColumn("Adj Close", F.when(F.col("Date") < F.lit(SPLIT_DAY).cast("date"), F.col("Close") * 0.98).otherwise(F.col("Close")))


def with_gaps(df: DataFrame) -> DataFrame:
    """Close and Volume null on every seventh day of the calendar."""
    gone = F.datediff("Date", F.lit("1995-01-01")) % 7 == 0
    return df.withColumns({c: F.when(~gone, F.col(c)) for c in ("Close", "Volume")})


def bonds(df: DataFrame) -> DataFrame:
    """Date, Ticker, Yield: month-start rows of two tickers."""
    return df.where(F.col("Ticker").isin(*BONDS) & (F.dayofmonth("Date") == 1)).select("Date", "Ticker", (F.col("Close") - 100).alias("Yield"))
