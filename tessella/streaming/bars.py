"""Daily bars from a stream of ticks, late ticks included up to a watermark: an extension to the batch panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bars(ticks: DataFrame, key: str = "event_type", time: str = "ts", price: str = "value", late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Ticker, Date, Open, High, Low, Close, Volume (ticks) of a stream or a table of ticks."""
    x = ticks.select(F.col(key).alias("Ticker"), F.col(time).cast("timestamp").alias("t"), F.col(price).cast("double").alias("p"))
    by = x.withWatermark("t", late).groupBy("Ticker", F.window("t", width))
    out = by.agg(F.min_by("p", "t").alias("Open"), F.max("p").alias("High"), F.min("p").alias("Low"), F.max_by("p", "t").alias("Close"), F.count("*").cast("double").alias("Volume"))
    return out.select("Ticker", F.col("window.start").cast("date").alias("Date"), "Open", "High", "Low", "Close", "Volume")
