"""Corporate-action adjustment. A missing Adj Close means factor 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.windows import ratio

OHLC = ("Open", "High", "Low", "Close")
ADJUSTED = "Adj Close"


def _factor(df: DataFrame) -> Column:
    return ratio(F.col(f"`{ADJUSTED}`"), F.col("Close")) if ADJUSTED in df.columns else F.lit(1.0)


def splits(df: DataFrame) -> DataFrame:
    r = _factor(df)
    return df.withColumns({"Split_Ratio": r} | {f"{c}_Split_Adj": F.col(c) * r for c in OHLC} | {"Volume_Split_Adj": ratio(F.col("Volume"), r)})


def dividends(df: DataFrame) -> DataFrame:
    r = _factor(df)
    return df.withColumns({"Dividend_Adj_Factor": r} | {f"{c}_Dividend_Adj": F.col(c) * r for c in OHLC})


def factors(df: DataFrame) -> DataFrame:
    """Total = split * dividend; an absent or null split ratio is 1."""
    total = _factor(df)
    split = F.coalesce(F.col("Split_Ratio"), F.lit(1.0)) if "Split_Ratio" in df.columns else F.lit(1.0)
    return df.withColumns({"Total_Adj_Factor": total, "Split_Adj_Factor": split, "Dividend_Adj_Factor": ratio(total, split)})


def apply(df: DataFrame, use_adjusted_close: bool = True) -> DataFrame:
    """Open_Adj to Close_Adj: from Adj Close; as they are without it; or by the split and dividend steps."""
    if not use_adjusted_close:
        out = dividends(splits(df))
        return out.withColumns({f"{c}_Adj": F.col(f"{c}_Dividend_Adj") for c in OHLC})
    if ADJUSTED not in df.columns:
        return df.withColumns({f"{c}_Adj": F.col(c) for c in OHLC})
    r = _factor(df)
    return df.withColumns({f"{c}_Adj": F.col(c) * r for c in OHLC[:-1]} | {"Close_Adj": F.col(f"`{ADJUSTED}`")})
