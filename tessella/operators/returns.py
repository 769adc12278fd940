"""Returns, yields, lags and the basic rolling features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.windows import YEAR, lagged, last_days, last_rows, ratio, rolling, so_far

WINDOWS = (5, 10, 21, 63)


def price_of(df: DataFrame) -> str:
    return "Close_Adj" if "Close_Adj" in df.columns else "Close"


def _log_ratio(c: str) -> Column:
    r = ratio(F.col(c), lagged(c))
    return F.when(r > 0, F.ln(r))


def returns(df: DataFrame, log: bool = True) -> DataFrame:
    """Return, Return_Abs, Return_Squared from the adjusted close, else the close."""
    p = price_of(df)
    out = df.withColumn("Return", _log_ratio(p) if log else ratio(F.col(p), lagged(p)) - 1)
    return out.withColumns({"Return_Abs": F.abs("Return"), "Return_Squared": F.col("Return") * F.col("Return")})


def yield_changes(df: DataFrame, column: str = "Yield") -> DataFrame:
    before = lagged(column)
    return df.withColumns({"Yield_Change": F.col(column) - before, "Yield_Change_Pct": ratio(F.col(column), before) - 1, "Yield_Change_Log": _log_ratio(column)})


def rolling_returns(df: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    out = {}
    for n in windows:
        mean, std = rolling(F.avg, F.col("Return"), n), rolling(F.stddev, F.col("Return"), n)
        out |= {f"Return_Rolling_Mean_{n}": mean, f"Return_Rolling_Std_{n}": std, f"Return_Rolling_Sharpe_{n}": ratio(mean, std)}
    return df.withColumns(out)


def calendar_means(df: DataFrame, columns: Sequence[str] = ("Return",), days: Sequence[int] = (30, 90)) -> DataFrame:
    """{column}_Mean_{n}d: means over the last n days by the calendar, gaps or not; null without values."""
    return df.withColumns({f"{c}_Mean_{n}d": F.avg(c).over(last_days(n)) for c in columns for n in days})


def compounded() -> Column:
    """Product of 1 + Return up to here, less 1."""
    return F.product(1 + F.col("Return")).over(so_far()) - 1


def cumulative(df: DataFrame, log: bool = True) -> DataFrame:
    return df.withColumn("Cumulative_Return", F.sum("Return").over(so_far()) if log else compounded())


def downside(n: int, value: Column | None = None) -> Column:
    """Deviation of the negative values among the last n, all n being there; null below two of them."""
    r = F.col("Return") if value is None else value
    w = last_rows(n)
    return F.when(F.count(r).over(w) >= n, F.stddev(F.when(r < 0, r)).over(w))


def downside_clipped(n: int) -> Column:
    """The proxy that counts other values as 0."""
    return rolling(F.stddev, F.when(F.col("Return") < 0, F.col("Return")).when(F.col("Return").isNotNull(), F.lit(0.0)), n)


def sharpe_sortino(df: DataFrame, risk_free: float = 0.02, n: int = 21) -> DataFrame:
    out = df.withColumn("Excess_Return", F.col("Return") - risk_free / YEAR)
    mean = rolling(F.avg, F.col("Excess_Return"), n)
    return out.withColumns({"Sharpe_Ratio": ratio(mean, rolling(F.stddev, F.col("Return"), n)), "Sortino_Ratio": ratio(mean, downside(n)), "Sortino_Ratio_Clipped": ratio(mean, downside_clipped(n))})


def lags(df: DataFrame, column: str = "Return", ks: Sequence[int] = (1, 2, 3, 4, 5), mark: str = "Lag") -> DataFrame:
    return df.withColumns({f"{column}_{mark}{k}": lagged(column, k) for k in ks})


def basic_features(df: DataFrame) -> DataFrame:
    """Five lags, 21-row volatility, mean and Sharpe, compounded return."""
    std, mean = rolling(F.stddev, F.col("Return"), 21), rolling(F.avg, F.col("Return"), 21)
    return lags(df).withColumns({"Volatility": std, "Rolling_Mean_Return": mean, "Rolling_Sharpe": ratio(mean, std), "Cumulative_Return": compounded()})


def ml_ready(df: DataFrame) -> DataFrame:
    """The training table of one panel: simple returns, basic features, complete rows only."""
    return basic_features(returns(df, log=False).drop("Return_Abs", "Return_Squared")).dropna()
