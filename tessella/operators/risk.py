"""Rolling risk measures of Return."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.windows import KEY, TIME, YEAR, last_rows, ratio, rolling
from tessella.operators.returns import WINDOWS, downside, downside_clipped

LEVELS = (0.05, 0.1, 0.9, 0.95)


def volatility(df: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Volatility_n, annual, and Vol_Vol_n, its own rolling deviation: a second window layer on the same sort."""
    out = df.withColumns({f"Volatility_{n}": rolling(F.stddev, F.col("Return"), n) * YEAR**0.5 for n in windows})
    return out.withColumns({f"Vol_Vol_{n}": rolling(F.stddev, F.col(f"Volatility_{n}"), n) for n in windows})


def rolling_std(df: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    return df.withColumns({f"Return_Std_{n}": rolling(F.stddev, F.col("Return"), n) for n in windows})


def sharpe(df: DataFrame, windows: Sequence[int] = WINDOWS, risk_free: float = 0.02) -> DataFrame:
    excess = F.col("Return") - risk_free / YEAR
    return df.withColumns({f"Sharpe_Ratio_{n}": ratio(rolling(F.avg, excess, n), rolling(F.stddev, F.col("Return"), n)) for n in windows})


def sortino(df: DataFrame, windows: Sequence[int] = WINDOWS, risk_free: float = 0.02, clipped: bool = False) -> DataFrame:
    excess = F.col("Return") - risk_free / YEAR
    under = downside_clipped if clipped else downside
    return df.withColumns({f"Sortino_Ratio_{n}": ratio(rolling(F.avg, excess, n), under(n)) for n in windows})


def _drawdown(n: int):
    """Least (value - peak) / peak inside the last n compounded returns, the first value being the first peak."""
    r = F.collect_list("Return").over(last_rows(n))
    start = F.struct(F.lit(1.0).alias("c"), F.lit(None).cast("double").alias("peak"), F.lit(None).cast("double").alias("low"))

    def step(acc, x):
        c = acc["c"] * (1 + x)
        peak = F.greatest(acc["peak"], c)
        return F.struct(c.alias("c"), peak.alias("peak"), F.least(acc["low"], F.try_divide(c - peak, peak)).alias("low"))

    return F.when(F.count("Return").over(last_rows(n)) >= n, F.aggregate(r, start, step, lambda acc: acc["low"]))


def max_drawdown(df: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    return df.withColumns({f"Max_Drawdown_{n}": _drawdown(n) for n in windows})


def var_cvar(df: DataFrame, levels: Sequence[float] = LEVELS, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """VaR_a_n: interpolated quantile; CVaR_a_n: mean of the returns at or below it. One sorted array a window size serves all levels."""
    out = df.withColumns({f"_r_{n}": F.collect_list("Return").over(last_rows(n)) for n in windows})
    out = out.withColumns({f"_r_{n}": F.when(F.size(f"_r_{n}") >= n, F.array_sort(f"_r_{n}")) for n in windows})

    def quantile(a: float, n: int):
        low, part = int(a * (n - 1)), a * (n - 1) % 1
        x, y = F.get(f"_r_{n}", F.lit(low)), F.get(f"_r_{n}", F.lit(min(low + 1, n - 1)))
        return x * (1 - part) + y * part

    out = out.withColumns({f"VaR_{a}_{n}": quantile(a, n) for a in levels for n in windows})

    def mean_below(a: float, n: int):
        cut = F.col(f"`VaR_{a}_{n}`")
        tail = F.filter(f"_r_{n}", lambda x: x <= cut)
        return F.when(cut.isNotNull(), F.try_divide(F.aggregate(tail, F.lit(0.0), lambda s, x: s + x), F.size(tail)))

    return out.withColumns({f"CVaR_{a}_{n}": mean_below(a, n) for a in levels for n in windows}).drop(*(f"_r_{n}" for n in windows))


def var_parametric(df: DataFrame, levels: Sequence[float] = LEVELS, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """The normal proxy mean + 1.645 deviations, alike for every level; CVaR equals it."""
    value = {n: rolling(F.avg, F.col("Return"), n) + 1.645 * rolling(F.stddev, F.col("Return"), n) for n in windows}
    return df.withColumns({f"{k}_{a}_{n}": value[n] for k in ("VaR", "CVaR") for a in levels for n in windows})


def with_benchmark(df: DataFrame, ticker: str, name: str = "Benchmark_Return") -> DataFrame:
    """Each date's return of one ticker. It has a row a date at most, and Spark broadcasts it if that proves small."""
    other = df.where(F.col(KEY) == ticker).select(TIME, F.col("Return").alias(name))
    return df.join(other, TIME, "left")


def beta(df: DataFrame, benchmark: str = "Benchmark_Return", windows: Sequence[int] = WINDOWS) -> DataFrame:
    """Sample covariance over population variance of the benchmark, both over pairs; null below two pairs or without spread."""
    r, b = F.col("Return"), F.when(F.col("Return").isNotNull(), F.col(benchmark))

    def one(n: int):
        w = last_rows(n)
        pairs = F.count(b).over(w)
        return F.when((F.count(r).over(w) >= n) & (pairs >= 2), ratio(F.covar_samp(r, b).over(w), F.var_pop(b).over(w)))

    return df.withColumns({f"Beta_{n}": one(n) for n in windows})


def var_sketched(df: DataFrame, levels: Sequence[float] = LEVELS, months: int = 12, k: int = 4096) -> DataFrame:
    """Ticker, Month, n, VaR_a: quantiles of the returns of the last `months` months, from one sketch a month.

    A month's returns go into a KLL sketch once, map-side; months are merged, so a window of any length costs as many
    sketches as it has months, whatever the rows. Ranks are off by about 2.3 / k ** 0.9 of n at most (99 % sure), and not
    at all while a sketch holds everything (k values or fewer). A quantile is the least return with a share of a at or
    below it. Months without returns have no row.
    """
    month = F.trunc(TIME, "month")
    part = df.where(F.col("Return").isNotNull()).groupBy(KEY, month.alias("Month")).agg(F.kll_sketch_agg_double("Return", k).alias("s"))
    ahead = F.explode(F.sequence("Month", F.add_months("Month", months - 1), F.expr("INTERVAL 1 MONTH"))).alias("Month")
    spread = part.select(KEY, F.col("Month").alias("_of"), "s").withColumnRenamed("_of", "Month").select(KEY, ahead, "s")
    merged = spread.groupBy(KEY, "Month").agg(F.kll_merge_agg_double("s", k).alias("s")).join(part.select(KEY, "Month"), [KEY, "Month"])
    return merged.select(KEY, "Month", F.kll_sketch_get_n_double("s").alias("n"), *(F.kll_sketch_get_quantile_double("s", F.lit(float(a))).alias(f"VaR_{a}") for a in levels))
