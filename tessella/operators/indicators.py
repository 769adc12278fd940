"""Technical indicators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import blocks
from tessella.functions.windows import KEY, TIME, lagged, last_rows, ratio, rolling, so_far
from tessella.operators.returns import price_of
from tessella.sources.scratch import settled


def ema(df: DataFrame, means: Mapping[str, tuple[str, int]], seeded: int | None = None, index: str = "_i") -> DataFrame:
    """df (with row numbers in `index`) with a column for each of means (column, span): the exponential mean up to here.

    Plain: all values so far, weighted by (1 - 2 / (span + 1))^age. seeded: the mean of the span values up to the one of
    number `seeded` (from 1; the longest span by default) starts it, before which it is null; then each value moves it by
    2 / (span + 1) of its distance. Null values are skipped: they have no age and move nothing. Both are scans, so nothing
    is cut off and a ticker's history is many tasks' work.
    """
    if seeded is None:
        maps = {}
        for name, (c, span) in means.items():
            keep, there = F.lit(1 - 2 / (span + 1)), F.col(c).isNotNull()
            maps |= {f"_n_{name}": (F.when(there, keep).otherwise(1.0), F.coalesce(c, F.lit(0.0))), f"_d_{name}": (F.when(there, keep).otherwise(1.0), there.cast("double"))}
        out = blocks.scan(df, maps, index)
        return out.withColumns({name: ratio(F.col(f"_n_{name}"), F.col(f"_d_{name}")) for name in means}).drop(*maps)
    columns = sorted({c for c, _ in means.values()})
    x = blocks.running(df, {f"_c_{c}": F.col(c).isNotNull().cast("long") for c in columns})
    maps = {}
    for name, (c, span) in means.items():
        at, step, there = F.col(f"_c_{c}"), 2 / (span + 1), F.col(c).isNotNull()
        share = F.when(there & (at > seeded - span) & (at <= seeded), F.col(c) / span).otherwise(0.0)
        a = F.when(~there, 1.0).when(at <= seeded - span, 0.0).when(at <= seeded, 1.0).otherwise(1 - step)
        maps[name] = (a, F.when(there & (at > seeded), F.col(c) * step).otherwise(share))
    out = blocks.scan(x, maps, index)
    return out.withColumns({name: F.when(F.col(f"_c_{c}") >= seeded, F.col(name)) for name, (c, _) in means.items()}).drop(*(f"_c_{c}" for c in columns))


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, seeded: bool = False) -> DataFrame:
    """MACD, MACD_Signal, MACD_Histogram from exponential means of the price; df has one row for a ticker and date.

    seeded: both means start from simple ones that end at the first row where the slow one is full, the signal likewise
    from the first `signal` differences; all three are null before the signal is there, and on rows without a price.
    """
    p = price_of(df)
    x = settled(blocks.numbered(df.select(KEY, TIME, p)), "prices")
    x = ema(x, {"_fast": (p, fast), "_slow": (p, slow)}, max(fast, slow) if seeded else None).withColumn("MACD", F.col("_fast") - F.col("_slow"))
    if seeded:
        x = x.withColumn("MACD", F.when(F.col(p).isNotNull(), F.col("MACD")))
    x = ema(settled(x.select(KEY, TIME, "_i", "MACD"), "macd"), {"MACD_Signal": ("MACD", signal)}, signal if seeded else None)
    if seeded:
        there = F.col("MACD").isNotNull() & F.col("MACD_Signal").isNotNull()
        x = x.withColumns({c: F.when(there, F.col(c)) for c in ("MACD", "MACD_Signal")})
    return _beside(df, x.select(KEY, TIME, "MACD", "MACD_Signal", (F.col("MACD") - F.col("MACD_Signal")).alias("MACD_Histogram")))


def _beside(df: DataFrame, found: DataFrame) -> DataFrame:
    """df with the columns of found (Ticker, Date, ...), one row for each of its rows."""
    names = [c for c in found.columns if c not in (KEY, TIME)]
    found = found.withColumnsRenamed({KEY: "_of_key", TIME: "_of_time"})
    return df.drop(*names).join(found, F.col(KEY).eqNullSafe(F.col("_of_key")) & F.col(TIME).eqNullSafe(F.col("_of_time")), "left").drop("_of_key", "_of_time")


def macd_sma(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Simple instead of exponential means, from the first row on."""
    p = price_of(df)
    out = df.withColumns({"EMA_Fast": F.avg(p).over(last_rows(fast)), "EMA_Slow": F.avg(p).over(last_rows(slow))})
    out = out.withColumn("MACD", F.col("EMA_Fast") - F.col("EMA_Slow")).withColumn("MACD_Signal", F.avg("MACD").over(last_rows(signal)))
    return out.withColumn("MACD_Histogram", F.col("MACD") - F.col("MACD_Signal"))


def rsi(df: DataFrame, n: int = 14, wilder: bool = False) -> DataFrame:
    """By simple means of gains and losses; the first row counts as no change. 100 without losses, null without either.

    wilder: the means of the first n changes start it, and each further change moves them by a n-th of its distance; 0
    without gains and losses. A row without a price, or after one, changes nothing.
    """
    p = price_of(df)
    if wilder:
        x = blocks.with_halo(df.select(KEY, TIME, p), 1, lambda d: d.withColumn("_change", F.col(p) - lagged(p)), number="_i")
        x = settled(blocks.running(settled(x.drop(p), "changes"), {"_at": F.col("_change").isNotNull().cast("long")}), "numbered-changes")
        part = lambda v: (
            F.when(F.col("_change").isNull() | (F.col("_at") <= n), 1.0).otherwise(1 - 1 / n), F.coalesce(v, F.lit(0.0)) / n,
        )
        x = blocks.scan(x, {"_up": part(F.greatest("_change", F.lit(0.0))), "_down": part(F.greatest(-F.col("_change"), F.lit(0.0)))})
        value = F.coalesce(100 * ratio(F.col("_up"), F.col("_up") + F.col("_down")), F.lit(0.0))
        return _beside(df, x.select(KEY, TIME, F.when(F.col("_at") >= n, value).alias("RSI")))
    change = df.withColumn("_change", F.col(p) - lagged(p))
    gain = F.when(F.col("_change") > 0, F.col("_change")).otherwise(0.0)
    loss = F.when(F.col("_change") < 0, -F.col("_change")).otherwise(0.0)
    up, down = rolling(F.avg, gain, n), rolling(F.avg, loss, n)
    return change.withColumn("RSI", F.when((down == 0) & (up > 0), 100.0).otherwise(100 - ratio(F.lit(100.0), 1 + ratio(up, down)))).drop("_change")


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, population: bool = False) -> DataFrame:
    """Mean of n prices, k deviations above and below, and where between these the price is; deviations of the sample, or of the population."""
    p = F.col(price_of(df))
    mid, std = rolling(F.avg, p, n), rolling(F.stddev_pop if population else F.stddev, p, n)
    out = df.withColumns({"BB_Middle": mid, "BB_Upper": mid + std * k, "BB_Lower": mid - std * k})
    return out.withColumn("BB_Position", ratio(p - F.col("BB_Lower"), F.col("BB_Upper") - F.col("BB_Lower")))


def moving_averages(df: DataFrame, periods: Sequence[int] = (5, 10, 20, 50, 200)) -> DataFrame:
    p = F.col(price_of(df))
    means = {n: rolling(F.avg, p, n) for n in periods}
    return df.withColumns({f"MA_{n}": m for n, m in means.items()} | {f"Price_MA_{n}_Ratio": ratio(p, m) for n, m in means.items()})


def volume(df: DataFrame, periods: Sequence[int] = (10, 20, 50)) -> DataFrame:
    """Volume_MA_n, Volume_Ratio, and with Return also PVT and OBV; df itself without Volume."""
    if "Volume" not in df.columns:
        return df
    v = F.col("Volume")
    out = {f"Volume_MA_{n}": rolling(F.avg, v, n) for n in periods}
    if 20 in periods:
        out["Volume_Ratio"] = ratio(v, out["Volume_MA_20"])
    if "Return" in df.columns:
        out |= {"PVT": F.sum(F.col("Return") * v).over(so_far()), "OBV": F.sum(v * F.signum("Return")).over(so_far())}
    return df.withColumns(out)
