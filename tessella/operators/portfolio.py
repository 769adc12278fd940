"""Portfolios over long returns (Date, Ticker, Return): moments, allocation, backtests, metrics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import blocks
from tessella.functions.windows import KEY, TIME, YEAR, ratio
from tessella.operators.asof import asof_join

EVERY = {"daily": 1, "weekly": 5, "monthly": 21, "quarterly": 63}
LOOKBACK, LEAST = 252, 50
#: Assets of a block and days of a span of the matrices that are multiplied in one task.
ASSETS, DAYS = 256, 512
MOMENTS, COVARIANCES = ("mean", "capm", "black_litterman"), ("sample", "shrunk", "ledoit_wolf")


def returns_matrix(r: DataFrame, tickers: Sequence[str]) -> DataFrame:
    """Date and a column per ticker; days on which none traded are left out."""
    return r.groupBy(TIME).pivot(KEY, list(tickers)).agg(F.first("Return", ignorenulls=True)).dropna("all", subset=list(tickers))


def bond_columns(assets: DataFrame, bonds: DataFrame, tickers: Sequence[str], carry: bool = False) -> DataFrame:
    """assets with {ticker}_Yield by exact date; carry: the last yield known on that day, whatever day it is of (an as-of join)."""
    wide = bonds.groupBy(TIME).pivot(KEY, list(tickers)).agg(F.first("Yield", ignorenulls=True)).withColumnsRenamed({t: f"{t}_Yield" for t in tickers})
    return asof_join(assets, wide, [f"{t}_Yield" for t in tickers], by=()) if carry else assets.join(wide, TIME, "left")


def covariance(r: DataFrame, method: str = "sample", shrinkage: float = 0.1) -> DataFrame:
    """asset_i, asset_j, cov in long form; sample: pairwise complete, ddof 1."""
    if method not in COVARIANCES:
        raise ValueError(f"method {method!r} is none of {COVARIANCES}")
    if method == "ledoit_wolf":
        return _ledoit_wolf(r)
    x = r.where(F.col("Return").isNotNull())
    centred = x.join(x.groupBy(KEY).agg(F.avg("Return").alias("m")), KEY).select(TIME, KEY, (F.col("Return") - F.col("m")).alias("Return"))
    value = ratio(F.col("ab") - F.col("a") * F.col("b") / F.col("n"), F.col("n") - 1.0)
    sample = _mirrored(products(centred).select("asset_i", "asset_j", value.alias("cov")))
    if method == "sample":
        return sample
    own = F.col("asset_i") == F.col("asset_j")
    t = sample.where(own).agg(F.avg("cov").alias("v")).first().v
    return sample.withColumn("cov", (1 - shrinkage) * F.col("cov") + F.when(own, shrinkage * F.lit(t).cast("double")).otherwise(0.0))


def products(x: DataFrame, assets: int = ASSETS, days: int = DAYS) -> DataFrame:
    """asset_i, asset_j (not before asset_i), n, a, b, ab: number and sums of both, and of their products, over common days.

    Assets fall into blocks by hash, days into spans. Each pair of blocks meets once a span, as two dense matrices in one
    task, whose products are four matrices there; no row stands for a pair on a day, and only one a span is summed. A task
    has at most 2 * `assets` columns or so and `days` rows. x has one row (Date, Ticker, Return) a day and asset.
    """
    blocks_ = max(1, -(-x.select(KEY).distinct().count() // assets))
    own = F.pmod(F.xxhash64(KEY), F.lit(blocks_)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(blocks_ - 1)), lambda o: F.struct(F.least(own, o).alias("p"), F.greatest(own, o).alias("q")))
    day = F.datediff(TIME, F.lit("1970-01-01"))
    rows = x.select(F.floor(day / days).alias("span"), day.alias("day"), KEY, "Return", own.alias("own"), F.explode(pairs).alias("pair")).select("span", "day", KEY, "Return", "own", "pair.p", "pair.q")

    def multiply(key: tuple, table: pa.Table) -> pa.Table:
        name, name_at = np.unique(table[KEY].to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        day_, day_at = np.unique(table["day"].to_numpy(), return_inverse=True)
        value, there = np.zeros((2, len(day_), len(name)))
        value[day_at, name_at], there[day_at, name_at] = table["Return"].to_numpy(), 1.0
        block = np.zeros(len(name), np.int64)
        block[name_at] = table["own"].to_numpy()
        p, q = np.flatnonzero(block == key[0].as_py()), np.flatnonzero(block == key[1].as_py())
        n, a, b, ab = there[:, p].T @ there[:, q], value[:, p].T @ there[:, q], there[:, p].T @ value[:, q], value[:, p].T @ value[:, q]
        i, j = np.nonzero(n > 0)
        first = name[p[i]] <= name[q[j]] if key[0] != key[1] else p[i] <= q[j]
        turned = ~first if key[0] != key[1] else np.zeros(len(i), bool)
        keep = first | turned
        i, j, turned = i[keep], j[keep], turned[keep]
        turn = lambda u, v: np.where(turned, v, u)
        return pa.table({
            "asset_i": pa.array(turn(name[p[i]], name[q[j]]), pa.string()), "asset_j": pa.array(turn(name[q[j]], name[p[i]]), pa.string()), "n": n[i, j], "a": turn(a[i, j], b[i, j]), "b": turn(b[i, j], a[i, j]), "ab": ab[i, j],
        })

    part = rows.groupBy("p", "q", "span").applyInArrow(multiply, "asset_i string, asset_j string, n double, a double, b double, ab double")
    return part.groupBy("asset_i", "asset_j").agg(*(F.sum(c).alias(c) for c in ("n", "a", "b", "ab")))


def _mirrored(cov: DataFrame) -> DataFrame:
    """Both halves of a symmetric matrix, from one."""
    both = F.array(F.struct("asset_i", "asset_j"), F.struct(F.col("asset_j").alias("asset_i"), F.col("asset_i").alias("asset_j")))
    return cov.select(F.explode(F.when(F.col("asset_i") == F.col("asset_j"), F.slice(both, 1, 1)).otherwise(both)).alias("x"), "cov").select("x.*", "cov")


def _ledoit_wolf(r: DataFrame) -> DataFrame:
    """Shrinkage to a scaled identity with the intensity of Ledoit and Wolf (2004), over days on which all assets traded."""
    x = r.where(F.col("Return").isNotNull())
    p = x.select(KEY).distinct().count()
    days = x.groupBy(TIME).agg(F.count("*").alias("c")).where(F.col("c") == p).select(TIME)
    x = x.join(days, TIME, "left_semi")
    means = x.groupBy(KEY).agg(F.avg("Return").alias("m"))
    x = x.join(means, KEY).select(TIME, KEY, (F.col("Return") - F.col("m")).alias("Return"))
    squares = x.groupBy(TIME).agg(F.sum(F.col("Return") * F.col("Return")).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q")).first()
    n = squares.n
    s = _mirrored(products(x).select("asset_i", "asset_j", (F.col("ab") / F.lit(max(n, 1))).alias("cov")))
    own = F.col("asset_i") == F.col("asset_j")
    t = s.agg(F.sum(F.when(own, F.col("cov"))).alias("trace"), F.sum(F.col("cov") * F.col("cov")).alias("norm")).first()
    if not n:
        return s
    mu = t.trace / p
    d2 = (t.norm - 2 * mu * t.trace + p * mu * mu) / p
    b2 = min((squares.q / n - t.norm) / (p * n), d2)
    keep = 1 - (b2 / d2 if d2 > 0 else 0.0)
    return s.withColumn("cov", keep * F.col("cov") + F.when(own, (1 - keep) * mu).otherwise(0.0))


def expected_returns(r: DataFrame, method: str = "mean", benchmark: str | None = None, risk_free: float = 0.02) -> DataFrame:
    """Ticker, mu (daily).

    capm: from the beta to the benchmark, which is left out; without one the market is the mean of means and beta 1.
    black_litterman: the equilibrium of equal weights at risk aversion 3, without views.
    """
    if method not in MOMENTS:
        raise ValueError(f"method {method!r} is none of {MOMENTS}")
    means = r.groupBy(KEY).agg(F.avg("Return").alias("mu"))
    if method == "mean":
        return means
    if method == "black_litterman":
        cov = covariance(r)
        n = r.select(KEY).distinct().count()
        return cov.groupBy(F.col("asset_i").alias(KEY)).agg((3.0 * F.sum("cov") / n).alias("mu"))
    rf = risk_free / YEAR
    if benchmark is None or not r.where(F.col(KEY) == benchmark).limit(1).count():
        market = means.agg(F.avg("mu").alias("m")).first().m
        return means.select(KEY, F.lit(rf + ((market or 0.0) - rf)).alias("mu"))
    own = r.where(F.col(KEY) == benchmark)
    m = own.agg(F.avg("Return").alias("m"), F.var_samp("Return").alias("v")).first()
    both = r.where(F.col(KEY) != benchmark).join(own.select(TIME, F.col("Return").alias("b")), TIME, "left")
    beta = F.when(F.lit(bool(m.v)), F.covar_samp("Return", "b") / F.lit(m.v or 1.0)).otherwise(1.0)
    return both.groupBy(KEY).agg((rf + beta * (m.m - rf)).alias("mu"))


def max_sharpe_weights(mu: DataFrame, by: Sequence[str] = (), least: float = 0.01, most: float = 0.5) -> DataFrame:
    """mu with weight: the linear programme max mu'w, sum w = 1, least <= w <= most, in closed form per group `by`.

    Everyone gets the least, and the rest goes to the highest means (ties by name), `most` at a time. If the bounds
    cannot sum to 1: equal weights, clipped and scaled to 1. Groups are assets of one portfolio.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    n = F.count(F.lit(1)).over(group)
    rank = F.row_number().over(group.orderBy(F.desc_nulls_last("mu"), KEY)) - 1
    room = most - least
    weight = least + F.greatest(F.lit(0.0), F.least(F.lit(room), (1 - n * least) - rank * room))
    fallback = F.lit(1.0) / n  # equal weights are clipped alike, so scaling restores them
    return mu.withColumn("weight", F.when((n * least > 1) | (n * most < 1), fallback).otherwise(weight))


def portfolio_returns(r: DataFrame, weights: DataFrame, complete: bool = False) -> DataFrame:
    """Date, Portfolio_Return: sum of weight * Return of those that traded; complete: null unless all did."""
    x = r.join(weights.select(KEY, "weight"), KEY)
    value = F.coalesce(F.sum(F.col("Return") * F.col("weight")), F.lit(0.0))
    if complete:
        n = weights.count()
        value = F.when(F.count("Return") == n, value)
    return x.groupBy(TIME).agg(value.alias("Portfolio_Return"))


def _series() -> tuple:
    """Windows over a portfolio's days: one row a day, so one task holds as many rows as there are days."""
    w = Window.partitionBy(F.lit(0)).orderBy(TIME)
    return w, w.rowsBetween(Window.unboundedPreceding, 0)


def drawdowns(series: DataFrame, value: str = "Portfolio_Return") -> DataFrame:
    """series with Wealth, Peak, Drawdown."""
    _, w = _series()
    out = series.withColumn("Wealth", F.product(1 + F.col(value)).over(w))
    return out.withColumn("Peak", F.max("Wealth").over(w)).withColumn("Drawdown", ratio(F.col("Wealth") - F.col("Peak"), F.col("Peak")))


def metrics(series: DataFrame, value: str = "Portfolio_Return", risk_free: float = 0.02) -> DataFrame:
    """One row of nine measures of a daily series, in one run over it."""
    cut = F.percentile(value, F.lit(0.05)).over(Window.partitionBy(F.lit(0)))
    x = drawdowns(series.where(F.col(value).isNotNull()), value).withColumn("_cut", cut)
    r = F.col(value)
    one = x.agg(
        F.product(1 + r).alias("growth"), F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev(r).alias("std"), F.min("Drawdown").alias("low"),
        F.stddev(F.when(r < 0, r)).alias("down"), F.first("_cut").alias("var"), F.avg(F.when(r <= F.col("_cut"), r)).alias("cvar"),
    )
    year = F.lit(float(YEAR))
    vol = F.col("std") * F.sqrt(year)
    sortino = F.coalesce(ratio((F.col("mean") - risk_free / YEAR) * year, F.col("down") * F.sqrt(year)), F.lit(0.0))
    return one.select(
        (F.col("growth") - 1).alias("total_return"), (F.pow("growth", year / F.col("n")) - 1).alias("annualized_return"), vol.alias("volatility"),
        ratio(F.col("mean") * year - risk_free, vol).alias("sharpe_ratio"), F.col("low").alias("max_drawdown"), ratio(F.col("mean") * year, F.abs("low")).alias("calmar_ratio"),
        sortino.alias("sortino_ratio"), F.col("var").alias("var_95"), F.col("cvar").alias("cvar_95"),
    )


def service_metrics(series: DataFrame, value: str = "Portfolio_Return") -> DataFrame:
    """The five measures of the service: Sharpe without a risk-free rate, drawdown on cumulative returns."""
    one = drawdowns(series.where(F.col(value).isNotNull()), value).agg(F.product(1 + F.col(value)).alias("growth"), F.count(value).alias("n"), F.stddev(value).alias("std"), F.min("Drawdown").alias("max_drawdown"))
    year, vol = F.pow("growth", F.lit(float(YEAR)) / F.col("n")) - 1, F.col("std") * F.sqrt(F.lit(float(YEAR)))
    return one.select((F.col("growth") - 1).alias("total_return"), year.alias("annualized_return"), vol.alias("volatility"), ratio(year, vol).alias("sharpe_ratio"), "max_drawdown")


def annualized(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(Ticker, mu; asset_i, asset_j, cov), daily moments times 252."""
    return expected_returns(r).withColumn("mu", F.col("mu") * YEAR), covariance(r).withColumn("cov", F.col("cov") * YEAR)


def backtest(r: DataFrame, frequency: str = "monthly", least: float = 0.01, most: float = 0.5, cost: float = 0.0) -> DataFrame:
    """Date, Portfolio_Return, Cumulative_Return of walk-forward max-Sharpe weights.

    Equal weights at first; at every k-th day with more than 50 days behind it, means over the last 252 days before it
    give new weights. Returns are summed up to the days where a look back begins or ends, and each mean is the difference
    of two such sums: a return goes into one sum, however many rebalances look back on it. cost: share of turnover taken
    on rebalance days, off by default.
    """
    k = EVERY.get(frequency, EVERY["monthly"])
    x = r.where(F.col("Return").isNotNull()).select(TIME, KEY, "Return")
    days = blocks.numbered_all(x.select(TIME).distinct()).withColumn("i", F.col("i").cast("int"))
    x = x.join(days, TIME)
    names = x.select(KEY).distinct()
    n, last = names.count(), x.agg(F.max("i")).first()[0] or 0
    # The first day after i on which a look back ends (a multiple of k) or begins (252 days before one).
    multiple = lambda i: F.ceil((i + 1) / k) * k
    place = F.least(multiple(F.col("i")), multiple(F.col("i") + LOOKBACK) - LOOKBACK).cast("int")
    sums = x.groupBy(KEY, place.alias("place")).agg(F.sum("Return").alias("s"), F.count("*").alias("c"))
    sums = blocks.running(sums, {"s": F.col("s"), "c": F.col("c")}, time="place")
    first = (LEAST // k + 1) * k
    # Assets that did not trade in a window stand last in it: each has a row for every rebalance.
    at = names.select(KEY, F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(k)) if first <= last else F.array().cast("array<int>")).alias("k")).select("k", KEY)
    ends = at.select("k", KEY, F.explode(F.array(F.struct(F.col("k").alias("place"), F.lit(1).alias("sign")), F.struct((F.col("k") - LOOKBACK).alias("place"), F.lit(-1).alias("sign")))).alias("e")).select("k", KEY, "e.*")
    both = asof_join(ends, sums, ["s", "c"], time="place")
    total = lambda c: F.sum(F.col("sign") * F.coalesce(c, F.lit(0)))
    mu = both.groupBy("k", KEY).agg(ratio(total("s"), total("c")).alias("mu"))
    weights = max_sharpe_weights(mu, by=["k"], least=least, most=most).select("k", KEY, "weight")
    now = x.withColumn("k", (F.floor(F.col("i") / k) * k).cast("int")).join(weights, ["k", KEY], "left")
    out = now.groupBy(TIME, "i").agg(F.sum(F.col("Return") * F.coalesce("weight", F.lit(1.0 / max(n, 1)))).alias("Portfolio_Return"))
    if cost:
        out = out.join(_turnover(weights, at, k, n), F.col("i") == F.col("k"), "left").withColumn("Portfolio_Return", F.col("Portfolio_Return") - cost * F.coalesce("traded", F.lit(0.0)))
    _, w_cum = _series()
    return out.withColumn("Cumulative_Return", F.product(1 + F.col("Portfolio_Return")).over(w_cum) - 1).select(TIME, "Portfolio_Return", "Cumulative_Return")


def _turnover(weights: DataFrame, at: DataFrame, k: int, n: int) -> DataFrame:
    before = weights.select((F.col("k") + k).alias("k"), KEY, F.col("weight").alias("old"))
    change = F.abs(F.col("weight") - F.coalesce("old", F.lit(1.0 / max(n, 1))))
    return weights.join(before, ["k", KEY], "left").groupBy("k").agg(F.sum(change).alias("traded"))


def rebalance(current: DataFrame, target: DataFrame, cost: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """(Ticker, change, new_weight; one row transaction_costs, turnover) of going from one (Ticker, weight) to another.

    A ticker on one side only has no change.
    """
    both = current.select(KEY, F.col("weight").alias("old")).join(target.select(KEY, F.col("weight").alias("new_weight")), KEY, "full").withColumn("change", F.col("new_weight") - F.col("old"))
    sums = both.agg((F.coalesce(F.sum(F.abs("change")), F.lit(0.0)) * cost).alias("transaction_costs"), (F.coalesce(F.sum(F.abs("change")), F.lit(0.0)) / 2).alias("turnover"))
    return both.select(KEY, "change", "new_weight"), sums


def risk_cap(tolerance: str, most: float) -> float:
    """The largest weight that a risk tolerance allows."""
    return {"low": min(most, 0.15), "high": min(most, 0.5)}.get(tolerance, most)


def long_returns(df: DataFrame) -> DataFrame:
    return df.where(F.col("Return").isNotNull()).select(TIME, KEY, "Return")
