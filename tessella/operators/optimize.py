"""Quadratic programmes of a portfolio by the critical line: all solutions of min w'Cw / 2 - g mu'w over {sum w = 1,
low <= w <= high}, for every g from infinity to 0, as corner portfolios between which weights are straight lines.

Least variance is the corner at g = 0; a return or a variance that is asked for lies between two corners, where one is
linear and the other quadratic. So every answer is exact, without search or steps. The matrix of the assets is on the
driver, 8 bytes for each pair, once; assets are the rows of an aggregate, and no number of them is refused.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.windows import KEY
from tessella.operators.portfolio import max_sharpe_weights

METHODS = ("max_sharpe", "min_variance", "min_volatility", "max_return", "efficient_frontier")


@dataclass(frozen=True)
class Moments:
    """Expected returns and covariance of assets in order of name."""

    names: tuple[str, ...]
    mu: np.ndarray
    cov: np.ndarray


def collect_moments(mu: DataFrame, cov: DataFrame) -> Moments:
    """Bring moments to the driver: two columns of assets, and their covariances as numbered cells in Arrow."""
    m = mu.select(KEY, "mu").toPandas().sort_values(KEY)
    names = m[KEY].tolist()
    c = np.zeros((len(names), len(names)))
    if names:
        number = mu.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), "name string, nr int")
        at = lambda k: number.select(F.col("name").alias(f"asset_{k}"), F.col("nr").alias(k))
        cells = cov.join(at("i"), "asset_i").join(at("j"), "asset_j").select("i", "j", "cov").toArrow()
        c[cells["i"].to_numpy(), cells["j"].to_numpy()] = np.nan_to_num(cells["cov"].to_numpy())
    return Moments(tuple(names), np.nan_to_num(m["mu"].to_numpy(float)), c)


def best_return(x: Moments, low: float, high: float) -> np.ndarray:
    """argmax mu'w, all of the room to the highest means."""
    w, left = np.full(len(x.mu), float(low)), 1 - low * len(x.mu)
    for i in np.lexsort((np.arange(len(x.mu)), -x.mu)):
        w[i] += max(0.0, min(left, high - low))
        left -= w[i] - low
    return w


def _trace(c: np.ndarray, mu: np.ndarray, low: float, high: float, w: np.ndarray, free: np.ndarray, up: np.ndarray, may: np.ndarray) -> tuple[list[float], list[np.ndarray]]:
    """(g, w) of the corners from g = infinity, where w is best, to 0; of the assets that may change, free ones lie between the bounds.

    w, free and up (at the upper bound) end as they are at g = 0.
    """
    g, out, moved, flat = np.inf, [w.copy()], -1, 1e-12 * max(np.ptp(mu), 1e-300)
    at_g = [np.inf]
    for _ in range(50 * len(w) + 100):
        f, b = np.flatnonzero(free), np.flatnonzero(~free)
        k = np.zeros((len(f) + 1,) * 2)
        k[:-1, :-1], k[:-1, -1], k[-1, :-1] = c[np.ix_(f, f)], -1, 1
        right = np.zeros((len(f) + 1, 2))
        right[:-1, 0], right[-1, 0], right[:-1, 1] = -c[np.ix_(f, b)] @ w[b], 1 - w[b].sum(), mu[f]
        try:
            both = np.linalg.solve(k, right)
        except np.linalg.LinAlgError:
            both = np.linalg.lstsq(k, right, rcond=None)[0]
        (alpha, beta), (a0, a1) = both[:-1].T, both[-1]
        if np.ptp(mu[f]) == 0:
            beta, a1 = np.zeros(len(f)), -mu[f[0]]
        o = b[may[b]]
        with np.errstate(divide="ignore", invalid="ignore"):
            meets = np.where(beta > 1e-14, (low - alpha) / beta, np.where(beta < -1e-14, (high - alpha) / beta, -np.inf))
            p = c[np.ix_(o, f)] @ alpha + c[np.ix_(o, b)] @ w[b] - a0
            q = c[np.ix_(o, f)] @ beta - mu[o] - a1
            leaves = np.where(np.where(up[o], q < -flat, q > flat), -p / q, -np.inf)
        at, place = np.r_[meets, leaves], np.r_[f, o]
        at[(place == moved) & (at >= g * (1 - 1e-9))] = -np.inf  # what has just changed does not change back here
        at = np.minimum(at, g)
        i = int(np.argmax(at)) if len(at) else 0
        if not len(at) or not at[i] > 0:
            w[f] = alpha
            return [*at_g, 0.0], [*out, w.clip(low, high)]
        g, moved = at[i], int(place[i])
        w[f] = alpha + g * beta
        if free[moved]:
            free[moved], up[moved] = False, w[moved] > (low + high) / 2
            w[moved] = high if up[moved] else low
        else:
            free[moved] = True
        at_g.append(float(g))
        out.append(w.clip(low, high))
    raise ArithmeticError("the path of corner portfolios does not end")


def path(x: Moments, low: float, high: float) -> tuple[list[float], list[np.ndarray]]:
    """(g, weights) of the corner portfolios from the highest return to the least variance; weights between two of them are straight lines.

    At each corner one asset meets a bound or leaves it. Where assets of equal means share what is left of the highest
    return, the path begins with the shares of least variance, the end of a path of their own.
    """
    n = len(x.mu)
    if not n:
        return [0.0], [np.zeros(0)]
    mu = x.mu - x.mu.mean()  # a constant changes nothing, but its digits would
    order = np.lexsort((np.arange(n), -x.mu))
    w = best_return(x, low, high)
    raised = [i for i in order if w[i] > low + 1e-15]
    last = raised[-1] if raised else order[0]
    same = x.mu == x.mu[last]
    free = np.arange(n) == last
    up = (w > (low + high) / 2) & ~free
    if same.sum() > 1:
        rank = np.zeros(n)
        rank[order] = -np.arange(n)
        _trace(x.cov, rank, low, high, w, free, up, same)
    return _trace(x.cov, mu, low, high, w, free, up, np.ones(n, bool))


def corners(x: Moments, low: float, high: float) -> list[np.ndarray]:
    return path(x, low, high)[1]


def solve(x: Moments, low: float, high: float, g: float = 0.0) -> np.ndarray:
    """argmin w'Cw - g mu'w."""
    at, w = path(x, low, high)
    i = int(np.flatnonzero(np.array(at) >= g / 2)[-1])
    if i + 1 == len(at) or at[i] == np.inf:
        return w[min(i + 1, len(at) - 1)] if at[i] == np.inf else w[i]
    return w[i] + (at[i] - g / 2) / (at[i] - at[i + 1]) * (w[i + 1] - w[i])


def spread(x: Moments, w: np.ndarray) -> float:
    return float(w @ x.cov @ w)


def feasible(n: int, low: float, high: float) -> bool:
    return n > 0 and n * low <= 1 + 1e-12 and n * high >= 1 - 1e-12


def min_variance(x: Moments, least: float = 0.01, most: float = 0.5) -> tuple[np.ndarray, str]:
    n = len(x.mu)
    return (corners(x, least, most)[-1], "optimal") if feasible(n, least, most) else (np.full(n, 1 / max(n, 1)), "fallback")


def max_return(x: Moments, most: float = 0.4, variance: float = 0.04) -> tuple[np.ndarray, str]:
    """Highest return with weights in [0, most] and variance within its limit."""
    n = len(x.mu)
    if not feasible(n, 0.0, most):
        return np.full(n, 1 / max(n, 1)), "fallback"
    ends = corners(x, 0.0, most)
    if spread(x, ends[0]) <= variance:
        return ends[0], "optimal"
    for before, after in zip(ends, ends[1:], strict=False):
        if spread(x, after) <= variance:
            step = after - before
            a, b, c = spread(x, step), 2 * before @ x.cov @ step, spread(x, before) - variance
            t = -2 * c / (b - max(b * b - 4 * a * c, 0.0) ** 0.5)  # the lesser root
            return before + min(max(t, 0.0), 1.0) * step, "optimal"
    return np.full(n, 1 / n), "fallback"


def least_risk_at(x: Moments, ends: list[np.ndarray], target: float) -> np.ndarray | None:
    """Least variance with return of `target` or more, on the path of corners; None if out of reach."""
    returns = np.array([w @ x.mu for w in ends])
    if target > returns[0] + 1e-12 or not len(x.mu):
        return None
    if target <= returns[-1]:
        return ends[-1]
    i = int(np.flatnonzero(returns >= min(target, returns[0]))[-1])
    if i + 1 == len(ends) or returns[i] <= returns[i + 1]:
        return ends[i]
    t = (returns[i] - target) / (returns[i] - returns[i + 1])
    return ends[i] + min(max(t, 0.0), 1.0) * (ends[i + 1] - ends[i])


def residual(x: Moments, w: np.ndarray, g: float, low: float, high: float) -> float:
    """By how much w fails the conditions of optimality at g: bounds, sum, and one gradient for all assets between the bounds."""
    d = x.cov @ w - g * x.mu
    inner = (w > low + 1e-12) & (w < high - 1e-12)
    at = np.median(d[inner]) if inner.any() else np.clip(0.0, d[w >= high - 1e-12].max(initial=-np.inf), d[w <= low + 1e-12].min(initial=np.inf))
    off = np.where(inner, np.abs(d - at), np.where(w >= high - 1e-12, np.maximum(d - at, 0), np.maximum(at - d, 0)))
    return float(max(off.max(initial=0.0), abs(w.sum() - 1), (low - w).max(initial=0.0), (w - high).max(initial=0.0)))


def frontier(spark: SparkSession, x: Moments, points: int = 100, most: float = 0.4) -> DataFrame:
    """target_id, ret, vol, sharpe, weights (map) of the efficient frontier; targets out of reach are left out."""
    rows = []
    if feasible(len(x.mu), 0.0, most):
        ends = corners(x, 0.0, most)
        for k, target in enumerate(np.linspace(x.mu.min(), x.mu.max(), points)):
            if (w := least_risk_at(x, ends, target)) is not None:
                ret, vol = float(w @ x.mu), spread(x, w) ** 0.5
                rows.append((k, ret, vol, ret / vol if vol > 0 else 0.0, dict(zip(x.names, map(float, w), strict=True))))
    return spark.createDataFrame(rows, "target_id long, ret double, vol double, sharpe double, weights map<string,double>")


def best_of(points: DataFrame) -> DataFrame:
    """The frontier point with the highest Sharpe ratio; of equal ones the first."""
    return points.agg(F.max_by(F.struct(*points.columns), F.struct("sharpe", (-F.col("target_id")).alias("t"))).alias("x")).select("x.*")


def optimize(mu: DataFrame, cov: DataFrame, method: str | None = None, least: float = 0.01, most: float = 0.5) -> tuple[DataFrame, dict]:
    """(Ticker, weight; expected return, volatility, Sharpe, status) by one of METHODS, max_sharpe by default."""
    method = method or "max_sharpe"
    if method not in METHODS:
        raise ValueError(f"method {method!r} is none of {METHODS}")
    spark = mu.sparkSession
    if method == "max_sharpe":  # in closed form: nothing but three sums comes to the driver
        w = max_sharpe_weights(mu, least=least, most=most).select(KEY, "weight", "mu")
        sums = w.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("weight") * F.nanvl("mu", F.lit(0.0))), F.lit(0.0)).alias("ret")).first()
        i, j = (w.select(F.col(KEY).alias(f"asset_{k}"), F.col("weight").alias(f"w_{k}")) for k in "ij")
        both = cov.join(i, "asset_i").join(j, "asset_j").agg(F.coalesce(F.sum(F.nanvl("cov", F.lit(0.0)) * F.col("w_i") * F.col("w_j")), F.lit(0.0)).alias("v")).first().v
        return w.select(KEY, "weight"), _said(sums.ret, both, "optimal" if feasible(sums.n, least, most) else "fallback")
    x = collect_moments(mu, cov)
    status = "optimal"
    if method in ("min_variance", "min_volatility"):
        w, status = min_variance(x, least, most)
    elif method == "max_return":
        w, status = max_return(x)
    else:
        best = best_of(frontier(spark, x)).first()
        w = np.array([best["weights"][n] for n in x.names])
    rows = [(n, float(v)) for n, v in zip(x.names, w, strict=True)]
    return spark.createDataFrame(rows, f"{KEY} string, weight double"), _said(float(w @ x.mu), spread(x, w), status)


def _said(ret: float, squared: float, status: str) -> dict:
    vol = max(squared, 0.0) ** 0.5
    return {"expected_return": ret, "volatility": vol, "sharpe_ratio": ret / vol if vol > 0 else 0.0, "optimization_status": status}
