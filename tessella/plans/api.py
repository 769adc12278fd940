"""Requests as functions: optimise, backtest, and the static tables of the service. HTTP itself is out of scope."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import clean, optimize, portfolio, returns

# What a request says by default, and what the service offers.
DATES: dict[str, Any] = {"start_date": "2020-01-01", "end_date": "2024-01-01"}
DEFAULTS: dict[str, Any] = DATES | {
    "risk_tolerance": "medium", "max_position": 0.3, "risk_free_rate": 0.04, "optimization_method": "max_sharpe",
    "rebalancing_frequency": "monthly", "transaction_costs": 0.001, "min_weight": 0.01, "lookback_period": 252,
}
SUGGESTIONS = {
    "stocks": ("AAPL", "MSFT", "GOOGL", "AMZN", "TSLA", "META", "NVDA", "NFLX", "AMD", "INTC"),
    "etfs": ("SPY", "QQQ", "VTI", "VOO", "ARKK", "XLF", "XLK", "XLE", "XLI", "XLV"),
    "crypto": ("BTC-USD", "ETH-USD", "ADA-USD", "DOT-USD", "LINK-USD"),
    "bonds": ("^TNX", "^FVX", "^TYX", "TLT", "IEF", "SHY"),
}
METHODS = {
    "max_sharpe": ("Maximum Sharpe Ratio", "Optimizes for the highest risk-adjusted return (return per unit of risk)", "Balanced portfolios seeking optimal risk-return tradeoff"),
    "min_volatility": ("Minimum Volatility", "Minimizes portfolio volatility while maintaining diversification", "Conservative investors prioritizing capital preservation"),
    "max_return": ("Maximum Return", "Maximizes expected portfolio return within risk constraints", "Aggressive investors willing to accept higher volatility"),
    "efficient_frontier": ("Efficient Frontier", "Finds optimal portfolios along the efficient frontier curve", "Advanced users seeking frontier optimization"),
}


def _returns(panel: DataFrame, request: Mapping[str, Any]) -> DataFrame:
    wanted = list(request.get("tickers") or [])
    if not wanted:
        raise ValueError("no tickers")
    q = DATES | {k: v for k, v in request.items() if v is not None}
    x = clean.between(panel.where(F.col("Ticker").isin(wanted)), q["start_date"], q["end_date"])
    return portfolio.long_returns(returns.returns(x, log=False))


def optimise(panel: DataFrame, request: Mapping[str, Any]) -> tuple[DataFrame, DataFrame, dict]:
    """(Ticker, weight; the nine metrics; return, volatility, Sharpe, status and data_summary) from annual moments of simple returns.

    DEFAULTS stand for what the request leaves out, its dates included; the end date itself is out.
    """
    q = DEFAULTS | {k: v for k, v in request.items() if v is not None}
    r = _returns(panel, q)
    mu, cov = portfolio.annualized(r)
    weights, said = optimize.optimize(mu, cov, q["optimization_method"], q["min_weight"], portfolio.risk_cap(q["risk_tolerance"], q["max_position"]))
    summary = {k: q[k] for k in ("tickers", *DEFAULTS) if k not in DATES} | {"date_range": f"{q['start_date']} to {q['end_date']}", "data_points": r.select("Date").distinct().count()}
    return weights, portfolio.metrics(portfolio.portfolio_returns(r, weights), risk_free=q["risk_free_rate"]), said | {"data_summary": summary}


def backtest(panel: DataFrame, request: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
    """(Date, Portfolio_Return, Cumulative_Return; the service's metrics) of fixed weights; days without all assets are null."""
    r = _returns(panel, request)
    rows = [(t, float(w)) for t, w in request["weights"].items()]
    series = portfolio.portfolio_returns(r, panel.sparkSession.createDataFrame(rows, "Ticker string, weight double"), complete=True)
    full = portfolio.drawdowns(series.where("Portfolio_Return IS NOT NULL"))
    return full.select("Date", "Portfolio_Return", (F.col("Wealth") - 1).alias("Cumulative_Return")), portfolio.service_metrics(series)


def suggestions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, t) for k, ts in SUGGESTIONS.items() for t in ts], "kind string, ticker string")


def mentions(listed: DataFrame, texts: DataFrame) -> DataFrame:
    """kind, ticker, documents: how many texts hold each listed name, letters in either case; listed is a fixed, short table."""
    names = [r.ticker for r in listed.select("ticker").distinct().collect()]
    low = F.lower("text")
    counts = texts.agg(*(F.count(F.when(F.contains(low, F.lit(n.lower())), 1)).alias(f"n{i}") for i, n in enumerate(names)))
    rows = counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("ticker"), F.col(f"n{i}").alias("documents")) for i, n in enumerate(names)))).alias("x")).select("x.*")
    return listed.join(rows, "ticker").select("kind", "ticker", "documents")


def methods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in METHODS.items()], "method string, name string, description string, best_for string")


def health(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("healthy").alias("status"), F.current_timestamp().alias("at"))
