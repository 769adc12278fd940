"""The end-to-end flow: clean, adjust, returns, features, allocation, backtest, results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tessella.functions.windows import by_key, nan_to_null, numeric_columns
from tessella.operators import adjust, clean, features, indicators, optimize, portfolio, returns, risk, sentiment
from tessella.plans.config import Config
from tessella.sources import io
from tessella.sources.scratch import settled


def process_assets(df: DataFrame, config: Config | None = None) -> DataFrame:
    """Gaps filled, prices adjusted, returns and basic features.

    preprocessing.adjust_splits and .adjust_dividends add the columns of their steps; with either on, returns are those of
    the adjusted close.
    """
    c = config or Config()
    out = clean.handle_missing(nan_to_null(df), c.get("preprocessing.missing_data_strategy", "forward_fill"))
    by_splits, by_dividends = c.get("preprocessing.adjust_splits", True), c.get("preprocessing.adjust_dividends", True)
    if by_splits:
        out = adjust.splits(out)
    if by_dividends:
        out = adjust.dividends(out)
    if by_splits or by_dividends:
        out = adjust.apply(out)
    return returns.basic_features(returns.returns(out, log=c.get("preprocessing.use_log_returns", True)))


def process_bonds(df: DataFrame, lags: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    out = returns.yield_changes(clean.handle_missing(nan_to_null(df)))
    return returns.lags(out, "Yield_Change", lags)


def all_indicators(df: DataFrame, config: Config) -> DataFrame:
    """The technical indicators by their configured periods."""
    t = lambda path, default: config.get(f"features.technical.{path}", default)
    out = indicators.macd(df, t("macd.fast_period", 12), t("macd.slow_period", 26), t("macd.signal_period", 9), t("macd.seeded", False))
    out = indicators.rsi(by_key(out), t("rsi.period", 14), t("rsi.wilder", False))
    out = indicators.bollinger(out, t("bollinger_bands.period", 20), t("bollinger_bands.std_dev", 2.0), t("bollinger_bands.population", False))
    return indicators.volume(indicators.moving_averages(out))


def all_risk(df: DataFrame, config: Config) -> DataFrame:
    """The risk measures over the configured windows, by the configured risk-free rate and levels; betas where there is a benchmark."""
    windows, rate = config.get("features.rolling.windows", list(returns.WINDOWS)), config.get("evaluation.metrics.risk_free_rate", 0.02)
    out = risk.sortino(risk.sharpe(risk.volatility(df, windows), windows, rate), windows, rate)
    out = risk.var_cvar(risk.max_drawdown(out, windows), config.get("models.monte_carlo.confidence_levels", list(risk.LEVELS)), windows)
    return risk.beta(out, windows=windows) if "Benchmark_Return" in out.columns else out


def engineer(df: DataFrame, columns: Sequence[str] | None = None, news: DataFrame | None = None, benchmark: str | None = None, config: Config | None = None, scale: bool = False) -> DataFrame:
    """Indicators, risk, rolling statistics and lags of the named columns, sentiment, interactions; all of it scaled at last.

    columns: all numeric ones of df by default, not those that the steps before add, of which a thousand would grow tenfold.
    Every layer is windows over (Ticker, Date), so the whole chain keeps one partitioning. scale: every numeric column
    becomes (x - mean) / deviation in place, which runs the chain once more for the moments; store it first, or leave it out.
    df is stored first, as benchmark, means and windows would each compute it anew from its sources.
    """
    c = config or Config()
    columns = list(columns or numeric_columns(df))
    windows = c.get("features.rolling.windows", list(returns.WINDOWS))
    out = settled(df, "panel")
    out = risk.with_benchmark(out, benchmark) if benchmark else out
    out = all_risk(all_indicators(out, c), c)
    out = features.rolling_stats(out, columns, windows, c.get("features.rolling.metrics", list(features.METRICS)))
    out = features.lag_features(out, columns)
    if news is not None:
        out = sentiment.process(out, news)
    out = features.interactions(out)
    return features.scale_in_place(out) if scale else out


def baseline(df: DataFrame, config: Config | None = None) -> dict[str, DataFrame]:
    """Moments, weights, backtest and metrics of a panel with Return. models.baseline.backtest_costs takes transaction costs off the backtest."""
    c = config or Config()
    r = portfolio.long_returns(df)
    mu, cov = portfolio.expected_returns(r), portfolio.covariance(r)
    weights, _ = optimize.optimize(mu, cov, c.get("models.baseline.optimization_method"))
    frequency = c.get("models.baseline.rebalance_frequency", "monthly")
    series = portfolio.portfolio_returns(r, weights)
    return {
        "expected_returns": mu, "covariance_matrix": cov, "portfolio_weights": weights, "backtest_results": portfolio.backtest(r, frequency, cost=c.get("models.baseline.transaction_costs", 0.001) if c.get("models.baseline.backtest_costs", False) else 0.0),
        "portfolio_metrics": portfolio.metrics(series, risk_free=c.get("evaluation.metrics.risk_free_rate", 0.02)),
    }


def run(assets: DataFrame, bonds: DataFrame | None = None, bond_tickers: Sequence[str] = (), news: DataFrame | None = None, folder: str | None = None, config: Config | None = None) -> dict[str, DataFrame]:
    """All of it; with a folder the processed panel and the features are kept as Parquet, results as CSV."""
    panel = process_assets(assets, config)
    if bonds is not None:
        panel = portfolio.bond_columns(panel, process_bonds(bonds), bond_tickers)
    if folder:
        io.save(panel, f"{folder}/processed", partition_by=["Ticker"])
        panel = io.load(assets.sparkSession, f"{folder}/processed")
    table = engineer(panel, news=news, config=config)
    if folder:
        table = io.cached(assets.sparkSession, f"{folder}/features", lambda: table)
    table = features.scale_in_place(table)
    results = baseline(panel, config)
    if folder:
        io.save_results(results, f"{folder}/results")
    return {"features": table, **results}


def run_model(spark, path: str, config: Config | None = None) -> dict[str, DataFrame]:
    """Only the model, from a stored panel."""
    return baseline(io.load(spark, path), config)
