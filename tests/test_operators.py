"""Hand-made edge panels and properties of the panel operators."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import adjust, clean, features, indicators, optimize, portfolio, returns, risk, sentiment
from tessella.plans import api, pipeline
from tessella.plans.config import Config
from tessella.sources import io

PANEL = "Ticker string, Date date, Open double, High double, Low double, Close double, Volume double"


def day(i):
    return dt.date(2020, 1, 1) + dt.timedelta(days=i)


def make(spark, closes, volume=10.0):
    """closes: ticker -> list of closes, None for a gap."""
    rows = [(t, day(i), c, c, c, c, volume) for t, xs in closes.items() for i, c in enumerate(xs)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, PANEL)


def column(df, name, ticker="A"):
    return [r[0] for r in df.where(F.col("Ticker") == ticker).orderBy("Date").select(name).collect()]


def walk(n, seed=0, start=100.0):
    rnd = random.Random(seed)
    out = [start]
    for _ in range(n - 1):
        out.append(out[-1] * (1 + rnd.gauss(0, 0.01)))
    return out


def test_first_return_of_each_ticker_is_null(spark):
    df = returns.returns(make(spark, {"B": [1.0, 2.0], "A": [10.0, 5.0]}), log=False)
    assert column(df, "Return") == [None, -0.5] and column(df, "Return", "B") == [None, 1.0]


def test_zero_and_negative_prices_have_no_log_return(spark):
    df = returns.returns(make(spark, {"A": [1.0, 0.0, -1.0, 2.0]}))
    assert column(df, "Return") == [None, None, None, None]


def test_one_row_per_ticker(spark):
    df = pipeline.process_assets(make(spark, {"A": [1.0], "B": [2.0]}))
    assert df.count() == 2 and column(df, "Volatility") == [None]


def test_rsi_ends(spark):
    up, flat = [float(i) for i in range(1, 20)], [5.0] * 19
    df = indicators.rsi(make(spark, {"A": up, "B": flat, "C": up[::-1]}))
    assert column(df, "RSI")[12:14] == [None, 100.0]
    assert column(df, "RSI", "B")[-1] is None and column(df, "RSI", "C")[-1] == pytest.approx(0)


def test_constant_price_has_no_ratios(spark):
    df = returns.returns(make(spark, {"A": [3.0] * 30}))
    df = risk.sharpe(indicators.bollinger(df), [5])
    assert column(df, "BB_Position")[-1] is None and column(df, "Sharpe_Ratio_5")[-1] is None


def test_fills(spark):
    df = make(spark, {"A": [None, 1.0, None, None, 4.0, None], "B": [None, None, None, None, None, 9.0]})
    assert column(clean.forward_fill(df), "Close") == [None, 1, 1, 1, 4, 4]
    assert column(clean.backward_fill(df), "Close") == [1, 1, 4, 4, 4, None]
    assert column(clean.interpolate(df), "Close") == pytest.approx([None, 1, 2, 3, 4, 4], nan_ok=True) or column(clean.interpolate(df), "Close") == [None, 1, 2, 3, 4, 4]
    assert column(clean.fill_both(df), "Close", "B") == [9] * 6
    assert column(clean.handle_missing(df, "interpolate"), "Close") == [1, 1, 2, 3, 4, 4]
    assert clean.handle_missing(df, "drop").count() == 3 and column(clean.handle_missing(df, "zero"), "Close")[0] == 0
    with pytest.raises(ValueError):
        clean.handle_missing(df, "guess")


def test_trading_days_drop_weekends_and_add_weekdays(spark):
    rows = [("A", dt.date(2024, 1, d), 1.0, 1.0, 1.0, float(d), 1.0) for d in (1, 3, 6, 8)]  # Mon, Wed, Sat, Mon
    df = clean.trading_days(spark.createDataFrame(rows, PANEL))
    assert [r.Date.day for r in df.orderBy("Date").collect()] == [1, 2, 3, 4, 5, 8]
    assert column(df, "Close") == [1, 1, 3, 3, 3, 8]


def test_nan_becomes_null(spark):
    df = clean.forward_fill(pipeline.nan_to_null(make(spark, {"A": [1.0, float("nan"), 3.0]})))
    assert column(df, "Close") == [1, 1, 3]


def test_quality_and_missing(spark):
    df = make(spark, {"A": [1.0, float("inf"), -2.0, None]}, volume=0.0)
    q = {r.metric: r.value for r in clean.quality_report(df).collect()}
    assert q["infinite_values"] == 4 and q["negative_prices"] == 4 and q["zero_volumes"] == 4 and q["remaining_missing"] == 4
    m = {(r.scope, r.key): r.value for r in clean.missing_report(df).collect()}
    assert m["missing_by_ticker", "A"] == 4 and m["missing_by_date", str(day(3))] == 4 and m["missing_by_column", "Volume"] == 0


def test_adjustment_without_adjusted_close(spark):
    df = make(spark, {"A": [4.0]})
    assert column(adjust.apply(df), "Close_Adj") == [4.0] and column(adjust.splits(df), "Split_Ratio") == [1.0]
    with_ratio = adjust.factors(df.withColumn("Split_Ratio", F.lit(None).cast("double")))
    assert column(with_ratio, "Dividend_Adj_Factor") == [1.0]


def test_drawdown_and_tail_bounds(spark):
    df = returns.returns(make(spark, {"A": walk(80), "B": walk(80, 1)}))
    x = risk.var_cvar(risk.max_drawdown(df, [21]), [0.05, 0.9], [21]).toPandas().dropna()
    assert len(x) and x["Max_Drawdown_21"].between(-1, 0).all()
    assert (x["CVaR_0.05_21"] <= x["VaR_0.05_21"] + 1e-15).all() and (x["VaR_0.05_21"] <= x["VaR_0.9_21"]).all()


def test_rolling_moments_match_pandas(spark):
    df = returns.returns(make(spark, {"A": walk(60)}))
    got = features.rolling_stats(df, ["Return"], [10]).orderBy("Date").toPandas()
    roll = got["Return"].rolling(10)
    for name, want in {"Mean": roll.mean(), "Std": roll.std(), "Min": roll.min(), "Max": roll.max(), "Skew": roll.skew(), "Kurtosis": roll.kurt()}.items():
        assert np.allclose(got[f"Return_Rolling_{name}_10"].astype(float), want, equal_nan=True, atol=1e-8), name


def test_macd_matches_pandas(spark):
    closes = walk(150)
    got = indicators.macd(make(spark, {"A": closes})).orderBy("Date").toPandas()
    s = pd.Series(closes)
    macd = s.ewm(span=12).mean() - s.ewm(span=26).mean()
    assert np.allclose(got["MACD"], macd) and np.allclose(got["MACD_Signal"], macd.ewm(span=9).mean())


def test_order_of_rows_does_not_matter(spark):
    df = make(spark, {"A": walk(40), "B": walk(40, 3)})
    run = lambda x: risk.volatility(returns.returns(x), [5]).orderBy("Ticker", "Date").toPandas()
    pd.testing.assert_frame_equal(run(df), run(df.orderBy(F.desc("Date")).repartition(3)))


def test_weights_are_feasible(spark):
    mu = lambda n: spark.createDataFrame([(f"t{i}", float(i % 7)) for i in range(n)], "Ticker string, mu double")
    for n, low, high in ((5, 0.01, 0.5), (1, 0.01, 0.5), (3, 0.4, 0.5), (12, 0.0, 0.1), (10, 0.0, 1.0)):
        w = [r.weight for r in portfolio.max_sharpe_weights(mu(n), least=low, most=high).collect()]
        assert sum(w) == pytest.approx(1)
        if n * low <= 1 <= n * high:
            assert all(low - 1e-12 <= x <= high + 1e-12 for x in w)


def moments(n=6, seed=0):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(40, n)) * rng.uniform(0.5, 2, n)
    return optimize.Moments(tuple(f"t{i}" for i in range(n)), rng.normal(size=n), np.cov(a.T))


def test_minimum_variance_is_optimal():
    x = moments()
    w, status = optimize.min_variance(x, 0.01, 0.5)
    assert status == "optimal" and w.sum() == pytest.approx(1) and (w >= 0.01 - 1e-12).all() and (w <= 0.5 + 1e-12).all()
    g = 2 * x.cov @ w
    inner = (w > 0.01 + 1e-6) & (w < 0.5 - 1e-6)
    level = g[inner].mean()
    assert np.allclose(g[inner], level, atol=1e-5)
    assert (g[w <= 0.01 + 1e-6] >= level - 1e-5).all() and (g[w >= 0.5 - 1e-6] <= level + 1e-5).all()
    assert optimize.min_variance(x, 0.3, 0.5)[1] == "fallback"


def test_maximum_return_keeps_its_variance():
    x = moments()
    loose, _ = optimize.max_return(x, variance=100.0)
    assert np.allclose(loose, optimize.best_return(x, 0, 0.4)) and loose.sum() == pytest.approx(1)
    least = optimize.solve(x, 0.0, 0.4)
    limit = 1.3 * least @ x.cov @ least
    tight, status = optimize.max_return(x, variance=limit)
    assert status == "optimal" and tight @ x.cov @ tight == pytest.approx(limit, rel=1e-3) and least @ x.mu <= tight @ x.mu <= loose @ x.mu


def test_frontier(spark):
    x = moments(4)
    rows = optimize.frontier(spark, x, points=9).orderBy("target_id").collect()
    targets = np.linspace(x.mu.min(), x.mu.max(), 9)
    assert rows and all(r.ret >= targets[r.target_id] - 1e-6 for r in rows)
    assert all(a.vol <= b.vol + 1e-9 for a, b in zip(rows, rows[1:], strict=False))
    assert optimize.best_of(optimize.frontier(spark, x, points=9)).first().sharpe == pytest.approx(max(r.sharpe for r in rows))


def test_optimize_methods(spark):
    r = portfolio.long_returns(returns.returns(make(spark, {t: walk(120, i) for i, t in enumerate("ABC")})))
    mu, cov = portfolio.expected_returns(r), portfolio.covariance(r)
    for m in optimize.METHODS:
        w, said = optimize.optimize(mu, cov, m)
        assert sum(x.weight for x in w.collect()) == pytest.approx(1, abs=1e-6) and said["volatility"] > 0
    with pytest.raises(ValueError):
        optimize.optimize(mu, cov, "luck")
    with pytest.raises(ValueError):
        portfolio.expected_returns(r, "luck")
    with pytest.raises(ValueError):
        portfolio.covariance(r, "luck")


def test_backtest_starts_equal_and_cost_lowers(spark):
    closes = {t: walk(120, i) for i, t in enumerate("ABC")}
    r = portfolio.long_returns(returns.returns(make(spark, closes), log=False))
    x = portfolio.backtest(r, "weekly").orderBy("Date").toPandas()
    day_one = np.mean([closes[t][1] / closes[t][0] - 1 for t in closes])
    assert x["Portfolio_Return"][0] == pytest.approx(day_one) and len(x) == 119
    net = portfolio.backtest(r, "weekly", cost=0.01).orderBy("Date").toPandas()
    assert (net["Portfolio_Return"] <= x["Portfolio_Return"] + 1e-12).all() and net["Cumulative_Return"].iloc[-1] < x["Cumulative_Return"].iloc[-1]


def test_disjoint_calendars(spark):
    rows = [("A", day(i), *[1.0 + i] * 4, 1.0) for i in range(10)] + [("B", day(20 + i), *[5.0 + i] * 4, 1.0) for i in range(10)]
    r = portfolio.long_returns(returns.returns(spark.createDataFrame(rows, PANEL)))
    cov = portfolio.covariance(r).toPandas()
    assert set(zip(cov.asset_i, cov.asset_j, strict=True)) == {("A", "A"), ("B", "B")}
    assert portfolio.returns_matrix(r, ["A", "B"]).count() == 18


def test_metrics_identities(spark):
    series = spark.createDataFrame([(day(i), x) for i, x in enumerate([0.01, -0.02, 0.03, -0.01, 0.005] * 20)], "Date date, Portfolio_Return double")
    m = portfolio.metrics(series).first()
    assert m.annualized_return == pytest.approx((1 + m.total_return) ** (252 / 100) - 1)
    assert -1 <= m.max_drawdown <= 0 and m.cvar_95 <= m.var_95 and m.volatility > 0
    flat = portfolio.metrics(spark.createDataFrame([(day(i), 0.0) for i in range(5)], "Date date, Portfolio_Return double")).first()
    assert flat.sharpe_ratio is None and flat.sortino_ratio == 0 and flat.total_return == 0


def test_sentiment(spark):
    pages = spark.createDataFrame([(i, "".join(f"<h3 class='x title y'> Strong <b>growth</b> {j}</h3><h3>other words here</h3><h3>short</h3>" for j in range(8))) for i in range(3)], "page_id long, html string")
    got = sentiment.headlines(pages, F.lit("A"), "h3", "title").collect()
    assert len(got) == 10 and got[0].headline.startswith("Strong growth")
    texts = spark.createDataFrame([("A", "Strong growth, no risk"), ("A", "nothing"), ("B", None)], "Ticker string, headline string")
    s = {(r.Ticker, r.headline): r for r in sentiment.score_texts(texts).collect()}
    assert s["A", "Strong growth, no risk"].POSITIVE == pytest.approx(2 / 3) and s["A", "nothing"].NEUTRAL == 1.0
    out = sentiment.process(make(spark, {"A": [1.0], "C": [2.0]}), texts)
    again = sentiment.process(out, texts)  # a second run replaces, not collides
    assert again.columns == out.columns and column(again, "Sentiment_Score", "C") == [0.0]


def test_headlines_of_sites(spark):
    page = "".join(f"<h3 class='x Mb(5px)'>Strong growth here {j}</h3><h3 class='Mb(5px)x'>of another class</h3><h3 class='search-result-title'>A loss reported {j}</h3>" for j in range(12))
    pages = spark.createDataFrame([(0, "yahoo", page), (1, "reuters", page), (2, "other", page), (3, "bloomberg", None)], "page_id long, site string, html string")
    got = [r.headline for r in sentiment.site_headlines(pages, F.lit("A"), F.col("site")).collect()]
    assert sorted(got) == sorted([f"Strong growth here {j}" for j in range(10)] + [f"A loss reported {j}" for j in range(10)])
    out = sentiment.process_pages(make(spark, {"A": [1.0], "C": [2.0]}), pages, F.lit("A"), F.col("site"))
    assert column(out, "Sentiment_Positive", "A") == [0.5] and column(out, "Sentiment_Neutral", "C") == [1.0]


def test_backtest_plan_holds_no_tickers(spark):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), t, 0.001 * ((i * k) % 7 - 3)) for i in range(80) for k, t in ((1, "UNIQ_A"), (2, "UNIQ_B"), (5, "UNIQ_C")) if t != "UNIQ_C" or i < 3]
    x = portfolio.backtest(spark.createDataFrame(rows, "Date date, Ticker string, Return double"), "weekly")
    assert x.count() == 80
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert "UNIQ" not in plan


def test_sources_and_sinks(spark, tmp_path):
    df = make(spark, {"A": [1.0, 2.0]}).select("Date", "Ticker", "Open", "High", "Low", "Close", "Volume")
    for fmt in io.FORMATS:
        io.save(df, f"{tmp_path}/{fmt}", fmt)
        assert sorted(io.load(spark, f"{tmp_path}/{fmt}", fmt, io.panel_schema()).collect()) == sorted(df.collect())
    with pytest.raises(ValueError):
        io.load(spark, "x", "xls")
    with pytest.raises(ValueError):
        io.save(df, "x", "xls")
    assert io.first_of(spark, [(f"{tmp_path}/none", "parquet"), (f"{tmp_path}/csv", "csv")], io.panel_schema()).count() == 2
    with pytest.raises(FileNotFoundError):
        io.first_of(spark, [(f"{tmp_path}/none", "csv")])
    made = []
    for _ in range(2):
        assert io.cached(spark, f"{tmp_path}/cache", lambda: made.append(1) or df).count() == 2
    assert made == [1]
    assert '"Ticker":"A"' in io.to_records(df).first()["json"]


def test_pipeline_writes_results(spark, tmp_path):
    df = make(spark, {t: walk(90, i) for i, t in enumerate("ABC")}).withColumn("Adj Close", F.col("Close"))
    bonds = spark.createDataFrame([("X", day(i * 30), 2.0 + i) for i in range(3)], "Ticker string, Date date, Yield double")
    out = pipeline.run(df, bonds, ["X"], folder=str(tmp_path))
    assert out["features"].where("X_Yield IS NOT NULL").count() == 9
    assert spark.read.option("header", True).csv(f"{tmp_path}/results/portfolio_weights").count() == 3
    assert pipeline.run_model(spark, f"{tmp_path}/processed")["portfolio_metrics"].count() == 1


def test_service(spark):
    df = make(spark, {t: walk(90, i) for i, t in enumerate("ABC")})
    weights, _, said = api.optimise(df, {"tickers": ["A", "B", "C"], "risk_tolerance": "high", "max_position": 0.9})
    assert max(r.weight for r in weights.collect()) == pytest.approx(0.5) and said["optimization_status"] == "optimal"
    with pytest.raises(ValueError):
        api.optimise(df, {"tickers": []})
    assert portfolio.risk_cap("low", 0.5) == 0.15 and portfolio.risk_cap("medium", 0.6) == 0.6
    assert api.health(spark).first().status == "healthy" and api.methods(spark).count() == 4


def test_config(tmp_path):
    c = Config()
    assert c["features.technical.rsi.period"] == 14 and "models.baseline" in c and c.get("a.b", 3) == 3 and c.problems() == []
    with pytest.raises(KeyError):
        c["no.such"]
    c.set("data.assets.stocks", ["A"])
    c.override({"RISK_FREE_RATE": "0.05", "RAW_DATA_PATH": "/x"})
    assert c["evaluation.metrics.risk_free_rate"] == 0.05 and c["data.raw_path"] == "/x" and c.tickers() == ["A"]
    assert c.override({"RISK_FREE_RATE": "much"})["evaluation.metrics.risk_free_rate"] == 0.05
    c.save(f"{tmp_path}/c.json")
    assert Config.load(f"{tmp_path}/c.json").values == c.values
    assert Config({"data": {}}).problems()


def test_stream_bars(spark, tmp_path):
    from tessella.streaming.bars import bars

    rows = [("k", dt.datetime(2024, 1, d, h), float(d * 100 + h)) for d in (1, 2, 9) for h in (1, 5, 9)]
    ticks = spark.createDataFrame(rows, "event_type string, ts timestamp, value double")
    ticks.write.parquet(f"{tmp_path}/in")
    stream = bars(spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("append").format("memory").queryName("bars").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {r.Date.day: r for r in spark.table("bars").collect()}
    assert set(got) == {1, 2} and (got[1].Open, got[1].High, got[1].Close, got[1].Volume) == (101.0, 109.0, 109.0, 3.0)
    assert math.isclose(bars(ticks).where("Date = '2024-01-09'").first().Low, 901.0)


def test_vendor_source(spark):
    from tessella.sources.vendor import download, provider

    def fetch(ticker, start, end):
        for i in range(3):
            yield (dt.date.fromisoformat(start) + dt.timedelta(days=i), ticker, 1.0, 2.0, 0.5, 1.5 + i, 10.0)

    df = download(spark, provider(fetch), ["A", "B"], "2020-01-01", "2020-02-01")
    assert df.count() == 6 and column(df, "Close") == [1.5, 2.5, 3.5]


def test_scaling_in_place(spark):
    """Every numeric column, names with dots too, has mean 0 and deviation 1; one without spread is 0; nulls stay."""
    df = spark.createDataFrame([("a", 1.0, 5.0, 2), ("a", 3.0, 5.0, None), ("b", 8.0, 5.0, 6)], "Ticker string, `VaR_0.05_5` double, Flat double, N int")
    got = features.scale_in_place(df)
    assert got.columns == df.columns
    x = got.toPandas()
    assert abs(x["VaR_0.05_5"].mean()) < 1e-12 and abs(x["VaR_0.05_5"].std(ddof=0) - 1) < 1e-12
    assert (x["Flat"] == 0).all() and sorted(x["N"].dropna()) == [-1.0, 1.0]


def test_request_defaults(spark):
    """What a request leaves out, dates included, comes from the service's defaults; the summary says so."""
    from tessella.plans import api

    days = [f"20{y}-0{m}-15" for y in (19, 20, 21, 22, 23, 24) for m in range(1, 10)]
    rows = [(t, d, 100.0 + (7 * i + 13 * k) % 11) for k, t in enumerate("abcde") for i, d in enumerate(days)]
    panel = spark.createDataFrame(rows, "Ticker string, d string, Close double").selectExpr("Ticker", "to_date(d) AS Date", "Close")
    weights, _, said = api.optimise(panel, {"tickers": list("abcde"), "max_position": None})
    top = max(r.weight for r in weights.collect())
    assert abs(top - 0.3) < 1e-9
    assert said["data_summary"]["date_range"] == "2020-01-01 to 2024-01-01" and said["data_summary"]["data_points"] == 35
    assert said["data_summary"]["lookback_period"] == 252 and said["data_summary"]["tickers"] == list("abcde")
