"""Long series in blocks: numbering, scans, halos, as-of joins, exact means, against plain loops and pandas."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import blocks
from tessella.operators import features, indicators, portfolio, returns, risk
from tessella.operators.asof import asof_join

PANEL = "Ticker string, Date date, Open double, High double, Low double, Close double, Volume double"


def day(i):
    return dt.date(2018, 3, 1) + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def long(spark):
    """Three tickers of 10 to 1,200 days with missing days and missing prices."""
    rnd = random.Random(2)
    rows = []
    for t, n in (("A", 1200), ("B", 10), ("C", 700)):
        p = 100.0
        for i in range(n):
            p *= 1 + rnd.gauss(0, 0.01)
            if rnd.random() < 0.9:
                rows.append((t, day(i), p, p, p, None if rnd.random() < 0.03 else p, float(rnd.randrange(100))))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, PANEL).repartition(5).cache()


def by_ticker(df):
    return {t: g.reset_index(drop=True) for t, g in df.toPandas().sort_values(["Ticker", "Date"]).groupby("Ticker")}


def test_numbers_and_running_sums(long):
    got = by_ticker(blocks.running(blocks.numbered(long), {"sum": F.col("Volume"), "there": F.col("Close").isNotNull().cast("long")}))
    for g in got.values():
        assert g["_i"].tolist() == list(range(len(g)))
        assert np.allclose(g["sum"].astype(float), g["Volume"].cumsum()) and g["there"].astype(int).tolist() == g["Close"].notna().cumsum().tolist()


def test_last_known(long):
    got, was = by_ticker(blocks.last_known(long, ["Close"])), by_ticker(long)
    for t, g in got.items():
        assert np.allclose(g["Close"].astype(float), was[t]["Close"].ffill(), equal_nan=True)


def test_null_keys_and_times(spark):
    rows = [(None, day(0), 1.0), (None, day(400), None), ("A", None, 5.0), ("A", day(3), None)]
    got = blocks.numbered(blocks.last_known(spark.createDataFrame(rows, "Ticker string, Date date, Close double"), ["Close"])).collect()
    assert sorted((r.Ticker or "", r.Close, r._i) for r in got) == [("", 1.0, 0), ("", 1.0, 1), ("A", 5.0, 0), ("A", 5.0, 1)]


@pytest.mark.parametrize("length,levels", [(32, 2), (3, 1), (4, 3), (1000, 0)])
def test_scan_is_the_recurrence(long, length, levels):
    x = blocks.numbered(long).withColumns({"a": F.when(F.col("Volume") < 5, 0.0).when(F.col("Volume") < 20, 1.0).otherwise(F.col("Volume") / 90), "b": F.coalesce("Close", F.lit(-1.0)) / 10})
    got = by_ticker(blocks.scan(x, {"y": (F.col("a"), F.col("b")), "z": (F.lit(1.0), F.lit(1.0))}, length=length, levels=levels))
    for g in got.values():
        y = 0.0
        for r in g.itertuples():
            y = r.a * y + r.b
            assert r.y == pytest.approx(y, rel=1e-12, abs=1e-12)
        assert g["z"].tolist() == list(range(1, len(g) + 1))


def test_halo_gives_the_undivided_windows(long):
    def layers(d):
        out = risk.volatility(returns.returns(d), [5, 21])
        return features.lag_features(features.rolling_stats(risk.var_cvar(risk.max_drawdown(out, [10]), [0.1], [10]), ["Return"], [10]), ["Volume"], [1, 5])

    whole, parts = by_ticker(layers(long)), by_ticker(blocks.with_halo(long, 45, layers, rows=64))
    for t, g in whole.items():
        pd.testing.assert_frame_equal(parts[t][list(g.columns)], g, rtol=1e-9)


def test_halo_has_many_tasks_for_one_ticker(spark):
    df = spark.range(200_000).select(F.lit("A").alias("Ticker"), F.timestamp_seconds(F.col("id") * 60).alias("Date"), (F.col("id") % 97).cast("double").alias("Return"))
    out = blocks.with_halo(df, 20, lambda d: risk.rolling_std(d, [21]), rows=4096).where("Return_Std_21 IS NOT NULL")
    sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200_000 - 20 and len(sizes) > 1 and max(sizes) < 150_000


def test_exact_means_over_the_whole_history(long):
    got = by_ticker(indicators.macd(long, 12, 300, 9))
    for g in got.values():
        p = g["Close"].astype(float).dropna()
        mean = lambda s, n: s.ewm(span=n).mean()
        m = (mean(p, 12) - mean(p, 300)).reindex(g.index).ffill()
        assert np.allclose(g["MACD"].astype(float), m, equal_nan=True, atol=1e-10)


def seeded(x, n, at):
    out = [None] * len(x)
    out[at] = sum(x[at - n + 1 : at + 1]) / n
    for i in range(at + 1, len(x)):
        out[i] = out[i - 1] + 2 / (n + 1) * (x[i] - out[i - 1])
    return out


def test_seeded_means_and_wilder(long):
    macd, rsi = by_ticker(indicators.macd(long, seeded=True)), by_ticker(indicators.rsi(long, wilder=True))
    for t, g in macd.items():
        there = g["Close"].notna()
        p = g["Close"][there].astype(float).tolist()
        if len(p) < 34:
            assert g["MACD"].isna().all()
            continue
        m = [a - b for a, b in zip(seeded(p, 12, 25)[25:], seeded(p, 26, 25)[25:], strict=True)]
        s = seeded(m, 9, 8)
        assert np.allclose(g["MACD"][there].astype(float).tolist()[33:], m[8:]) and np.allclose(g["MACD_Signal"][there].astype(float).tolist()[33:], s[8:])
        assert g["MACD"][there].isna().tolist()[:33] == [True] * 33
    for g in rsi.values():
        change = g["Close"].astype(float).diff()
        there = change.notna()
        d = change[there].tolist()
        up = down = None
        want = []
        for i in range(len(d)):
            if i < 14:
                up, down = sum(max(x, 0) for x in d[: i + 1]) / 14, sum(max(-x, 0) for x in d[: i + 1]) / 14
            else:
                up, down = (up * 13 + max(d[i], 0)) / 14, (down * 13 + max(-d[i], 0)) / 14
            want.append(np.nan if i < 13 else 100 * up / (up + down))
        assert np.allclose(g["RSI"][there].astype(float), want, equal_nan=True)


def test_wilder_without_changes(spark):
    flat = spark.createDataFrame([("A", day(i), 1.0, 1.0, 1.0, 5.0, 1.0) for i in range(20)], PANEL)
    assert by_ticker(indicators.rsi(flat, wilder=True))["A"]["RSI"].astype(float).tolist()[14:] == [0.0] * 6


def test_asof_takes_what_is_dated_between(spark):
    left = spark.createDataFrame([("A", day(2), 1), ("A", day(6), 2), ("B", day(6), 3), ("A", None, 4), ("A", day(6), 2)], "Ticker string, Date date, n int")
    right = spark.createDataFrame([("A", day(4), 7.0, 1.0), ("A", day(6), 8.0, None), ("B", day(900), 9.0, 1.0)], "Ticker string, Date date, y double, z double")
    rows = lambda df: sorted((r.n, r.y, r.z) for r in df.collect())
    assert rows(asof_join(left, right, ["y", "z"])) == [(1, None, None), (2, 8.0, 1.0), (2, 8.0, 1.0), (3, None, None), (4, None, None)]
    assert rows(asof_join(left, right, ["y", "z"], strict=True)) == [(1, None, None), (2, 7.0, 1.0), (2, 7.0, 1.0), (3, None, None), (4, None, None)]
    assert rows(asof_join(left, right.drop("Ticker"), ["y", "z"], by=())) == [(1, None, None), (2, 8.0, 1.0), (2, 8.0, 1.0), (3, 8.0, 1.0), (4, None, None)]


def test_yield_of_a_day_without_trade_is_carried(spark):
    assets = spark.createDataFrame([("A", day(i), 1.0, 1.0, 1.0, 1.0, 1.0) for i in (0, 5, 400)], PANEL)
    bonds = spark.createDataFrame([(day(3), "X", 2.5), (day(399), "Y", 3.5), (day(400), "X", None)], "Date date, Ticker string, Yield double")
    got = portfolio.bond_columns(assets, bonds, ["X", "Y"], carry=True).orderBy("Date").collect()
    assert [(r["X_Yield"], r["Y_Yield"]) for r in got] == [(None, None), (2.5, None), (2.5, 3.5)]


@pytest.mark.parametrize("frequency", ["daily", "weekly", "monthly", "quarterly"])
def test_backtest_reads_means_from_running_sums(spark, frequency):
    rnd = np.random.default_rng(5)
    rows = [(day(i), t, float(rnd.normal(0, 0.01))) for i in range(420) for t in "ABC" if rnd.random() < (0.9 if t != "C" or i < 80 else 0.0)]
    got = portfolio.backtest(spark.createDataFrame(rows, "Date date, Ticker string, Return double").repartition(3), frequency).orderBy("Date").toPandas()
    wide = pd.DataFrame(rows, columns=["d", "t", "r"]).pivot(index="d", columns="t", values="r").sort_index()
    k, w, want = portfolio.EVERY[frequency], dict.fromkeys("ABC", 1 / 3), []
    for i in range(len(wide)):
        if i % k == 0 and i > 50:
            mean = wide.iloc[max(0, i - 252) : i].mean()
            order = sorted("ABC", key=lambda t: (-mean[t] if mean[t] == mean[t] else np.inf, t))
            w = dict(zip(order, (0.5, 0.49, 0.01), strict=True))
        want.append(sum(w[t] * wide.iloc[i][t] for t in "ABC" if wide.iloc[i][t] == wide.iloc[i][t]))
    assert np.allclose(got["Portfolio_Return"].astype(float), want)


def test_backtest_moves_a_return_once(spark):
    """No row is multiplied by the number of rebalances that look back on it."""
    r = spark.createDataFrame([(day(i), t, 0.01) for i in range(100) for t in "AB"], "Date date, Ticker string, Return double")
    plan = portfolio.backtest(r, "daily")._jdf.queryExecution().optimizedPlan().toString()
    assert all("Return" not in line.split("Generate")[1] for line in plan.splitlines() if "Generate" in line)


@pytest.mark.parametrize("assets,days", [(256, 512), (2, 17), (1, 4000)])
def test_covariance_in_blocks(spark, assets, days, monkeypatch):
    rnd = np.random.default_rng(7)
    names = [f"t{i}é" for i in range(9)]
    rows = [(day(i), t, float(0.5 + rnd.normal(0, 0.01))) for i in range(130) for k, t in enumerate(names) if rnd.random() < 0.8 and not (k == 8 and i > 0)]
    df = spark.createDataFrame(rows, "Date date, Ticker string, Return double")
    x = portfolio.products(df, assets, days).toPandas()
    monkeypatch.setattr(portfolio.products, "__defaults__", (assets, days))
    got = {(r.asset_i, r.asset_j): r["cov"] for r in portfolio.covariance(df).collect()}
    want = pd.DataFrame(rows, columns=["d", "t", "r"]).pivot(index="d", columns="t", values="r").cov(min_periods=1)
    assert (x["asset_i"] <= x["asset_j"]).all() and not x.duplicated(["asset_i", "asset_j"]).any()
    for a in want.columns:
        for b in want.columns:
            have = got.get((a, b))
            assert (have is None and not want.loc[a, b] == want.loc[a, b]) or have == pytest.approx(want.loc[a, b], abs=1e-15)
