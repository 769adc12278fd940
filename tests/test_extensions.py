"""Headlines by tree, calendar frames, sketches, forests, stateful streams, and every configuration key that results depend on."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions.html import parse
from tessella.operators import features, indicators, returns, risk, sentiment
from tessella.plans import pipeline
from tessella.plans.config import Config

PANEL = "Ticker string, Date date, Open double, High double, Low double, Close double, Volume double"


def panel(spark, n=140, tickers="AB"):
    rnd = random.Random(1)
    rows = []
    for t in tickers:
        p = 100.0
        for i in range(n):
            p *= 1 + rnd.gauss(0, 0.02)
            rows.append((t, dt.date(2020, 1, 1) + dt.timedelta(days=i), p, p * 1.01, p * 0.99, p, float(rnd.randrange(1, 100))))
    return spark.createDataFrame(rows, PANEL)


def test_headlines_of_nested_and_odd_markup(spark):
    page = """<!-- <h3 class="Mb(5px)">never shown to anyone</h3> --><h3 class='big Mb(5px)'>Profit &amp; loss of <b>one <i>firm</i></b></h3>
    <h3 class=Mb(5px)>Unquoted classes are classes<script>no()</script></h3><H3 CLASS="x  Mb(5px) y">outer headline <h3 class="Mb(5px)">inner headline</h3> goes on</h3>
    <h3 class="Mb(5px)x">of another class</h3><h3 title="class='Mb(5px)'">not of the class either</h3><h3 class="Mb(5px)">short</h3><h3 class="Mb(5px)">never closed headline"""
    got = sentiment.elements(parse(page), "h3", "Mb(5px)")
    assert got[:5] == ["Profit & loss of one firm", "Unquoted classes are classes", "outer headline inner headline goes on", "inner headline", "short"]
    assert got[5] == "never closed headline" and len(got) == 6
    pages = spark.createDataFrame([(1, "T", "yahoo", page), (2, "T", "else", page), (3, "T", "yahoo", None), (None, None, None, page)], "page_id long, t string, s string, html string")
    rows = sentiment.site_headlines(pages, F.col("t"), F.col("s")).collect()
    assert [r.headline for r in rows] == [x for x in got if len(x) > 10] and {r.Ticker for r in rows} == {"T"}
    assert len(sentiment.site_headlines(pages, F.col("t"), F.col("s"), limit=2).collect()) == 2


def test_headlines_against_a_plain_reader(spark):
    """Random nested markup, with the texts of every element noted while it is written."""
    rnd = random.Random(7)

    def write(depth):
        """(markup, text, [texts of the wanted elements inside, in order])"""
        parts, text, found = [], "", []
        for _ in range(rnd.randrange(1, 4)):
            kind = rnd.choice(["text", "want", "other", "comment"]) if depth else "text"
            if kind == "text":
                word = "".join(rnd.choice("abc") for _ in range(5))
                parts.append(word + rnd.choice(["&amp;", "&#38;", "&lt;x"]) + " ")
                text += word + ("&" if "&lt" not in parts[-1] else "<x") + " "
            elif kind == "comment":
                parts.append("<!-- <a class=hit>no</a> -->")
            else:
                inner, t, f = write(depth - 1)
                quoted = rnd.choice(['class="hit"', "class='hit z'", "class=hit", 'title="a > b" class="y hit"'])
                parts.append(f"<a {quoted}>{inner}</a>" if kind == "want" else f"<span class=no>{inner}</span>")
                found += ([t.strip()] if kind == "want" else []) + f
                text += t
        return "".join(parts), text, found

    for _ in range(200):
        markup, _, want = write(4)
        assert sentiment.elements(parse(markup), "a", "hit") == want


def test_calendar_means(spark):
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=d), float(d)) for d in (0, 1, 2, 40, 41, 60, 90)] + [("B", dt.date(2020, 1, 1), 5.0)]
    got = returns.calendar_means(spark.createDataFrame(rows, "Ticker string, Date date, Return double"), ("Return",), (2, 21)).orderBy("Ticker", "Date").collect()
    assert [r.Return_Mean_2d for r in got] == [0.0, 0.5, 1.5, 40.0, 40.5, 60.0, 90.0, 5.0]
    assert [r.Return_Mean_21d for r in got] == [0.0, 0.5, 1.0, 40.0, 40.5, 47.0, 90.0, 5.0]


def test_sketched_quantiles_keep_their_bound(spark):
    rnd = np.random.default_rng(0)
    n, k = 60_000, 200
    days = pd.date_range("2019-01-01", periods=365 * 2, freq="D").date
    rows = pd.DataFrame({"Ticker": "A", "Date": rnd.choice(days, n), "Return": rnd.normal(size=n)})
    got = risk.var_sketched(spark.createDataFrame(rows, "Ticker string, Date date, Return double").repartition(6), (0.05, 0.5), 12, k).toPandas()
    assert len(got) == 24
    month = pd.to_datetime(rows["Date"]).dt.to_period("M")
    for r in got.itertuples():
        at = pd.Period(r.Month, "M")
        x = np.sort(rows["Return"][(month <= at) & (month > at - 12)].to_numpy())
        assert r.n == len(x)
        for level, value in ((0.05, r[4]), (0.5, r[5])):
            rank = np.searchsorted(x, value, "right") / len(x)
            assert abs(rank - level) <= 2 * 2.3 / k**0.9
    exact = risk.var_sketched(spark.createDataFrame(rows[:800], "Ticker string, Date date, Return double"), (0.1,), 12, 4096).toPandas()
    month = month[:800]
    for r in exact.itertuples():
        at = pd.Period(r.Month, "M")
        x = np.sort(rows["Return"][:800][(month <= at) & (month > at - 12)].to_numpy())
        assert r[4] == x[max(int(np.ceil(0.1 * len(x))) - 1, 0)]


def test_forest_is_reproducible_and_ranks(spark):
    rnd = np.random.default_rng(2)
    x = pd.DataFrame(rnd.normal(size=(1500, 3)), columns=["a", "b", "c"])
    x["y"] = 3 * x.a + x.b * x.b + rnd.normal(size=1500) * 0.1
    df = spark.createDataFrame(x).repartition(4).cache()
    one, two = ({r.feature: r.importance for r in features.forest_importance(df, "y", ["a", "b", "c"]).collect()} for _ in range(2))
    assert one == two and sum(one.values()) == pytest.approx(1) and one["a"] > one["b"] > one["c"]


def test_stream_of_late_ticks_is_the_batch(spark, tmp_path):
    from tessella.streaming.features import features as stream_features
    from tessella.streaming.features import step

    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    ticks = [(i, start + dt.timedelta(minutes=20 * (i // 2), seconds=7 * (i % 2)), rnd.choice("xyz"), round(rnd.uniform(1, 9), 2)) for i in range(600)]
    end = [(10_000 + i, start + dt.timedelta(days=60), k, 5.0) for i, k in enumerate("xyz")]
    late = sorted(ticks, key=lambda t: t[0] + rnd.uniform(0, 60))  # up to ten hours late
    schema = "event_id long, ts timestamp, event_type string, value double"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        def run(part):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            query = stream_features(source).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
            query.awaitTermination(240)
            assert query.exception() is None

        run(late[:300])
        run(late[300:])  # a restart from the checkpoint
        run(end)
        run([(20_000, start + dt.timedelta(days=90), "x", 5.0)])
    finally:
        spark.conf.set(key, before)
    got = {(r.Ticker, r.tie): (r.Return, r.EMA, r.OBV) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.tie < 10_000}
    want = {}
    for k in "xyz":
        state = None
        for i, _, _, v in sorted((t for t in ticks if t[2] == k), key=lambda t: (t[1], t[0])):
            state, want[k, i] = step(state, v, 1.0, 12)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, nan_ok=True) or (v[0] is None and got[k][1:] == pytest.approx(v[1:]))


KEYS = {
    "preprocessing.adjust_splits": False, "preprocessing.use_log_returns": False, "preprocessing.missing_data_strategy": "zero",
    "features.technical.macd.fast_period": 5, "features.technical.macd.slow_period": 40, "features.technical.macd.signal_period": 3, "features.technical.macd.seeded": True,
    "features.technical.rsi.period": 7, "features.technical.rsi.wilder": True, "features.technical.bollinger_bands.period": 10, "features.technical.bollinger_bands.std_dev": 1.0,
    "features.technical.bollinger_bands.population": True, "features.rolling.windows": [5, 21], "features.rolling.metrics": ["mean"],
    "evaluation.metrics.risk_free_rate": 0.5, "models.monte_carlo.confidence_levels": [0.2],
}


@pytest.fixture(scope="module")
def table(spark):
    df = panel(spark, 70, "A").withColumn("Close", F.when(F.dayofmonth("Date") != 9, F.col("Close"))).withColumn("Adj Close", F.col("Close") * 0.9)

    def run(config):
        base = pipeline.process_assets(df, config)
        out = pipeline.engineer(base.select("Ticker", "Date", "Volume", *(c for c in base.columns if c in ("Close", "Close_Adj", "Split_Ratio", "Dividend_Adj_Factor", "Return"))), ["Return"], config=config)
        return out.orderBy("Date").toPandas()

    def small(values=None):
        c = Config()
        c.set("features.rolling.windows", [5])
        c.set("features.rolling.metrics", ["std"])
        for k, v in (values or {}).items():
            c.set(k, v)
        return run(c)

    return small, small()


@pytest.mark.parametrize("key", sorted(KEYS))
def test_every_key_changes_the_result(table, key):
    small, base = table
    assert not small({key: KEYS[key]}).equals(base)


def test_no_adjustment_leaves_the_close(spark):
    c = Config()
    c.set("preprocessing.adjust_splits", False)
    c.set("preprocessing.adjust_dividends", False)
    out = pipeline.process_assets(panel(spark, 30, "A").withColumn("Adj Close", F.col("Close") * 0.5), c)
    assert "Close_Adj" not in out.columns and "Split_Ratio" not in out.columns


def test_costs_and_rebalancing_are_configured(spark):
    r = returns.returns(panel(spark, 140, "ABCD"))
    free, frequent = Config(), Config()
    dear = Config()
    dear.set("models.baseline.backtest_costs", True)
    dear.set("models.baseline.transaction_costs", 0.05)
    frequent.set("models.baseline.rebalance_frequency", "daily")
    total = lambda c: pipeline.baseline(r, c)["backtest_results"].agg(F.sum("Portfolio_Return")).first()[0]
    assert total(dear) < total(free) and total(frequent) != total(free), (total(dear), total(free), total(frequent))


def test_yaml_comes_back(tmp_path):
    yaml = pytest.importorskip("yaml")
    c = Config()
    c.set("evaluation.metrics.risk_free_rate", 0.07)
    c.save(f"{tmp_path}/c.yaml")
    text = (tmp_path / "c.yaml").read_text()
    assert not text.lstrip().startswith("{") and yaml.safe_load(text) == c.values
    assert Config.load(f"{tmp_path}/c.yaml").values == c.values


def test_all_numeric_columns_are_rolled_and_lagged(spark):
    df = returns.returns(panel(spark, 30, "A"))
    names = pipeline.engineer(df).columns
    for c in ("Open", "High", "Low", "Close", "Volume", "Return", "Return_Abs", "Return_Squared"):
        assert f"{c}_Rolling_Kurtosis_63" in names and f"{c}_Lag_21" in names
    assert indicators.bollinger(df, population=True).columns == indicators.bollinger(df).columns


def test_features_compute_their_panel_once_and_tickers_in_several_tasks(spark):
    seen = spark.sparkContext.accumulator(0)

    def mark(x):
        seen.add(1)
        return x

    df = returns.returns(panel(spark, 30, "ABCDEF").repartition(2).withColumn("Close", F.udf(mark, "double").asNondeterministic()("Close")))
    out = pipeline.engineer(df.drop("Return_Abs", "Return_Squared"), ["Return"], benchmark="A").withColumn("task", F.spark_partition_id())
    rows = out.select("Ticker", "task", "MACD", "Beta_5", "Return_Rolling_Kurtosis_5").collect()
    assert len(rows) == 180 and seen.value == 180, (len(rows), seen.value)
    assert len({r.task for r in rows}) > 1 and all(len({r.task for r in rows if r.Ticker == t}) == 1 for t in "ABCDEF")


def test_rolling_shapes_of_gaps_constants_and_short_windows(spark):
    values = [1, 4, 2, 8, 5, 7, None, 3, 3, 3, 3, 3, 10**9, 10**9 + 1, 10**9 + 3, 10**9 + 4, 10**9 + 9]
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), v, None if v is None else v / 7) for i, v in enumerate(values)]
    got = features.rolling_stats(spark.createDataFrame(rows, "Ticker string, Date date, N long, X double"), windows=(2, 3, 4, 5)).orderBy("Date").toPandas()
    assert list(got.columns[:4]) == ["Ticker", "Date", "N", "X"] and len(got.columns) == 4 + 2 * 4 * 6
    assert got["N_Rolling_Skew_2"].isna().all() and got["N_Rolling_Kurtosis_3"].isna().all() and got["N_Rolling_Min_5"][4] == 1
    for c in "NX":
        for n in (3, 4, 5):
            for i in range(len(values)):
                x = got[c].iloc[max(i - n + 1, 0) : i + 1].astype(float)
                for name, want in (("Skew", x.skew()), ("Kurtosis", x.kurt())):
                    v = got[f"{c}_Rolling_{name}_{n}"][i]
                    if len(x) < n or x.isna().any() or x.nunique() == 1 or name == "Kurtosis" and n < 4:
                        assert pd.isna(v), (c, n, i, name, v)
                    else:
                        assert v == pytest.approx(want, rel=1e-6, abs=1e-6), (c, n, i, name)
