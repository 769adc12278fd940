"""Every operator as a query over the test tables, with its SQL for an independent engine.

QUERIES: name -> (spark, sf_dir) -> DataFrame. ORACLES: name -> SQL over the same tables. Floating results are rounded to
6 decimals (covariances to 10) on both sides.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.windows import KEY, TIME
from tessella.operators import adjust, clean, features, indicators, information, optimize, portfolio, returns, risk, sentiment
from tessella.plans import api, pipeline
from tessella.sources import io
from tessella.sources.panel import BENCHMARK, BONDS, SPLIT_DAY, bonds, panel, read, with_adjusted_close, with_gaps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
W = "PARTITION BY Ticker ORDER BY Date"
TICKERS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
LEXICON = (("tion", "ing", "ent", "ung"), ("sch", "mente", "ado", "ough"))


def rounded(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """The columns, floating ones rounded; + 0.0 makes a negative zero positive."""
    kinds = dict(df.dtypes)
    return df.select(*(((F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)) if kinds[c] in ("double", "float") else F.col(f"`{c}`")).alias(c) for c in columns or df.columns))


def keyed(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return rounded(df, [KEY, TIME, *columns], digits)


def rnd(expr: str, name: str, digits: int = 6) -> str:
    return f'round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE) AS "{name}"'


def roll(agg: str, x: str, n: int, least: int | None = None) -> str:
    frame = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {n if least is None else least} THEN {agg.format(x)} {frame} END" if "{" in agg else f"CASE WHEN count({x}) {frame} >= {n if least is None else least} THEN {agg}({x}) {frame} END"


def over(expr: str, rows: str = "UNBOUNDED PRECEDING AND CURRENT ROW") -> str:
    return f"{expr} OVER ({W} ROWS BETWEEN {rows})"


PANEL = """WITH v AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey),
o AS (SELECT o_orderpriority AS Ticker, CAST(o_orderdate AS DATE) AS Date, o_orderkey AS k, 100 + o_totalprice / 50000 AS p, q FROM orders LEFT JOIN v ON o_orderkey = l_orderkey),
panel AS (SELECT Ticker, Date, min_by(p, k) AS Open, max(p) AS High, min(p) AS Low, max_by(p, k) AS Close, coalesce(sum(q), 0) AS Volume FROM o GROUP BY Ticker, Date)"""
RETURNS = PANEL + f""",
r AS (SELECT *, CASE WHEN Close > 0 AND prev > 0 THEN ln(Close / prev) END AS ret, Close / nullif(prev, 0) - 1 AS simple FROM (SELECT *, lag(Close) OVER ({W}) AS prev FROM panel))"""
GAPS = PANEL + """,
g AS (SELECT Ticker, Date, Open, High, Low, CASE WHEN date_diff('day', DATE '1995-01-01', Date) % 7 <> 0 THEN Close END AS Close,
  CASE WHEN date_diff('day', DATE '1995-01-01', Date) % 7 <> 0 THEN Volume END AS Volume FROM panel)"""
ADJ = PANEL + f""",
a AS (SELECT *, CASE WHEN Date < DATE '{SPLIT_DAY}' THEN Close * CAST(0.98 AS DOUBLE) ELSE Close END AS adj FROM panel), f AS (SELECT *, adj / nullif(Close, 0) AS k FROM a)"""
YIELDS = PANEL + f""",
y AS (SELECT Date, Ticker, Close - 100 AS Yield FROM panel WHERE Ticker IN {BONDS} AND day(Date) = 1)"""


def prices(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d)


def log_returns(spark: SparkSession, d: str) -> DataFrame:
    return returns.returns(panel(spark, d)).drop("Return_Abs", "Return_Squared")


def long(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.long_returns(log_returns(spark, d))


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


def windowed(name: str, make: Callable[[DataFrame], DataFrame], columns: dict[str, str], base: Callable = log_returns, ctes: str = RETURNS, rel: str = "r", digits: int = 6) -> None:
    """A query whose columns are SQL expressions over one relation."""
    QUERIES[name] = lambda s, d: keyed(make(base(s, d)), *columns, digits=digits)
    ORACLES[name] = f"{ctes} SELECT Ticker, Date, {', '.join(rnd(x, c, digits) for c, x in columns.items())} FROM {rel}"


# Sources and sinks


@query(f"{PANEL} SELECT Ticker, Date, {', '.join(rnd(c, c) for c in ('Open', 'High', 'Low', 'Close', 'Volume'))} FROM panel")
def scan_parquet(s, d):
    return keyed(prices(s, d), "Open", "High", "Low", "Close", "Volume")


def _written(s: SparkSession, d: str, fmt: str) -> tuple[str, T.StructType]:
    df = prices(s, d).select("Date", "Ticker", "Open", "High", "Low", "Close", "Volume")
    root = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not s.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.gettempdir()
    path = f"{root.rstrip('/')}/tessella-scan-{fmt}-{uuid.uuid4().hex}"  # a fresh one each time: a result may be read later
    io.save(df, path, fmt)
    return path, io.panel_schema()


@query(ORACLES["scan_parquet"])
def scan_csv(s, d):
    path, schema = _written(s, d, "csv")
    return keyed(io.load(s, path, "csv", schema), "Open", "High", "Low", "Close", "Volume")


@query(ORACLES["scan_parquet"])
def scan_json(s, d):
    path, schema = _written(s, d, "json")
    return keyed(io.load(s, path, "json", schema), "Open", "High", "Low", "Close", "Volume")


@query(ORACLES["scan_parquet"])
def scan_fallback(s, d):
    path, schema = _written(s, d, "csv")
    return keyed(io.first_of(s, [(f"{path}-cleaned", "parquet"), (path, "csv")], schema), "Open", "High", "Low", "Close", "Volume")


_decoded = lambda x: f"regexp_replace(replace({x}, '&quot;', chr(34)), '&amp;?', '&', 'g')"


@query(f"""WITH h AS (SELECT CAST(page_id % 5 AS VARCHAR) AS Ticker, page_id, unnest(regexp_extract_all(html, '(?s)<a(?:\\s[^>]*)?>(.*?)</a>', 1)) AS raw,
  unnest(range(0, len(regexp_extract_all(html, '(?s)<a(?:\\s[^>]*)?>(.*?)</a>', 1)))) AS nr FROM pages),
t AS (SELECT Ticker, page_id, nr, trim({_decoded("regexp_replace(raw, '<[^>]+>', '', 'g')")}) AS headline FROM h)
SELECT Ticker, headline FROM (SELECT *, row_number() OVER (PARTITION BY Ticker ORDER BY page_id, nr) AS n FROM t WHERE length(headline) > 10) WHERE n <= 10""")
def headlines_extract(s, d):
    return sentiment.headlines(read(s, d, "pages"), (F.col("page_id") % 5).cast("string"), tag="a")


# Projections and filters

OHLC = ("Open", "High", "Low", "Close")
adjusted = lambda s, d: with_adjusted_close(prices(s, d))
windowed("adjust_splits", adjust.splits, {"Split_Ratio": "k", **{f"{c}_Split_Adj": f"{c} * k" for c in OHLC}, "Volume_Split_Adj": "Volume / nullif(k, 0)"}, adjusted, ADJ, "f")
windowed("adjust_dividends", adjust.dividends, {"Dividend_Adj_Factor": "k", **{f"{c}_Dividend_Adj": f"{c} * k" for c in OHLC}}, adjusted, ADJ, "f")
windowed("adjustment_factors", adjust.factors, {"Total_Adj_Factor": "k", "Split_Adj_Factor": "1", "Dividend_Adj_Factor": "k"}, adjusted, ADJ, "f")
windowed("apply_adjustments", adjust.apply, {**{f"{c}_Adj": f"{c} * k" for c in OHLC[:-1]}, "Close_Adj": "adj"}, adjusted, ADJ, "f")
windowed("apply_adjustments_manual", lambda df: adjust.apply(df, False), {f"{c}_Adj": f"{c} * k" for c in OHLC}, adjusted, ADJ, "f")
windowed("apply_adjustments_plain", adjust.apply, {f"{c}_Adj": c for c in OHLC}, prices, PANEL, "panel")
_trades = f"""{RETURNS}, x0 AS (SELECT *, {roll('stddev', 'ret', 21)} * sqrt(252) AS vol, CASE WHEN Close > prev THEN Close - prev ELSE 0 END AS gain, CASE WHEN Close < prev THEN prev - Close ELSE 0 END AS loss,
  avg(Close) OVER ({W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) - avg(Close) OVER ({W} ROWS BETWEEN 25 PRECEDING AND CURRENT ROW) AS m FROM r),
x1 AS (SELECT *, {roll('avg', 'gain', 14)} AS up, {roll('avg', 'loss', 14)} AS down FROM x0),
x2 AS (SELECT *, CASE WHEN down = 0 AND up > 0 THEN 100 ELSE 100 - 100 / nullif(1 + up / nullif(down, 0), 0) END AS rsi FROM x1)"""


def _interacting(s: SparkSession, d: str) -> DataFrame:
    """A panel with everything that interacts: adjusted prices, volatility, RSI, MACD by simple means, sentiment."""
    x = indicators.rsi(indicators.macd_sma(risk.volatility(adjust.apply(log_returns(s, d)), [21])))
    return features.interactions(sentiment.add_sentiment(x, _scores(s, d)))


gappy = lambda s, d: with_gaps(prices(s, d))
windowed("fill_zero", clean.fill_zero, {"Close": "coalesce(Close, 0)", "Volume": "coalesce(Volume, 0)"}, gappy, GAPS, "g")


@query(f"{GAPS} SELECT Ticker, Date, {rnd('Close', 'Close')} FROM g WHERE Close IS NOT NULL AND Volume IS NOT NULL")
def drop_nulls(s, d):
    return keyed(clean.drop_nulls(gappy(s, d)), "Close")


@query(f"{PANEL} SELECT Ticker, Date, {rnd('Close', 'Close')} FROM panel WHERE Ticker = '{BENCHMARK}'")
def filter_ticker(s, d):
    return keyed(prices(s, d).where(F.col(KEY) == BENCHMARK), "Close")


@query(f"{PANEL} SELECT Ticker, Date, {rnd('Close', 'Close')} FROM panel WHERE Date >= DATE '1996-01-01' AND Date < DATE '1998-01-01'")
def filter_dates(s, d):
    return keyed(clean.between(prices(s, d), "1996-01-01", "1998-01-01"), "Close")


@query(f"{PANEL} SELECT Date, CAST(i AS INT) AS i FROM (SELECT Date, row_number() OVER (ORDER BY Date) - 1 AS i FROM (SELECT DISTINCT Date FROM panel)) WHERE i % 21 = 0")
def rebalance_dates(s, d):
    return clean.every_kth_date(prices(s, d), 21).select(TIME, F.col("i").cast("int").alias("i"))


# Joins, pivots, calendars


def _bond_sql(carry: bool) -> str:
    cols = [f'max(CASE WHEN y.Ticker = \'{t}\' THEN Yield END) AS "{t}_Yield"' for t in BONDS]
    if carry:
        each = [f"ASOF LEFT JOIN (SELECT Date AS d{i}, Yield AS y{i} FROM y WHERE Ticker = '{t}' AND Yield IS NOT NULL) ON Date >= d{i}" for i, t in enumerate(BONDS)]
        return f"{YIELDS} SELECT Ticker, Date, {', '.join(rnd(f'y{i}', t + '_Yield') for i, t in enumerate(BONDS))} FROM panel {' '.join(each)}"
    return f"{YIELDS}, w AS (SELECT Date, {', '.join(cols)} FROM y GROUP BY Date), j AS (SELECT panel.Ticker AS Ticker, panel.Date AS Date, w.* EXCLUDE (Date) FROM panel LEFT JOIN w ON panel.Date = w.Date) SELECT Ticker, Date, {', '.join(rnd(f'"{t}_Yield"', t + '_Yield') for t in BONDS)} FROM j"


@query(_bond_sql(False))
def bond_pivot_join(s, d):
    p = prices(s, d)
    return keyed(portfolio.bond_columns(p, bonds(p), BONDS), *(f"{t}_Yield" for t in BONDS))


@query(_bond_sql(True))
def bond_asof_join(s, d):
    p = prices(s, d)
    return keyed(portfolio.bond_columns(p, bonds(p), BONDS, carry=True), *(f"{t}_Yield" for t in BONDS))


def _news(s: SparkSession, d: str) -> DataFrame:
    """Documents as headlines of four of the five tickers, by the number of their source."""
    n = F.regexp_extract("source", "([0-9]+)$", 1).cast("int") % 4
    return read(s, d, "documents").select(F.get(F.array(*map(F.lit, TICKERS)), n).alias(KEY), F.col("text").alias("headline"))


def scorer(text: Column) -> Column:
    return sentiment.keyword_scores(text, *LEXICON)


_found = lambda words: " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in words)
NEWS = f"""WITH n0 AS (SELECT doc_id, [{', '.join(f"'{t}'" for t in TICKERS)}][CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4 + 1] AS Ticker, CAST({_found(LEXICON[0])} AS DOUBLE) AS p, CAST({_found(LEXICON[1])} AS DOUBLE) AS n FROM documents),
n1 AS (SELECT doc_id, Ticker, CASE WHEN p + n > 0 THEN p / (p + n) ELSE 0.5 END AS pos, CASE WHEN p + n > 0 THEN n / (p + n) ELSE 0.5 END AS neg,
  CASE WHEN p + n > 0 THEN 1 - abs(p / (p + n) - n / (p + n)) ELSE 1 END AS neu FROM n0)"""
SCORES = NEWS + PANEL.replace("WITH ", ", ", 1) + """,
n2 AS (SELECT Ticker, avg(pos) AS pos, avg(neg) AS neg, avg(neu) AS neu FROM n1 GROUP BY Ticker),
sc AS (SELECT t.Ticker AS Ticker, coalesce(pos, 0.5) AS pos, coalesce(neg, 0.5) AS neg, coalesce(neu, 1) AS neu FROM (SELECT DISTINCT Ticker FROM panel) t LEFT JOIN n2 ON t.Ticker = n2.Ticker),
sp AS (SELECT panel.Ticker AS Ticker, Date, pos AS sp_pos, neg AS sp_neg, neu AS sp_neu, pos - neg AS score FROM panel JOIN sc ON panel.Ticker = sc.Ticker)"""


@query(f"{NEWS} SELECT doc_id, Ticker, {rnd('pos', 'POSITIVE')}, {rnd('neg', 'NEGATIVE')}, {rnd('neu', 'NEUTRAL')} FROM n1")
def sentiment_keywords(s, d):
    n = F.regexp_extract("source", "([0-9]+)$", 1).cast("int") % 4
    docs = read(s, d, "documents").select("doc_id", F.get(F.array(*map(F.lit, TICKERS)), n).alias(KEY), F.col("text").alias("headline"))
    return rounded(sentiment.score_texts(docs, scorer=scorer).drop("headline"))


@query("""SELECT doc_id, round(p, 6) + CAST(0 AS DOUBLE) AS "POSITIVE" FROM (SELECT doc_id, CASE WHEN a + b > 0 THEN CAST(a AS DOUBLE) / (a + b) ELSE 0.5 END AS p FROM (SELECT doc_id, """ + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in sentiment.POSITIVE) + " AS a, " + " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END" for w in sentiment.NEGATIVE) + " AS b FROM documents))")
def sentiment_stock_lexicon(s, d):
    return rounded(sentiment.score_texts(read(s, d, "documents").select("doc_id", F.col("text").alias("headline"))).select("doc_id", "POSITIVE"))


@query(f"{SCORES} SELECT Ticker, {rnd('pos', 'POSITIVE')}, {rnd('neg', 'NEGATIVE')}, {rnd('neu', 'NEUTRAL')} FROM sc")
def sentiment_scores(s, d):
    return rounded(sentiment.ticker_scores(sentiment.score_texts(_news(s, d), scorer=scorer), prices(s, d)))


def _scores(s: SparkSession, d: str) -> DataFrame:
    return sentiment.ticker_scores(sentiment.score_texts(_news(s, d), scorer=scorer), prices(s, d))


@query(f"{SCORES} SELECT Ticker, Date, {rnd('sp_pos', 'Sentiment_Positive')}, {rnd('sp_neg', 'Sentiment_Negative')}, {rnd('sp_neu', 'Sentiment_Neutral')}, {rnd('score', 'Sentiment_Score')} FROM sp")
def sentiment_join(s, d):
    return keyed(sentiment.add_sentiment(prices(s, d), _scores(s, d)), *sentiment.NEUTRAL)


_products = {
    "Price_Volume_Interaction": "Close * Volume", "Volume_Price_Ratio": "Volume / nullif(Close, 0)", "Volatility_Return_Interaction": "vol * ret", "Return_Volatility_Ratio": "ret / nullif(vol, 0)",
    "RSI_MACD_Interaction": "rsi * m", "Sentiment_Return_Interaction": "(pos - neg) * ret",
}


@query(f"{SCORES}, {_trades.removeprefix(PANEL + ',')} SELECT x2.Ticker AS Ticker, Date, {', '.join(rnd(x, c) for c, x in _products.items())} FROM x2 JOIN sc ON x2.Ticker = sc.Ticker")
def feature_interactions(s, d):
    return keyed(_interacting(s, d), *_products)


_by_day = "OVER (PARTITION BY Date)"


@query(f"""{SCORES} SELECT Ticker, Date, {rnd(f'avg(score) {_by_day}', 'Market_Sentiment_Mean')}, {rnd(f'stddev(score) {_by_day}', 'Market_Sentiment_Std')}, {rnd(f'min(score) {_by_day}', 'Market_Sentiment_Min')},
{rnd(f'max(score) {_by_day}', 'Market_Sentiment_Max')}, {rnd(f'avg(sp_pos) {_by_day}', 'Market_Sentiment_Positive')}, {rnd(f'avg(sp_neg) {_by_day}', 'Market_Sentiment_Negative')}, {rnd(f'score - avg(score) {_by_day}', 'Relative_Sentiment')} FROM sp""")
def market_sentiment(s, d):
    x = sentiment.process(prices(s, d), _news(s, d), scorer)
    return keyed(x, *(f"Market_Sentiment_{k}" for k in ("Mean", "Std", "Min", "Max", "Positive", "Negative")), "Relative_Sentiment")


PAGE_SITES = {"0": ("a", None), "1": ("h1", None), "2": ("li", None)}
_by_site = " ".join(f"WHEN page_id % 3 = {k} THEN regexp_extract_all(html, '(?s)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1)" for k, (tag, _) in PAGE_SITES.items())
PAGE_NEWS = f"""WITH h0 AS (SELECT page_id, [{', '.join(f"'{t}'" for t in TICKERS)}][CAST(page_id % 4 AS INT) + 1] AS Ticker, page_id % 3 AS site, CASE {_by_site} END AS raws FROM pages),
h1 AS (SELECT Ticker, site, page_id, unnest(raws) AS raw, unnest(range(0, len(raws))) AS nr FROM h0),
h2 AS (SELECT *, trim({_decoded("regexp_replace(raw, '<[^>]+>', '', 'g')")}) AS text FROM h1),
h3 AS (SELECT Ticker, text FROM (SELECT *, row_number() OVER (PARTITION BY Ticker, site ORDER BY page_id, nr) AS n FROM h2 WHERE length(text) > 10) WHERE n <= 10),
n0 AS (SELECT Ticker, CAST({_found(LEXICON[0])} AS DOUBLE) AS p, CAST({_found(LEXICON[1])} AS DOUBLE) AS n FROM h3),
n1 AS (SELECT Ticker, CASE WHEN p + n > 0 THEN p / (p + n) ELSE 0.5 END AS pos, CASE WHEN p + n > 0 THEN n / (p + n) ELSE 0.5 END AS neg,
  CASE WHEN p + n > 0 THEN 1 - abs(p / (p + n) - n / (p + n)) ELSE 1 END AS neu FROM n0)"""


@query(f"""{SCORES.replace(NEWS, PAGE_NEWS)} SELECT Ticker, Date, {rnd('sp_pos', 'Sentiment_Positive')}, {rnd('sp_neg', 'Sentiment_Negative')}, {rnd('sp_neu', 'Sentiment_Neutral')}, {rnd('score', 'Sentiment_Score')},
{rnd(f'avg(score) {_by_day}', 'Market_Sentiment_Mean')}, {rnd(f'score - avg(score) {_by_day}', 'Relative_Sentiment')} FROM sp""")
def page_sentiment(s, d):
    ticker = F.get(F.array(*map(F.lit, TICKERS)), (F.col("page_id") % 4).cast("int"))
    x = sentiment.process_pages(prices(s, d), read(s, d, "pages"), ticker, (F.col("page_id") % 3).cast("string"), PAGE_SITES, scorer)
    return keyed(x, *sentiment.NEUTRAL, "Market_Sentiment_Mean", "Relative_Sentiment")


@query(RETURNS + " SELECT Date, " + ", ".join(rnd(f"max(CASE WHEN Ticker = '{t}' THEN ret END)", t) for t in TICKERS) + " FROM r GROUP BY Date HAVING count(ret) > 0")
def returns_matrix(s, d):
    return rounded(portfolio.returns_matrix(log_returns(s, d), TICKERS))


_filled = lambda c: f"coalesce(last_value({c} IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), first_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


@query(f"""{PANEL}, b AS (SELECT Ticker, CAST(unnest(generate_series(min(Date), max(Date), INTERVAL 1 DAY)) AS DATE) AS Date FROM panel GROUP BY Ticker),
j AS (SELECT b.Ticker AS Ticker, b.Date AS Date, Close, Volume FROM b LEFT JOIN panel ON b.Ticker = panel.Ticker AND b.Date = panel.Date WHERE isodow(b.Date) < 6)
SELECT Ticker, Date, {rnd(_filled('Close'), 'Close')}, {rnd(_filled('Volume'), 'Volume')} FROM j""")
def trading_days(s, d):
    return keyed(clean.trading_days(prices(s, d)), "Close", "Volume")


# Aggregates

EQUAL = "p AS (SELECT Date, sum(ret * CAST(0.2 AS DOUBLE)) AS x FROM r WHERE ret IS NOT NULL GROUP BY Date)"


def _equal(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(t, 0.2) for t in TICKERS], "Ticker string, weight double")


@query(f"{RETURNS}, {EQUAL} SELECT Date, {rnd('x', 'Portfolio_Return')} FROM p")
def portfolio_returns(s, d):
    return rounded(portfolio.portfolio_returns(long(s, d), _equal(s)))


@query(f"{RETURNS} SELECT Ticker, {rnd('avg(ret)', 'mu', 10)} FROM r GROUP BY Ticker")
def expected_returns_mean(s, d):
    return rounded(portfolio.expected_returns(long(s, d)), digits=10)


COV = "c AS (SELECT a.Ticker AS asset_i, b.Ticker AS asset_j, covar_samp(a.ret, b.ret) AS cov FROM r a JOIN r b ON a.Date = b.Date AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY a.Ticker, b.Ticker)"


@query(f"{RETURNS}, {COV} SELECT asset_i, asset_j, {rnd('cov', 'cov', 10)} FROM c")
def covariance_sample(s, d):
    return rounded(portfolio.covariance(long(s, d)), digits=10)


@query(f"{RETURNS}, {COV} SELECT asset_i, asset_j, {rnd('0.9 * cov + CASE WHEN asset_i = asset_j THEN 0.1 * (SELECT avg(cov) FROM c WHERE asset_i = asset_j) ELSE 0 END', 'cov', 10)} FROM c")
def covariance_shrunk(s, d):
    return rounded(portfolio.covariance(long(s, d), "shrunk"), digits=10)


@query(f"""{RETURNS}, full_days AS (SELECT Date FROM r WHERE ret IS NOT NULL GROUP BY Date HAVING count(*) = (SELECT count(DISTINCT Ticker) FROM r WHERE ret IS NOT NULL)),
x AS (SELECT Ticker, Date, ret - avg(ret) OVER (PARTITION BY Ticker) AS x FROM r WHERE ret IS NOT NULL AND Date IN (SELECT Date FROM full_days)),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(q * q) AS qq FROM (SELECT Date, sum(x * x) AS q FROM x GROUP BY Date)),
s AS (SELECT a.Ticker AS asset_i, b.Ticker AS asset_j, sum(a.x * b.x) / (SELECT n FROM n) AS cov FROM x a JOIN x b ON a.Date = b.Date GROUP BY a.Ticker, b.Ticker),
t AS (SELECT CAST(sum(CASE WHEN asset_i = asset_j THEN 1 END) AS DOUBLE) AS p, sum(CASE WHEN asset_i = asset_j THEN cov END) AS tr, sum(cov * cov) AS norm FROM s),
k AS (SELECT tr / p AS m, (norm - 2 * tr / p * tr + p * (tr / p) * (tr / p)) / p AS d2, (qq / n - norm) / (p * n) AS b2 FROM t, n)
SELECT asset_i, asset_j, {rnd('(1 - least(b2, d2) / d2) * cov + CASE WHEN asset_i = asset_j THEN least(b2, d2) / d2 * m ELSE 0 END', 'cov', 10)} FROM s, k""")
def covariance_ledoit_wolf(s, d):
    return rounded(portfolio.covariance(long(s, d), "ledoit_wolf"), digits=10)


@query(f"""{RETURNS}, m AS (SELECT avg(ret) AS m, var_samp(ret) AS v FROM r WHERE Ticker = '{BENCHMARK}'), b AS (SELECT Date, ret AS b FROM r WHERE Ticker = '{BENCHMARK}'),
x AS (SELECT Ticker, covar_samp(ret, b) AS c FROM r LEFT JOIN b ON r.Date = b.Date WHERE Ticker <> '{BENCHMARK}' AND ret IS NOT NULL GROUP BY Ticker)
SELECT Ticker, {rnd('CAST(0.02 AS DOUBLE) / 252 + c / v * (m - CAST(0.02 AS DOUBLE) / 252)', 'mu', 10)} FROM x, m""")
def expected_returns_capm(s, d):
    return rounded(portfolio.expected_returns(long(s, d), "capm", BENCHMARK), digits=10)


@query(f"{RETURNS}, {COV} SELECT asset_i AS Ticker, {rnd('3 * sum(cov) / (SELECT count(DISTINCT Ticker) FROM r)', 'mu', 10)} FROM c GROUP BY asset_i")
def expected_returns_bl(s, d):
    return rounded(portfolio.expected_returns(long(s, d), "black_litterman"), digits=10)


def _metrics_sql(rel: str, rf: str = "0.02") -> str:
    """Nine measures of a relation with columns Date and x."""
    return f"""mq AS (SELECT *, product(1 + x) OVER (ORDER BY Date) AS wealth FROM {rel} WHERE x IS NOT NULL), md AS (SELECT *, max(wealth) OVER (ORDER BY Date ROWS UNBOUNDED PRECEDING) AS peak FROM mq),
ms AS (SELECT product(1 + x) AS growth, CAST(count(*) AS DOUBLE) AS n, avg(x) AS mean, stddev(x) AS std, min((wealth - peak) / peak) AS low, stddev(CASE WHEN x < 0 THEN x END) AS down, quantile_cont(x, 0.05) AS var5 FROM md)
SELECT {rnd('growth - 1', 'total_return')}, {rnd('pow(growth, 252 / n) - 1', 'annualized_return')}, {rnd('std * sqrt(252)', 'volatility')}, {rnd(f'(mean * 252 - {rf}) / nullif(std * sqrt(252), 0)', 'sharpe_ratio')}, {rnd('low', 'max_drawdown')},
{rnd('mean * 252 / nullif(abs(low), 0)', 'calmar_ratio')}, {rnd(f'coalesce((mean - {rf} / 252.0) * 252 / nullif(down * sqrt(252), 0), 0)', 'sortino_ratio')}, {rnd('var5', 'var_95')}, {rnd('(SELECT avg(x) FROM md WHERE x <= (SELECT var5 FROM ms))', 'cvar_95')} FROM ms"""


@query(f"{RETURNS}, {EQUAL}, {_metrics_sql('p')}")
def portfolio_metrics(s, d):
    return rounded(portfolio.metrics(portfolio.portfolio_returns(long(s, d), _equal(s))))


SIMPLE = PANEL + f", r AS (SELECT Ticker, Date, Close / nullif(lag(Close) OVER ({W}), 0) - 1 AS ret FROM panel)"
_service = f"""mq AS (SELECT *, product(1 + x) OVER (ORDER BY Date) AS wealth FROM p WHERE x IS NOT NULL), md AS (SELECT *, max(wealth) OVER (ORDER BY Date ROWS UNBOUNDED PRECEDING) AS peak FROM mq),
ms AS (SELECT product(1 + x) AS growth, CAST(count(*) AS DOUBLE) AS n, stddev(x) AS std, min((wealth - peak) / peak) AS low FROM md)
SELECT {rnd('growth - 1', 'total_return')}, {rnd('pow(growth, 252 / n) - 1', 'annualized_return')}, {rnd('std * sqrt(252)', 'volatility')}, {rnd('(pow(growth, 252 / n) - 1) / (std * sqrt(252))', 'sharpe_ratio')}, {rnd('low', 'max_drawdown')} FROM ms"""
_two = "p AS (SELECT Date, CASE WHEN count(ret) = 2 THEN sum(ret * CASE WHEN Ticker = '1-URGENT' THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END) END AS x FROM r WHERE ret IS NOT NULL AND Ticker IN ('1-URGENT', '2-HIGH') GROUP BY Date)"
DAYS = {"start_date": "1990-01-01", "end_date": "2010-01-01"}
REQUEST = DAYS | {"tickers": list(TICKERS[:2]), "weights": {TICKERS[0]: 0.6, TICKERS[1]: 0.4}}


@query(f"{SIMPLE}, {_two}, {_service}")
def web_backtest_metrics(s, d):
    return rounded(api.backtest(prices(s, d), REQUEST)[1])


@query(f"{SIMPLE}, {_two} SELECT Date, {rnd('x', 'Portfolio_Return')}, {rnd('product(1 + x) OVER (ORDER BY Date) - 1', 'Cumulative_Return')} FROM p WHERE x IS NOT NULL")
def api_backtest(s, d):
    return rounded(api.backtest(prices(s, d), REQUEST)[0])


@query(f"{RETURNS} SELECT a.Ticker AS asset_i, b.Ticker AS asset_j, {rnd('252 * covar_samp(a.ret, b.ret)', 'cov', 8)}, (SELECT {rnd('252 * avg(ret)', 'm', 8).rsplit(' AS ', 1)[0]} FROM r WHERE Ticker = a.Ticker) AS mu FROM r a JOIN r b ON a.Date = b.Date AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY a.Ticker, b.Ticker")
def annualized_moments(s, d):
    mu, cov = portfolio.annualized(long(s, d))
    return rounded(cov.join(mu.withColumnRenamed(KEY, "asset_i"), "asset_i").select("asset_i", "asset_j", "cov", "mu"), digits=8)


_cells = ("Open", "High", "Low", "Close", "Volume")
_nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in _cells)


@query(f"""{GAPS} SELECT 'total_missing' AS scope, 'all' AS key, CAST({_nulls} AS DOUBLE) AS value FROM g UNION ALL SELECT 'missing_percentage', 'all', round(CAST(({_nulls}) * 100 AS DOUBLE) / (count(*) * 7), 6) FROM g
UNION ALL {" UNION ALL ".join(f"SELECT 'missing_by_column', '{c}', CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) FROM g" for c in _cells)}
UNION ALL SELECT 'missing_by_ticker', Ticker, CAST({_nulls} AS DOUBLE) FROM g GROUP BY Ticker UNION ALL SELECT 'missing_by_date', CAST(Date AS VARCHAR), CAST({_nulls} AS DOUBLE) FROM g GROUP BY Date""")
def missing_patterns(s, d):
    return rounded(clean.missing_report(gappy(s, d)))


@query(f"""{GAPS} SELECT 'remaining_missing' AS metric, CAST({_nulls} AS DOUBLE) AS value FROM g UNION ALL SELECT 'missing_percentage', round(CAST(({_nulls}) * 100 AS DOUBLE) / (count(*) * 7), 6) FROM g
UNION ALL SELECT 'infinite_values', CAST(0 AS DOUBLE) UNION ALL SELECT 'negative_prices', CAST(count(*) FILTER (WHERE Close < 0) AS DOUBLE) FROM g UNION ALL SELECT 'zero_volumes', CAST(count(*) FILTER (WHERE Volume = 0) AS DOUBLE) FROM g""")
def data_quality(s, d):
    return rounded(clean.quality_report(gappy(s, d)))


@query(f"{PANEL} SELECT DISTINCT Ticker FROM panel")
def distinct_tickers(s, d):
    return clean.tickers(prices(s, d))


_pairs = [(a, b) for i, a in enumerate(_cells) for b in _cells[i + 1 :]]


@query(f"{PANEL} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {rnd(f'corr({a}, {b})', 'corr')} FROM panel" for a, b in _pairs))
def corr_matrix(s, d):
    return rounded(features.correlations(prices(s, d), _cells))


# Windows

windowed("returns_log", returns.returns, {"Return": "ret", "Return_Abs": "abs(ret)", "Return_Squared": "ret * ret"}, prices)
windowed("returns_simple", lambda df: returns.returns(df, log=False), {"Return": "simple"}, prices)
bond_rows = lambda s, d: bonds(prices(s, d))
_lagged = YIELDS + f", z AS (SELECT *, lag(Yield) OVER ({W}) AS prev FROM y)"
windowed("yield_changes", returns.yield_changes, {"Yield_Change": "Yield - prev", "Yield_Change_Pct": "Yield / nullif(prev, 0) - 1", "Yield_Change_Log": "CASE WHEN Yield / nullif(prev, 0) > 0 THEN ln(Yield / prev) END"}, bond_rows, _lagged, "z")
windowed("bond_lags", lambda df: pipeline.process_bonds(df), {f"Yield_Change_Lag{k}": f"lag(d, {k}) OVER ({W})" for k in range(1, 6)}, bond_rows, _lagged + ", zd AS (SELECT *, Yield - prev AS d0 FROM z), "
         f"ze AS (SELECT Ticker, Date, d0 AS d FROM zd)", "ze")  # fmt: skip
windowed("rolling_returns", returns.rolling_returns, {k: v for n in returns.WINDOWS for k, v in {f"Return_Rolling_Mean_{n}": roll("avg", "ret", n), f"Return_Rolling_Std_{n}": roll("stddev", "ret", n), f"Return_Rolling_Sharpe_{n}": f"({roll('avg', 'ret', n)}) / nullif({roll('stddev', 'ret', n)}, 0)"}.items()})
windowed("cumulative_returns", returns.cumulative, {"Cumulative_Return": over("sum(ret)")})
windowed("cumulative_returns_simple", lambda df: returns.cumulative(df, log=False), {"Cumulative_Return": over("product(1 + simple)") + " - 1"}, base=lambda s, d: returns.returns(prices(s, d), log=False))
_down = lambda n: f"CASE WHEN count(ret) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {n} THEN stddev(CASE WHEN ret < 0 THEN ret END) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
_excess = "ret - CAST(0.02 AS DOUBLE) / 252"
_clip = "CASE WHEN ret < 0 THEN ret WHEN ret IS NOT NULL THEN 0 END"
windowed("sharpe_sortino_21", returns.sharpe_sortino, {"Excess_Return": _excess, "Sharpe_Ratio": f"({roll('avg', _excess, 21)}) / nullif({roll('stddev', 'ret', 21)}, 0)", "Sortino_Ratio": f"({roll('avg', _excess, 21)}) / nullif({_down(21)}, 0)", "Sortino_Ratio_Clipped": f"({roll('avg', _excess, 21)}) / nullif({roll('stddev', _clip, 21)}, 0)"})
windowed("return_lags", returns.lags, {f"Return_Lag{k}": f"lag(ret, {k}) OVER ({W})" for k in range(1, 6)})
windowed("basic_features", returns.basic_features, {**{f"Return_Lag{k}": f"lag(ret, {k}) OVER ({W})" for k in range(1, 6)}, "Volatility": roll("stddev", "ret", 21), "Rolling_Mean_Return": roll("avg", "ret", 21), "Rolling_Sharpe": f"({roll('avg', 'ret', 21)}) / nullif({roll('stddev', 'ret', 21)}, 0)", "Cumulative_Return": over("product(1 + ret)") + " - 1"})
windowed("lag_features", features.lag_features, {f"{c}_Lag_{k}": f"lag({x}, {k}) OVER ({W})" for c, x in (*((c, c) for c in ("Open", "High", "Low", "Close", "Volume")), ("Return", "ret")) for k in features.LAGS})
_stat = {"Mean": "avg", "Std": "stddev", "Min": "min", "Max": "max", "Skew": "skewness", "Kurtosis": "kurtosis"}
# Prices less 100: moments of what varies, not of what is alike, which would cost four digits; at 8 decimals means end in no halves.
windowed(
    "rolling_stats", features.rolling_stats, {f"{c}_Rolling_{k}_{n}": roll(f, x, n) for c, x in (*((c, f"({c} - 100)") for c in OHLC), ("Volume", "Volume"), ("Return", "ret")) for k, f in _stat.items() for n in returns.WINDOWS},
    lambda s, d: log_returns(s, d).withColumns({c: F.col(c) - 100 for c in OHLC}), digits=8,
)
windowed("volatility", risk.volatility, {f"Volatility_{n}": f"({roll('stddev', 'ret', n)}) * sqrt(252)" for n in returns.WINDOWS})
windowed("vol_of_vol", risk.volatility, {f"Vol_Vol_{n}": roll("stddev", f"vol{n}", n) for n in returns.WINDOWS}, ctes=RETURNS + ", x AS (SELECT *, " + ", ".join(f"({roll('stddev', 'ret', n)}) * sqrt(252) AS vol{n}" for n in returns.WINDOWS) + " FROM r)", rel="x")
windowed("rolling_std", risk.rolling_std, {f"Return_Std_{n}": roll("stddev", "ret", n) for n in returns.WINDOWS})
windowed("sharpe_ratio", risk.sharpe, {f"Sharpe_Ratio_{n}": f"({roll('avg', _excess, n)}) / nullif({roll('stddev', 'ret', n)}, 0)" for n in returns.WINDOWS})
windowed("sortino_ratio", risk.sortino, {f"Sortino_Ratio_{n}": f"({roll('avg', _excess, n)}) / nullif({_down(n)}, 0)" for n in returns.WINDOWS})
windowed("sortino_ratio_clipped", lambda df: risk.sortino(df, clipped=True), {f"Sortino_Ratio_{n}": f"({roll('avg', _excess, n)}) / nullif({roll('stddev', _clip, n)}, 0)" for n in returns.WINDOWS})
_i = RETURNS + f", i AS (SELECT *, row_number() OVER ({W}) AS i FROM r)"


def _fall(n: int) -> str:
    return f"""j{n} AS (SELECT a.Ticker AS Ticker, a.Date AS Date, b.i AS bi, product(1 + b.ret) OVER (PARTITION BY a.Ticker, a.Date ORDER BY b.i) AS c, a.i AS ai FROM i a JOIN i b ON a.Ticker = b.Ticker AND b.i > a.i - {n} AND b.i <= a.i WHERE b.ret IS NOT NULL),
k{n} AS (SELECT *, max(c) OVER (PARTITION BY Ticker, Date ORDER BY bi) AS peak FROM j{n}), m{n} AS (SELECT Ticker, Date, min((c - peak) / peak) AS lowest{n} FROM k{n} GROUP BY Ticker, Date HAVING count(*) >= {n})"""


@query(f"""{_i}, {', '.join(map(_fall, returns.WINDOWS))} SELECT i.Ticker AS Ticker, i.Date AS Date, {', '.join(rnd(f'lowest{n}', f'Max_Drawdown_{n}') for n in returns.WINDOWS)}
FROM i {' '.join(f'LEFT JOIN m{n} ON i.Ticker = m{n}.Ticker AND i.Date = m{n}.Date' for n in returns.WINDOWS)}""")
def max_drawdown(s, d):
    return keyed(risk.max_drawdown(log_returns(s, d)), *(f"Max_Drawdown_{n}" for n in returns.WINDOWS))


_quantile = lambda a, n: f"CASE WHEN count(ret) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {n} THEN quantile_cont(ret, {a}) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
windowed("var_historical", risk.var_cvar, {f"VaR_{a}_{n}": _quantile(a, n) for a in risk.LEVELS for n in returns.WINDOWS})


_tails = [(a, n) for a in risk.LEVELS for n in returns.WINDOWS]


@query(f"""{_i}, q AS (SELECT *, {', '.join(f'{_quantile(a, n)} AS "q{a}_{n}"' for a, n in _tails)} FROM i)
SELECT a.Ticker AS Ticker, a.Date AS Date, {', '.join(rnd(f'avg(CASE WHEN b.i > a.i - {n} AND b.ret <= a."q{x}_{n}" + 1e-15 THEN b.ret END)', f'CVaR_{x}_{n}') for x, n in _tails)}
FROM q a JOIN i b ON a.Ticker = b.Ticker AND b.i > a.i - {max(returns.WINDOWS)} AND b.i <= a.i GROUP BY a.Ticker, a.Date""")
def cvar_historical(s, d):
    return keyed(risk.var_cvar(log_returns(s, d)), *(f"CVaR_{a}_{n}" for a, n in _tails))


windowed("var_parametric", risk.var_parametric, {f"{k}_{a}_{n}": f"({roll('avg', 'ret', n)}) + 1.645 * ({roll('stddev', 'ret', n)})" for k in ("VaR", "CVaR") for a in risk.LEVELS for n in returns.WINDOWS})
_frame = lambda n: f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
windowed(
    "beta", lambda df: risk.beta(risk.with_benchmark(df, BENCHMARK)),
    {f"Beta_{n}": f"CASE WHEN count(ret) {_frame(n)} >= {n} AND count(bb) {_frame(n)} >= 2 THEN covar_samp(ret, bb) {_frame(n)} / nullif(var_pop(bb) {_frame(n)}, 0) END" for n in returns.WINDOWS},
    ctes=RETURNS + f", b AS (SELECT Date AS bd, ret AS b0 FROM r WHERE Ticker = '{BENCHMARK}'), x AS (SELECT r.*, CASE WHEN ret IS NOT NULL THEN b0 END AS bb FROM r LEFT JOIN b ON Date = bd)", rel="x",
)
_change = RETURNS + ", x0 AS (SELECT *, CASE WHEN Close > prev THEN Close - prev ELSE 0 END AS gain, CASE WHEN Close < prev THEN prev - Close ELSE 0 END AS loss FROM r), " + f"x AS (SELECT *, {roll('avg', 'gain', 14)} AS up, {roll('avg', 'loss', 14)} AS down FROM x0)"
windowed("rsi", indicators.rsi, {"RSI": "CASE WHEN down = 0 AND up > 0 THEN 100 ELSE 100 - 100 / nullif(1 + up / nullif(down, 0), 0) END"}, prices, _change, "x")


def _recursive(ctes: str, states: dict[str, tuple[str, str]], rel: str) -> str:
    """g: rel (Ticker, Date, i from 1, ...) with states name -> (first, next), over the whole history row by row; p is the row before."""
    first, later = (", ".join(f"CAST({x[k]} AS DOUBLE) AS {c}" for c, x in states.items()) for k in range(2))
    return f"{ctes.replace('WITH ', 'WITH RECURSIVE ', 1)}, g AS (SELECT x.*, {first} FROM {rel} x WHERE i = 1 UNION ALL SELECT x.*, {later} FROM g p JOIN {rel} x ON x.Ticker = p.Ticker AND x.i = p.i + 1)"


_row = PANEL + f", n0 AS (SELECT Ticker, Date, Close, row_number() OVER ({W}) AS i FROM panel)"
_keep = lambda n: f"(1 - 2 / CAST({n + 1} AS DOUBLE))"
_fastslow = "(p.nf * {f} + x.Close) / (p.df * {f} + 1) - (p.ns * {s} + x.Close) / (p.ds * {s} + 1)".format(f=_keep(12), s=_keep(26))
_ema = {
    "nf": ("Close", f"p.nf * {_keep(12)} + x.Close"), "df": ("1", f"p.df * {_keep(12)} + 1"), "ns": ("Close", f"p.ns * {_keep(26)} + x.Close"), "ds": ("1", f"p.ds * {_keep(26)} + 1"),
    "m": ("0", _fastslow), "ng": ("0", f"p.ng * {_keep(9)} + {_fastslow}"), "dg": ("1", f"p.dg * {_keep(9)} + 1"),
}


@query(f"{_recursive(_row, _ema, 'n0')} SELECT Ticker, Date, {rnd('m', 'MACD')}, {rnd('ng / dg', 'MACD_Signal')}, {rnd('m - ng / dg', 'MACD_Histogram')} FROM g")
def macd(s, d):
    return keyed(indicators.macd(prices(s, d)), "MACD", "MACD_Signal", "MACD_Histogram")


_mean = lambda n, c="Close": f"avg({c}) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
_seed = _row + f", n1 AS (SELECT *, {_mean(12)} AS f0, {_mean(26)} AS s0 FROM n0 ORDER BY Ticker, Date)"
_move = lambda y, x, n: f"(p.{y} + 2 / CAST({n + 1} AS DOUBLE) * ({x} - p.{y}))"
_seeded = {
    "ef": ("0", f"CASE WHEN x.i <= 26 THEN x.f0 ELSE {_move('ef', 'x.Close', 12)} END"), "es": ("0", f"CASE WHEN x.i <= 26 THEN x.s0 ELSE {_move('es', 'x.Close', 26)} END"),
    "sm": ("0", "CASE WHEN x.i = 26 THEN x.f0 - x.s0 WHEN x.i BETWEEN 27 AND 34 THEN p.sm + " + f"{_move('ef', 'x.Close', 12)} - {_move('es', 'x.Close', 26)} ELSE 0 END"),
    "sg": ("0", f"CASE WHEN x.i < 34 THEN 0 WHEN x.i = 34 THEN (p.sm + {_move('ef', 'x.Close', 12)} - {_move('es', 'x.Close', 26)}) / 9 ELSE p.sg + 2 / CAST(10 AS DOUBLE) * ({_move('ef', 'x.Close', 12)} - {_move('es', 'x.Close', 26)} - p.sg) END"),
}


@query(f"{_recursive(_seed, _seeded, 'n1')} SELECT Ticker, Date, {rnd('CASE WHEN i >= 34 THEN ef - es END', 'MACD')}, {rnd('CASE WHEN i >= 34 THEN sg END', 'MACD_Signal')}, {rnd('CASE WHEN i >= 34 THEN ef - es - sg END', 'MACD_Histogram')} FROM g")
def ema_seeded(s, d):
    return keyed(indicators.macd(prices(s, d), seeded=True), "MACD", "MACD_Signal", "MACD_Histogram")


_wilder = PANEL + f""", n0 AS (SELECT Ticker, Date, Close - lag(Close) OVER ({W}) AS d, row_number() OVER ({W}) AS i FROM panel),
n1 AS (SELECT *, greatest(coalesce(d, 0), 0) AS u, greatest(coalesce(-d, 0), 0) AS w FROM n0)"""
_up = lambda y, x: ("0", f"CASE WHEN x.i <= 15 THEN p.{y} + x.{x} / 14 ELSE (p.{y} * 13 + x.{x}) / 14 END")


@query(f"{_recursive(_wilder, {'up': _up('up', 'u'), 'down': _up('down', 'w')}, 'n1')} SELECT Ticker, Date, {rnd('CASE WHEN i > 14 THEN coalesce(100 * up / nullif(up + down, 0), 0) END', 'RSI')} FROM g")
def rsi_wilder(s, d):
    return keyed(indicators.rsi(prices(s, d), wilder=True), "RSI")


windowed("bollinger_population", lambda df: indicators.bollinger(df, population=True), {"BB_Upper": "mid + 2 * sd", "BB_Lower": "mid - 2 * sd"}, prices, PANEL + f", x AS (SELECT *, {roll('avg', 'Close', 20)} AS mid, {roll('stddev_pop', 'Close', 20)} AS sd FROM panel)", "x", digits=9)
_sma = lambda x, n: f"avg({x}) OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
windowed("macd_sma", indicators.macd_sma, {"EMA_Fast": "fast", "EMA_Slow": "slow", "MACD": "fast - slow", "MACD_Signal": _sma("fast - slow", 9), "MACD_Histogram": f"fast - slow - {_sma('fast - slow', 9)}"}, prices, PANEL + f", x AS (SELECT *, {_sma('Close', 12)} AS fast, {_sma('Close', 26)} AS slow FROM panel)", "x", digits=9)
windowed("bollinger", indicators.bollinger, {"BB_Middle": "mid", "BB_Upper": "mid + 2 * sd", "BB_Lower": "mid - 2 * sd", "BB_Position": "(Close - (mid - 2 * sd)) / nullif(mid + 2 * sd - (mid - 2 * sd), 0)"}, prices, PANEL + f", x AS (SELECT *, {roll('avg', 'Close', 20)} AS mid, {roll('stddev', 'Close', 20)} AS sd FROM panel)", "x", digits=9)
# Means of prices in steps of 2e-7 end in exact halves at 6 decimals; at 9 they do not.
_periods = (5, 10, 20, 50, 200)
windowed("moving_averages", indicators.moving_averages, {**{f"MA_{n}": roll("avg", "Close", n) for n in _periods}, **{f"Price_MA_{n}_Ratio": f"Close / nullif({roll('avg', 'Close', n)}, 0)" for n in _periods}}, prices, PANEL, "panel", digits=9)
windowed("volume_ma", indicators.volume, {**{f"Volume_MA_{n}": roll("avg", "Volume", n) for n in (10, 20, 50)}, "Volume_Ratio": f"Volume / nullif({roll('avg', 'Volume', 20)}, 0)"}, prices, PANEL, "panel")
windowed("pvt", indicators.volume, {"PVT": over("sum(ret * Volume)")})
windowed("obv", indicators.volume, {"OBV": over("sum(Volume * sign(ret))")})
windowed("ffill", lambda df: clean.forward_fill(df, ["Close", "Volume"]), {c: f"last_value({c} IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING)" for c in ("Close", "Volume")}, gappy, GAPS, "g")
windowed("bfill", lambda df: clean.backward_fill(df, ["Close", "Volume"]), {c: f"first_value({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)" for c in ("Close", "Volume")}, gappy, GAPS, "g")
windowed("fill_both", lambda df: clean.fill_both(df, ["Close", "Volume"]), {c: _filled(c) for c in ("Close", "Volume")}, gappy, GAPS, "g")
_at = lambda c, f, rows: f"{f}({c} IGNORE NULLS) OVER ({W} ROWS BETWEEN {rows})"
_past, _future = "UNBOUNDED PRECEDING AND CURRENT ROW", "CURRENT ROW AND UNBOUNDED FOLLOWING"
windowed(
    "interpolate", lambda df: clean.interpolate(df, ["Close"]), {"Close": "coalesce(Close, v0 + (v1 - v0) * ((i - i0) * CAST(1 AS DOUBLE) / nullif(i1 - i0, 0)), v0)"}, gappy,
    GAPS + f", x0 AS (SELECT *, row_number() OVER ({W}) AS i FROM g), x1 AS (SELECT *, CASE WHEN Close IS NOT NULL THEN i END AS ci FROM x0), "
    f"x AS (SELECT *, {_at('Close', 'last_value', _past)} AS v0, {_at('Close', 'first_value', _future)} AS v1, {_at('ci', 'last_value', _past)} AS i0, {_at('ci', 'first_value', _future)} AS i1 FROM x1)", "x", digits=9,
)


@query(f"{RETURNS}, {EQUAL}, q AS (SELECT *, product(1 + x) OVER (ORDER BY Date) AS w FROM p) SELECT Date, {rnd('w', 'Wealth')}, {rnd('w / max(w) OVER (ORDER BY Date ROWS UNBOUNDED PRECEDING) - 1', 'Drawdown')} FROM q")
def portfolio_drawdown(s, d):
    return rounded(portfolio.drawdowns(portfolio.portfolio_returns(long(s, d), _equal(s))), [TIME, "Wealth", "Drawdown"])


_ready = f"""{PANEL}, r AS (SELECT *, Close / nullif(lag(Close) OVER ({W}), 0) - 1 AS ret FROM panel), x AS (SELECT Ticker, Date, ret, {roll('stddev', 'ret', 21)} AS sd, {roll('avg', 'ret', 21)} AS mean,
{over('product(1 + ret)')} - 1 AS cum, {', '.join(f'lag(ret, {k}) OVER ({W}) AS l{k}' for k in range(1, 6))} FROM r)"""


@query(f"{_ready} SELECT Ticker, Date, {rnd('ret', 'Return')}, {rnd('sd', 'Volatility')}, {rnd('mean', 'Rolling_Mean_Return')}, {rnd('mean / nullif(sd, 0)', 'Rolling_Sharpe')}, {rnd('cum', 'Cumulative_Return')}, {', '.join(rnd(f'l{k}', f'Return_Lag{k}') for k in range(1, 6))} FROM x WHERE ret IS NOT NULL AND sd IS NOT NULL AND mean / nullif(sd, 0) IS NOT NULL AND l5 IS NOT NULL")
def ml_ready_assets(s, d):
    return keyed(returns.ml_ready(prices(s, d)), "Return", "Volatility", "Rolling_Mean_Return", "Rolling_Sharpe", "Cumulative_Return", *(f"Return_Lag{k}" for k in range(1, 6)))


@query()
def feature_pipeline(s, d):
    return pipeline.engineer(log_returns(s, d), benchmark=BENCHMARK)


windowed("calendar_mean", lambda df: returns.calendar_means(df, ("Close", "Return"), (21, 90)), {f"{c}_Mean_{n}d": f"avg({x}) OVER (PARTITION BY Ticker ORDER BY Date RANGE BETWEEN INTERVAL {n - 1} DAYS PRECEDING AND CURRENT ROW)" for c, x in (("Close", "Close"), ("Return", "ret")) for n in (21, 90)}, digits=9)


@query(f"""{RETURNS}, m AS (SELECT Ticker, CAST(date_trunc('month', Date) AS DATE) AS Month, ret FROM r WHERE ret IS NOT NULL), k AS (SELECT DISTINCT Ticker AS kt, Month AS km FROM m)
SELECT kt AS Ticker, km AS Month, count(*) AS n, {', '.join(rnd(f'quantile_disc(ret, {a})', f'VaR_{a}') for a in (0.05, 0.1))} FROM k JOIN m ON Ticker = kt AND Month <= km AND Month > km - INTERVAL 12 MONTHS GROUP BY kt, km""")
def var_sketched(s, d):
    return rounded(risk.var_sketched(log_returns(s, d), (0.05, 0.1)))


@query()
def feature_importance_forest(s, d):
    return features.forest_importance(log_returns(s, d), "Return", _cells)


# Order, limits, unions


@query(f"{PANEL} SELECT Ticker, Date, {rnd('Close', 'Close')} FROM panel ORDER BY Ticker, Date")
def sort_panel(s, d):
    return keyed(prices(s, d), "Close").orderBy(KEY, TIME)


@query(f"{PANEL} SELECT Ticker, {rnd('max_by(Close, Date)', 'Close')} FROM panel GROUP BY Ticker")
def last_value(s, d):
    return rounded(clean.last_value(prices(s, d), "Close"))


@query(f"{YIELDS} SELECT Ticker, Date, {rnd('Close', 'Close')}, {rnd('NULL', 'Yield')} FROM panel UNION ALL SELECT Ticker, Date, {rnd('NULL', 'Close')}, {rnd('Yield', 'Yield')} FROM y")
def union_panels(s, d):
    p = prices(s, d)
    return keyed(clean.union_panels(p, bonds(p)), "Close", "Yield")


# Features

_scaled = _cells
windowed("scale_standard", lambda df: features.scale_standard(df, _scaled), {f"{c}_Scaled": f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()" for c in _scaled}, prices, PANEL, "panel")


@query(f"{PANEL} SELECT Ticker, Date, {', '.join(rnd(f'{c} / stddev_samp({c}) OVER ()', f'{c}_Scaled') for c in _cells)} FROM panel")
def scale_vector(s, d):
    from pyspark.ml.functions import vector_to_array

    x = features.scale_vector(prices(s, d), _cells)
    return keyed(x.withColumns({f"{c}_Scaled": vector_to_array("scaled_features")[i] for i, c in enumerate(_cells)}), *(f"{c}_Scaled" for c in _cells))


@query(f"{PANEL}, c AS (" + " UNION ALL ".join(f"SELECT '{b}' AS col, corr({a}, {b}) AS x FROM panel" for a, b in _pairs) + ') SELECT DISTINCT col AS "column" FROM c WHERE abs(x) > 0.5')
def select_correlation(s, d):
    return features.correlated(prices(s, d), _cells, 0.5)


_q = lambda c: f"(SELECT quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FROM f)"
_bin = lambda c: f"len(list_filter({_q(c)}, lambda e: {c} > e))"
_mi = f"""{RETURNS}, f AS (SELECT ret, Close, Volume FROM r WHERE ret IS NOT NULL AND Close IS NOT NULL AND Volume IS NOT NULL),
u AS (SELECT 'Close' AS feature, {_bin('Close')} AS x, {_bin('ret')} AS t FROM f UNION ALL SELECT 'Volume', {_bin('Volume')}, {_bin('ret')} FROM f),
j AS (SELECT feature, x, t, CAST(count(*) AS DOUBLE) AS n FROM u GROUP BY feature, x, t),
i AS (SELECT feature, n / sum(n) OVER (PARTITION BY feature) * ln(n * sum(n) OVER (PARTITION BY feature) / (sum(n) OVER (PARTITION BY feature, x) * sum(n) OVER (PARTITION BY feature, t))) AS i FROM j)"""


@query(f"{_mi} SELECT feature, {rnd('sum(i)', 'importance')} FROM i GROUP BY feature")
def feature_importance(s, d):
    return rounded(features.mutual_information(log_returns(s, d), "Return", ["Close", "Volume"]))


@query(f"{_mi} SELECT feature, {rnd('sum(i)', 'importance')} FROM i GROUP BY feature ORDER BY 2 DESC LIMIT 1")
def feature_importance_topk(s, d):
    return rounded(features.top_features(features.mutual_information(log_returns(s, d), "Return", ["Close", "Volume"]), 1))


_knn = f"""{RETURNS}, f AS (SELECT row_number() OVER (ORDER BY Ticker, Date) AS id, ret AS y, {', '.join(_cells)} FROM r WHERE ret IS NOT NULL),
u AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, id, {c} AS x, y, (SELECT 1 / stddev_pop({c}) FROM f) AS cx, (SELECT 1 / stddev_pop(y) FROM f) AS cy FROM f" for c in _cells)}),
d AS (SELECT a.feature AS feature, a.id AS id, any_value(a.x) AS x, any_value(a.y) AS y, any_value(a.cx) AS cx, any_value(a.cy) AS cy, list_max(min(greatest(abs(b.x - a.x) * a.cx, abs(b.y - a.y) * a.cy), 3)) AS r
  FROM u a JOIN u b ON a.feature = b.feature AND a.id <> b.id GROUP BY a.feature, a.id),
c AS (SELECT a.feature AS feature, a.id AS id, count(*) FILTER (abs(b.x - a.x) * a.cx < r OR b.x = a.x) AS nx, count(*) FILTER (abs(b.y - a.y) * a.cy < r OR b.y = a.y) AS ny FROM d a JOIN u b ON a.feature = b.feature GROUP BY a.feature, a.id),
psi AS (SELECT n, CAST(-0.5772156649015329 AS DOUBLE) + coalesce(sum(1 / CAST(n AS DOUBLE)) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM (SELECT unnest(range(1, (SELECT count(*) + 2 FROM f))) AS n))"""


@query(f"{_knn} SELECT feature, {rnd('greatest(0, (SELECT p FROM psi WHERE n = (SELECT count(*) FROM f)) + (SELECT p FROM psi WHERE n = 3) - avg(a.p + b.p))', 'importance')} FROM c JOIN psi a ON nx = a.n JOIN psi b ON ny = b.n GROUP BY feature")
def feature_importance_knn(s, d):
    return rounded(information.knn_information(log_returns(s, d), "Return", _cells))


# Allocation and backtests

_alloc = lambda mu, by="": f"CAST(0.01 AS DOUBLE) + greatest(0, least(CAST(0.49 AS DOUBLE), 1 - count(*) OVER ({by}) * CAST(0.01 AS DOUBLE) - (row_number() OVER ({by} ORDER BY {mu} DESC NULLS LAST, Ticker) - 1) * CAST(0.49 AS DOUBLE)))"


@query(f"{RETURNS}, m AS (SELECT Ticker, avg(ret) AS mu FROM r GROUP BY Ticker) SELECT Ticker, {rnd(_alloc('mu'), 'weight')} FROM m")
def opt_max_sharpe(s, d):
    return rounded(portfolio.max_sharpe_weights(portfolio.expected_returns(long(s, d))).select(KEY, "weight"))


def _optimized(method: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        r = long(s, d)
        return rounded(optimize.optimize(portfolio.expected_returns(r), portfolio.covariance(r), method)[0], digits=4)

    return run


QUERIES["opt_min_variance"] = _optimized("min_variance")
# Where no bound is met, as here, the weights are the rows' sums of the inverse, by elimination one asset at a time, scaled to 1.
ORACLES["opt_min_variance"] = f"""{RETURNS.replace('WITH ', 'WITH RECURSIVE ', 1)}, {COV},
a AS (SELECT asset_i, list_append(list(cov ORDER BY asset_j), CAST(1 AS DOUBLE)) AS line FROM c GROUP BY asset_i), m0 AS (SELECT list(line ORDER BY asset_i) AS m, list(asset_i ORDER BY asset_i) AS names FROM a),
e AS (SELECT 0 AS k, m, names FROM m0 UNION ALL SELECT k + 1, list_transform(m, lambda l, i: list_transform(l, lambda v, j: CASE WHEN i = k + 1 THEN v / m[k + 1][k + 1] ELSE v - l[k + 1] * m[k + 1][j] / m[k + 1][k + 1] END)), names FROM e WHERE k < len(names)),
z AS (SELECT unnest(names) AS Ticker, unnest(list_transform(m, lambda l: l[len(l)])) AS z FROM e WHERE k = len(names))
SELECT Ticker, {rnd('z / sum(z) OVER ()', 'weight', 4)} FROM z"""
QUERIES["opt_max_return"] = _optimized("max_return")
ORACLES["opt_max_return"] = f"{RETURNS}, m AS (SELECT Ticker, row_number() OVER (ORDER BY avg(ret) DESC, Ticker) AS k FROM r GROUP BY Ticker) SELECT Ticker, {rnd('CASE WHEN k <= 2 THEN 0.4 WHEN k = 3 THEN 0.2 ELSE 0 END', 'weight', 4)} FROM m"


@query()
def efficient_frontier(s, d):
    r = long(s, d)
    return optimize.frontier(s, optimize.collect_moments(portfolio.expected_returns(r), portfolio.covariance(r)))


@query()
def best_sharpe(s, d):
    return optimize.best_of(efficient_frontier(s, d))


def _backtest_sql(k: int) -> str:
    return f"""{RETURNS}, x0 AS (SELECT Ticker, Date, ret FROM r WHERE ret IS NOT NULL), ds AS (SELECT Date AS dd, row_number() OVER (ORDER BY Date) - 1 AS i FROM (SELECT DISTINCT Date FROM x0)), x AS (SELECT Ticker, Date, ret, i FROM x0 JOIN ds ON Date = dd),
ks AS (SELECT i AS k FROM ds WHERE i % {k} = 0 AND i > 50), n AS (SELECT CAST(count(DISTINCT Ticker) AS DOUBLE) AS n FROM x),
mu AS (SELECT k, Ticker, avg(ret) AS mu FROM ks JOIN x ON x.i >= ks.k - 252 AND x.i < ks.k GROUP BY k, Ticker),
g AS (SELECT a.k AS k, a.Ticker AS Ticker, mu FROM (SELECT k, Ticker FROM ks, (SELECT DISTINCT Ticker FROM x)) a LEFT JOIN mu ON a.k = mu.k AND a.Ticker = mu.Ticker),
w AS (SELECT k AS wk, Ticker AS wt, {_alloc('mu', 'PARTITION BY k')} AS weight FROM g),
p AS (SELECT Date, sum(ret * coalesce(weight, 1 / n)) AS x FROM (SELECT * FROM x, n) LEFT JOIN w ON wk = i - i % {k} AND wt = Ticker GROUP BY Date)
SELECT Date, {rnd('x', 'Portfolio_Return')}, {rnd('product(1 + x) OVER (ORDER BY Date) - 1', 'Cumulative_Return')} FROM p"""


for _name, _k in portfolio.EVERY.items():
    QUERIES[f"backtest_{_name}"] = lambda s, d, f=_name: rounded(portfolio.backtest(long(s, d), f))
    ORACLES[f"backtest_{_name}"] = _backtest_sql(_k)


def _weights_of(s: SparkSession, d: str, start: str, end: str) -> DataFrame:
    """Best weights by the returns of a span of days."""
    return portfolio.max_sharpe_weights(portfolio.expected_returns(clean.between(long(s, d), start, end))).select(KEY, "weight")


_half = lambda name, start, end: f"{name}0 AS (SELECT Ticker, avg(ret) AS mu FROM r WHERE Date >= DATE '{start}' AND Date < DATE '{end}' GROUP BY Ticker), {name} AS (SELECT Ticker, {_alloc('mu')} AS weight FROM {name}0)"
_halves = ("1995-01-01", "1998-01-01", "2002-01-01")


@query(f"""{RETURNS}, {_half('had', *_halves[:2])}, {_half('next', *_halves[1:])}, x AS (SELECT coalesce(had.Ticker, next.Ticker) AS Ticker, next.weight - had.weight AS change, next.weight AS new_weight FROM had FULL JOIN next ON had.Ticker = next.Ticker)
SELECT Ticker, {rnd('change', 'change')}, {rnd('new_weight', 'new_weight')}, {rnd('0.001 * (SELECT sum(abs(change)) FROM x)', 'transaction_costs')}, {rnd('0.5 * (SELECT sum(abs(change)) FROM x)', 'turnover')} FROM x""")
def rebalance(s, d):
    """From the best weights of one span to those of the next."""
    trades, sums = portfolio.rebalance(_weights_of(s, d, *_halves[:2]), _weights_of(s, d, *_halves[1:]))
    x = sums.first()
    return rounded(trades.withColumns({"transaction_costs": F.lit(x.transaction_costs), "turnover": F.lit(x.turnover)}))


_best = f"{RETURNS}, m AS (SELECT Ticker, avg(ret) AS mu FROM r GROUP BY Ticker), w AS (SELECT Ticker AS wt, {_alloc('mu')} AS weight FROM m), p AS (SELECT Date, sum(ret * weight) AS x FROM r JOIN w ON Ticker = wt WHERE ret IS NOT NULL GROUP BY Date)"


@query(f"{_best}, {_metrics_sql('p')}")
def baseline_model(s, d):
    """Flagship: files to returns, means, weights, daily portfolio returns, nine measures."""
    r = long(s, d)
    weights = portfolio.max_sharpe_weights(portfolio.expected_returns(r)).select(KEY, "weight")
    return rounded(portfolio.metrics(portfolio.portfolio_returns(r, weights)))


@query(f"{SIMPLE}, m AS (SELECT Ticker, 252 * avg(ret) AS mu FROM r GROUP BY Ticker) SELECT Ticker, {rnd(_alloc('mu').replace('0.49', '0.29'), 'weight')} FROM m")
def api_optimize(s, d):
    return rounded(api.optimise(prices(s, d), DAYS | {"tickers": list(TICKERS)})[0])


_listed = " UNION ALL ".join(f"SELECT '{k}' AS kind, {i} AS nr, '{t}' AS ticker" for k, ts in api.SUGGESTIONS.items() for i, t in enumerate(ts))


@query(f"WITH s AS ({_listed}), c AS (SELECT kind, nr, ticker, count(doc_id) AS n FROM s LEFT JOIN documents ON contains(lower(text), lower(ticker)) GROUP BY kind, nr, ticker) SELECT kind, ticker, CAST(n AS BIGINT) AS documents FROM c")
def api_suggestions(s, d):
    """What the service suggests, with the number of documents that name it."""
    return api.mentions(api.suggestions(s), read(s, d, "documents").select("text"))


@query(f"{RETURNS}, m AS (SELECT Ticker, 252 * avg(ret) AS mu FROM r GROUP BY Ticker), w AS (SELECT {_alloc('mu')} AS weight, mu FROM m) " + " UNION ALL ".join(f"SELECT '{k}' AS method, '{v[0]}' AS name, '{v[1]}' AS description, '{v[2]}' AS best_for, {rnd('(SELECT sum(weight * mu) FROM w)', 'expected_return') if k == 'max_sharpe' else rnd('NULL', 'expected_return')}" for k, v in api.METHODS.items()))
def api_methods(s, d):
    """The methods of the service; the default one with what it promises for the panel."""
    mu, _ = portfolio.annualized(long(s, d))
    best = portfolio.max_sharpe_weights(mu).agg(F.sum(F.col("weight") * F.col("mu")).alias("expected_return")).withColumn("method", F.lit("max_sharpe"))
    return rounded(api.methods(s).join(best, "method", "left"))


@query("""SELECT event_type AS Ticker, CAST(ts AS DATE) AS Date, round(min_by(value, ts), 6) AS "Open", round(max(value), 6) AS "High", round(min(value), 6) AS "Low", round(max_by(value, ts), 6) AS "Close", CAST(count(*) AS DOUBLE) AS "Volume" FROM events GROUP BY event_type, CAST(ts AS DATE)""")
def event_bars(s, d):
    from tessella.streaming.bars import bars

    return keyed(bars(read(s, d, "events")), "Open", "High", "Low", "Close", "Volume")
