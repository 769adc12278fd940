"""Headlines and their sentiment: extraction from pages, keyword scores, features by ticker and by day."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.html import Element, parse
from tessella.functions.windows import KEY, TIME

# The stock lexicon.
POSITIVE = (
    "bullish", "positive", "growth", "profit", "gain", "rise", "increase", "strong", "outperform", "buy",
    "upgrade", "beat", "exceed", "surge", "rally", "momentum", "optimistic", "confident", "success", "win",
)
NEGATIVE = (
    "bearish", "negative", "decline", "loss", "fall", "drop", "decrease", "weak", "underperform", "sell",
    "downgrade", "miss", "disappoint", "crash", "plunge", "concern", "pessimistic", "uncertain", "risk", "volatile",
)
NEUTRAL = {"Sentiment_Positive": 0.5, "Sentiment_Negative": 0.5, "Sentiment_Neutral": 1.0, "Sentiment_Score": 0.0}


# Tag and class of a headline by site.
SITES = {"yahoo": ("h3", "Mb(5px)"), "reuters": ("h3", "search-result-title"), "bloomberg": ("a", "headline")}


def elements(root: Element, tag: str, css_class: str | None = None) -> list[str]:
    """Texts of a page's elements of a tag (and class, as one of several), in page order, nested ones each for itself.

    Character references are decoded, scripts and styles say nothing, and the ends are stripped.
    """
    found = (e for e in root.walk() if e.tag == tag and (css_class is None or css_class in e.attributes.get("class", "").split()))
    return [e.text(without=("script", "style")).strip() for e in found]


def _headlines(sites: Mapping[str, tuple[str, str | None]], longer_than: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, site, page = (batch.column(c).to_pylist() for c in (KEY, "site", "page_id"))
            rows = [
                (keys[i], site[i], page[i], at, text)
                for i, html in enumerate(batch.column("html").to_pylist()) if site[i] in sites
                for at, text in enumerate(elements(parse(html), *sites[site[i]])) if len(text) > longer_than
            ]
            types = [pa.string(), pa.string(), batch.column("page_id").type, pa.int32(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [KEY, "site", "page_id", "at", "headline"])

    return run


def site_headlines(pages: DataFrame, key: Column, site: Column, sites: Mapping[str, tuple[str, str | None]] = SITES, longer_than: int = 10, limit: int = 10) -> DataFrame:
    """Ticker, headline of pages (page_id, html): texts of each site's own tag, stripped, `limit` per key and site in page order.

    Pages of other sites have no headlines. Pages are read as trees, one at a time, and only headlines go on; the limit is a
    group limit, which Spark applies before it shuffles.
    """
    rows = pages.select(key.cast("string").alias(KEY), site.cast("string").alias("site"), "page_id", "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    rows = rows.where(F.col("site").isin(*sites)).mapInArrow(_headlines(sites, longer_than), f"{KEY} string, site string, page_id {kind}, at int, headline string")
    rank = F.row_number().over(Window.partitionBy(KEY, "site").orderBy("page_id", "at"))
    return rows.withColumn("n", rank).where(F.col("n") <= limit).select(KEY, "headline")


def headlines(pages: DataFrame, key: Column, tag: str = "h3", css_class: str | None = None, longer_than: int = 10, limit: int = 10) -> DataFrame:
    """site_headlines() of pages that are all from one site."""
    return site_headlines(pages, key, F.lit(""), {"": (tag, css_class)}, longer_than, limit)


def keyword_scores(text: Column, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """struct(POSITIVE, NEGATIVE, NEUTRAL): shares of the keywords found, each counted once; 0.5, 0.5, 1 without any."""
    found = lambda low, words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))

    def shares(c: Column) -> Column:
        p, n = c["p"], c["n"]
        some = p + n > 0
        pos, neg = F.when(some, p / (p + n)).otherwise(0.5), F.when(some, n / (p + n)).otherwise(0.5)
        return F.struct(pos.alias("POSITIVE"), neg.alias("NEGATIVE"), F.when(some, 1 - F.abs(p / (p + n) - n / (p + n))).otherwise(1.0).alias("NEUTRAL"))

    # Bound in one-element arrays, so that the text is lower-cased and searched once a row.
    counts = F.transform(F.array(F.lower(text)), lambda low: F.struct(found(low, positive).alias("p"), found(low, negative).alias("n")))
    return F.get(F.transform(counts, shares), F.lit(0))


def score_texts(df: DataFrame, text: str = "headline", scorer: Callable[[Column], Column] = keyword_scores) -> DataFrame:
    """df with POSITIVE, NEGATIVE, NEUTRAL. Another scorer (such as a pandas UDF around a model) goes in by its function."""
    return df.withColumn("_s", F.when(F.col(text).isNotNull(), scorer(F.col(text)))).select(*df.columns, "_s.*")


def ticker_scores(scored: DataFrame, tickers: DataFrame) -> DataFrame:
    """Ticker, POSITIVE, NEGATIVE, NEUTRAL: means over a ticker's headlines; neutral for tickers without."""
    means = scored.groupBy(KEY).agg(*(F.avg(c).alias(c) for c in ("POSITIVE", "NEGATIVE", "NEUTRAL")))
    return tickers.select(KEY).distinct().join(means, KEY, "left").fillna({"POSITIVE": 0.5, "NEGATIVE": 0.5, "NEUTRAL": 1.0})


def add_sentiment(df: DataFrame, scores: DataFrame) -> DataFrame:
    """df with Sentiment_* by ticker; neutral where there are no scores. Columns of an earlier run are replaced."""
    s = scores.select(
        KEY, F.col("POSITIVE").alias("Sentiment_Positive"), F.col("NEGATIVE").alias("Sentiment_Negative"), F.col("NEUTRAL").alias("Sentiment_Neutral"),
        (F.col("POSITIVE") - F.col("NEGATIVE")).alias("Sentiment_Score"),
    )
    return df.drop(*NEUTRAL).join(s, KEY, "left").fillna(NEUTRAL)


def add_market(df: DataFrame) -> DataFrame:
    """Market_Sentiment_* over all tickers of the day, and Relative_Sentiment. The day's sums are joined back, not windowed,
    so a day's rows never meet in one task."""
    market = df.groupBy(TIME).agg(
        F.avg("Sentiment_Score").alias("Market_Sentiment_Mean"), F.stddev("Sentiment_Score").alias("Market_Sentiment_Std"),
        F.min("Sentiment_Score").alias("Market_Sentiment_Min"), F.max("Sentiment_Score").alias("Market_Sentiment_Max"),
        F.avg("Sentiment_Positive").alias("Market_Sentiment_Positive"), F.avg("Sentiment_Negative").alias("Market_Sentiment_Negative"),
    )
    old = [c for c in market.columns if c != TIME]
    return df.drop(*old, "Relative_Sentiment").join(market, TIME, "left").withColumn("Relative_Sentiment", F.col("Sentiment_Score") - F.col("Market_Sentiment_Mean"))


def process(df: DataFrame, news: DataFrame, scorer: Callable[[Column], Column] = keyword_scores) -> DataFrame:
    """Sentiment features of a panel from news (Ticker, headline)."""
    return add_market(add_sentiment(df, ticker_scores(score_texts(news, scorer=scorer), df)))


def process_pages(df: DataFrame, pages: DataFrame, key: Column, site: Column, sites: Mapping[str, tuple[str, str | None]] = SITES, scorer: Callable[[Column], Column] = keyword_scores) -> DataFrame:
    """Sentiment features of a panel straight from news pages (page_id, html) of several sites."""
    return process(df, site_headlines(pages, key, site, sites), scorer)
