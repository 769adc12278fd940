"""Gaps, calendars and reports on missing or implausible values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import blocks
from tessella.functions.windows import KEY, TIME, from_here, numeric_columns, ordered, so_far

PRICES = ("Open", "High", "Low", "Close", "Open_Adj", "High_Adj", "Low_Adj", "Close_Adj")
STRATEGIES = ("forward_fill", "backward_fill", "interpolate", "drop", "zero")


def forward_fill(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns({c: F.last(c, ignorenulls=True).over(so_far()) for c in columns or numeric_columns(df)})


def backward_fill(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns({c: F.first(c, ignorenulls=True).over(from_here()) for c in columns or numeric_columns(df)})


def fill_both(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Forward, then backward for leading gaps."""
    return backward_fill(forward_fill(df, columns), columns)


def interpolate(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Straight lines by row position; a trailing gap takes the last value, a leading one stays."""
    columns = list(columns or numeric_columns(df))
    numbered = df.withColumn("_at", F.row_number().over(ordered()))
    point = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(c).cast("double").alias("v")))
    both = numbered.withColumns({f"_before_{c}": F.last(point(c), ignorenulls=True).over(so_far()) for c in columns} | {f"_after_{c}": F.first(point(c), ignorenulls=True).over(from_here()) for c in columns})

    def line(c: str):
        a, b = F.col(f"_before_{c}"), F.col(f"_after_{c}")
        return F.coalesce(F.col(c).cast("double"), a["v"] + (b["v"] - a["v"]) * F.try_divide(F.col("_at") - a["at"], b["at"] - a["at"]), a["v"])

    return both.withColumns({c: line(c) for c in columns}).select(df.columns)


def fill_zero(df: DataFrame) -> DataFrame:
    return df.fillna(0, subset=numeric_columns(df))


def drop_nulls(df: DataFrame) -> DataFrame:
    return df.dropna()


def handle_missing(df: DataFrame, strategy: str = "forward_fill") -> DataFrame:
    """One of STRATEGIES, then a backward fill for what leads."""
    steps = {"forward_fill": forward_fill, "backward_fill": backward_fill, "interpolate": interpolate, "drop": drop_nulls, "zero": fill_zero}
    if strategy not in steps:
        raise ValueError(f"strategy {strategy!r} is none of {STRATEGIES}")
    out = steps[strategy](df)
    return out if strategy in ("drop", "zero", "backward_fill") else backward_fill(out)


def trading_days(df: DataFrame) -> DataFrame:
    """Every weekday between a ticker's first and last row, filled forward then backward; weekend rows go."""
    span = df.groupBy(KEY).agg(F.min(TIME).alias("a"), F.max(TIME).alias("b"))
    days = span.select(KEY, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias(TIME)).where(F.weekday(TIME) < 5)
    return fill_both(days.join(df, [KEY, TIME], "left"), numeric_columns(df)).select(df.columns)


def missing_report(df: DataFrame) -> DataFrame:
    """scope, key, value: nulls in total, percent of cells, by column, ticker and date, from one pass over the data.

    Grouping sets over (ticker), (date) and () share the counts; columns unpivot from the total row.
    """
    counted = [c for c in df.columns if c not in (KEY, TIME)]
    nulls = {c: F.sum(F.col(c).isNull().cast("long")) for c in counted}
    base = df.groupBy(F.col(KEY).alias("t"), F.col(TIME).cast("string").alias("d")).agg(F.count("*").alias("_rows"), *(v.alias(c) for c, v in nulls.items()))
    sums = base.groupingSets([[], ["t"], ["d"]], "t", "d").agg(F.grouping_id().alias("g"), F.sum("_rows").alias("_rows"), *(F.sum(c).alias(c) for c in counted))
    all_ = sum((F.col(c) for c in counted), F.lit(0))
    entry = lambda scope, key, value: F.struct(F.lit(scope).alias("scope"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    total = F.array(
        entry("total_missing", F.lit("all"), all_), entry("missing_percentage", F.lit("all"), F.try_divide(all_ * 100, F.col("_rows") * len(df.columns))),
        *(entry("missing_by_column", F.lit(c), F.col(c)) for c in counted),
    )
    rows = F.when(F.col("g") == 3, total).when(F.col("g") == 1, F.array(entry("missing_by_ticker", F.col("t"), all_))).otherwise(F.array(entry("missing_by_date", F.col("d"), all_)))
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def quality_report(df: DataFrame) -> DataFrame:
    """metric, value: remaining nulls, percent, infinities, negative prices, zero volumes, in one aggregate."""
    counted = [c for c in df.columns if c not in (KEY, TIME)]
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    flag = lambda cond: F.coalesce(cond, F.lit(False)).cast("long")
    each = {
        "remaining_missing": [F.col(c).isNull() for c in counted], "infinite_values": [F.abs(F.col(c)) == float("inf") for c in floats],
        "negative_prices": [F.col(c) < 0 for c in PRICES if c in df.columns], "zero_volumes": [F.col("Volume") == 0] if "Volume" in df.columns else [],
    }
    one = df.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(sum((flag(x) for x in xs), F.lit(0))), F.lit(0)).alias(k) for k, xs in each.items()))
    pairs = [F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value")) for k in each]
    pairs.append(F.struct(F.lit("missing_percentage").alias("metric"), F.try_divide(F.col("remaining_missing") * 100, F.col("n") * len(df.columns)).cast("double").alias("value")))
    return one.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def tickers(df: DataFrame) -> DataFrame:
    return df.select(KEY).distinct()


def between(df: DataFrame, start: str, end: str) -> DataFrame:
    """start included, end not."""
    return df.where((F.col(TIME) >= F.lit(start).cast("date")) & (F.col(TIME) < F.lit(end).cast("date")))


def last_value(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(KEY).agg(F.max_by(column, TIME).alias(column))


def union_panels(*panels: DataFrame) -> DataFrame:
    out = panels[0]
    for p in panels[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def every_kth_date(df: DataFrame, k: int) -> DataFrame:
    """Date, i (from 0) of each k-th distinct date."""
    return blocks.numbered_all(df.select(TIME).distinct()).where(F.col("i") % k == 0)
