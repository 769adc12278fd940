"""Windows over one ticker's rows in date order, and the guarded arithmetic on them.

All bounded and cumulative frames share one (Ticker, Date) specification, so Spark plans one exchange and one sort for a
chain of them. Rolling values are null until `least` (default: n) values are there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY, TIME = "Ticker", "Date"
YEAR = 252
_parts: ContextVar[tuple[str, ...]] = ContextVar("parts", default=(KEY,))


@contextmanager
def partitioned_by(*columns: str) -> Iterator[None]:
    """Windows made inside are partitioned by these columns instead of the ticker."""
    before = _parts.set(columns)
    try:
        yield
    finally:
        _parts.reset(before)


def ordered() -> WindowSpec:
    return Window.partitionBy(*_parts.get()).orderBy(TIME)


def last_rows(n: int) -> WindowSpec:
    return ordered().rowsBetween(-(n - 1), 0)


def last_days(n: int) -> WindowSpec:
    """The rows of the last n days by the calendar, this one included, however many they are."""
    return Window.partitionBy(*_parts.get()).orderBy(F.unix_date(TIME)).rangeBetween(-(n - 1), 0)


def so_far() -> WindowSpec:
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def from_here() -> WindowSpec:
    return ordered().rowsBetween(0, Window.unboundedFollowing)


def rolling(agg: Callable[[Column], Column], value: Column, n: int, least: int | None = None) -> Column:
    w = last_rows(n)
    return F.when(F.count(value).over(w) >= (n if least is None else least), agg(value).over(w))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a, b)


def lagged(c: str, k: int = 1) -> Column:
    return F.lag(c, k).over(ordered())


def by_key(df: DataFrame) -> DataFrame:
    """df with each ticker's rows in one of as many partitions as shuffles have.

    Spark joins partitions that are small in bytes, which leaves one task with the windows of all tickers.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *_parts.get())


def numeric_columns(df: DataFrame, besides: Iterable[str] = ()) -> list[str]:
    skip = {KEY, TIME, *besides}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating columns becomes null, which is what the operators skip."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double")) for c in floats}) if floats else df


def _standard_moment(values: Column, mean: Column, std: Column, n: int, k: int) -> Column:
    """Mean of the k-th powers of the values' distances from their mean, in population deviations."""
    power = lambda d: reduce(mul, [d] * k)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + power(x - mean))
    return ratio(total, power(std)) * (((n / (n - 1)) ** (k / 2)) / n)


def skewness(values: Column, mean: Column, std: Column, n: int) -> Column:
    """Of n values in an array, with their mean and sample deviation. Bias-corrected, as sample skewness; null below three values or without spread."""
    if n < 3:
        return F.lit(None).cast("double")
    return F.when(std > 0, _standard_moment(values, mean, std, n, 3) * ((n * (n - 1)) ** 0.5 / (n - 2)))


def kurtosis(values: Column, mean: Column, std: Column, n: int) -> Column:
    """As skewness(): bias-corrected excess kurtosis; null below four values or without spread."""
    if n < 4:
        return F.lit(None).cast("double")
    excess = _standard_moment(values, mean, std, n, 4) - 3
    return F.when(std > 0, ((n + 1) * excess + 6) * ((n - 1) / ((n - 2) * (n - 3))))
