"""One ticker's history as many tasks: numbering by buckets of time, scans of affine maps, bounded windows with halos, last
known values.

A bucket is a span of time (a year of dates, a day of timestamps) and holds few rows of one ticker; what a bucket needs from
those before it is one small row of sums, carried over a table of buckets. Rows never meet in one task for being of one
ticker. Other buckets can be named where rows are denser.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.windows import KEY, TIME, partitioned_by

#: Rows folded at a time, and levels above the rows: a scan's last fold goes over one row for each LENGTH ** (LEVELS + 1).
LENGTH, LEVELS = 32, 2
ROWS = 1 << 16


def bucket_of(df: DataFrame, time: str = TIME) -> Column:
    """The year of a date, the day of a timestamp, 4,096 numbers."""
    kind = df.schema[time].dataType
    return F.year(time) if isinstance(kind, T.DateType) else F.floor(F.col(time) / 4096) if isinstance(kind, T.NumericType) else F.to_date(time)


def _before(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)


def running(df: DataFrame, sums: Mapping[str, Column], by: Sequence[str] = (KEY,), time: str = TIME, bucket: Column | None = None) -> DataFrame:
    """df with the sum of each column over all rows of the same key up to and including this one, in place of one of its name; nulls count nothing."""
    own = [f"_part_{c}" for c in sums]
    x = df.withColumns({"_bucket": bucket_of(df, time) if bucket is None else bucket} | {p: v for p, v in zip(own, sums.values(), strict=True)})
    totals = x.groupBy(*by, "_bucket").agg(*(F.coalesce(F.sum(p), F.lit(0)).alias(f"{p}_all") for p in own))
    bases = totals.select(*by, "_bucket", *(F.sum(f"{p}_all").over(_before(by)).alias(f"{p}_base") for p in own))
    here = Window.partitionBy(*by, "_bucket").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({f"{p}_here": F.sum(p).over(here) for p in own})
    both = x.join(_as(bases, by), _same(by), "left")
    zero = F.lit(0)
    return both.select(*(c for c in df.columns if c not in sums), *((F.coalesce(f"{p}_here", zero) + F.coalesce(f"{p}_base", zero)).alias(c) for c, p in zip(sums, own, strict=True)))


def _as(small: DataFrame, by: Sequence[str]) -> DataFrame:
    return small.withColumnsRenamed({c: f"_of_{c}" for c in (*by, "_bucket")})


def _same(by: Sequence[str]) -> Column:
    """Keys and buckets alike; null ones are alike, too."""
    return F.expr(" AND ".join(f"`{c}` <=> `_of_{c}`" for c in (*by, "_bucket")))


def numbered(df: DataFrame, name: str = "_i", bucket: Column | None = None) -> DataFrame:
    """df with each row's number in its ticker, from 0."""
    return running(df, {name: F.lit(1)}, bucket=bucket).withColumn(name, F.col(name) - 1)


def numbered_all(df: DataFrame, name: str = "i", time: str = TIME) -> DataFrame:
    """df with each row's number among all rows, from 0, in order of time."""
    return running(df, {name: F.lit(1)}, (), time).withColumn(name, F.col(name) - 1)


def last_known(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (KEY,), time: str = TIME, tie: Sequence[str] = (), bucket: Column | None = None) -> DataFrame:
    """df with the last value that is not null, up to and including this row, in each of the columns."""
    x = df.withColumn("_bucket", bucket_of(df, time) if bucket is None else bucket)
    order = [time, *tie]
    last = x.groupBy(*by, "_bucket").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_last_{c}") for c in columns))
    carried = last.select(*by, "_bucket", *(F.last(f"_last_{c}", ignorenulls=True).over(_before(by)).alias(f"_carry_{c}") for c in columns))
    here = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({f"_here_{c}": F.last(c, ignorenulls=True).over(here) for c in columns})
    both = x.join(_as(carried, by), _same(by), "left")
    return both.select(*(F.coalesce(f"_here_{c}", f"_carry_{c}").alias(c) if c in columns else F.col(c) for c in df.columns))


def _maps(names: Sequence[str]) -> Column:
    return F.struct(*(F.struct(F.col(f"_a_{c}").alias("a"), F.col(f"_b_{c}").alias("b")).alias(c) for c in names))


def _compose(names: Sequence[str], start: Column):
    """Fold of maps, the later ones outside."""
    step = lambda acc, m: F.struct(*(F.struct((m[c]["a"] * acc[c]["a"]).alias("a"), (m[c]["a"] * acc[c]["b"] + m[c]["b"]).alias("b")).alias(c) for c in names))
    return lambda maps: F.aggregate(maps, start, step)


def _identity(names: Sequence[str]) -> Column:
    return F.struct(*(F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")).alias(c) for c in names))


def _carries(table: DataFrame, names: Sequence[str], levels: int, length: int) -> DataFrame:
    """Ticker, _block, _start (struct): what each block of table (Ticker, _block, _a_*, _b_*) starts from."""
    if not levels:
        before = F.collect_list(_maps(names)).over(Window.partitionBy(KEY).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
        whole = table.withColumn("_m", _compose(names, _identity(names))(before))
        return whole.select(KEY, "_block", F.struct(*(F.col("_m")[c]["b"].alias(c) for c in names)).alias("_start"))
    x = table.withColumn("_over", F.floor(F.col("_block") / length))
    w = Window.partitionBy(KEY, "_over").orderBy("_block")
    x = x.withColumns({
        "_m": _compose(names, _identity(names))(F.collect_list(_maps(names)).over(w.rowsBetween(Window.unboundedPreceding, 0))),
    }).withColumn("_p", F.coalesce(F.lag("_m").over(w), _identity(names)))
    above = x.groupBy(KEY, F.col("_over").alias("_block")).agg(F.max_by("_m", "_block").alias("_m"))
    above = above.select(KEY, "_block", *(F.col("_m")[c][k].alias(f"_{k}_{c}") for c in names for k in "ab"))
    start = _carries(above, names, levels - 1, length).withColumnsRenamed({KEY: "_of_key", "_block": "_of_over"})
    x = x.join(start, F.expr(f"`{KEY}` <=> _of_key AND _over = _of_over"))
    return x.select(KEY, "_block", F.struct(*((F.col("_p")[c]["a"] * F.col("_start")[c] + F.col("_p")[c]["b"]).alias(c) for c in names)).alias("_start"))


def scan(df: DataFrame, maps: Mapping[str, tuple[Column, Column]], index: str = "_i", length: int = LENGTH, levels: int = LEVELS) -> DataFrame:
    """df with columns y = a * (y of the row before) + b for each of maps (a, b), from y = 0 before a ticker's first row.

    index: the row's number in its ticker (numbered()). Maps of a block of rows compose to one map, so blocks are folded by
    themselves, then their maps by the same means, and each row is its block's map applied to what the block starts from.
    Nothing is cut off, and any coefficients will do: a = 1 and b = 0 skips a row, a = 0 starts anew.
    """
    names = list(maps)
    x = df.withColumns({"_block": F.floor(F.col(index) / length)} | {f"_{k}_{c}": v.cast("double") for c, ab in maps.items() for k, v in zip("ab", ab, strict=True)})
    w = Window.partitionBy(KEY, "_block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_m", _compose(names, _identity(names))(F.collect_list(_maps(names)).over(w)))
    blocks = x.groupBy(KEY, "_block").agg(F.max_by("_m", index).alias("_m")).select(KEY, "_block", *(F.col("_m")[c][k].alias(f"_{k}_{c}") for c in names for k in "ab"))
    start = _carries(blocks, names, levels, length).withColumnsRenamed({KEY: "_of_key", "_block": "_of_block"})
    x = x.join(start, F.expr(f"`{KEY}` <=> _of_key AND _block = _of_block"))
    kept = [c for c in df.columns if c not in names]
    return x.select(*kept, *((F.col("_m")[c]["a"] * F.col("_start")[c] + F.col("_m")[c]["b"]).alias(c) for c in names))


def with_halo(df: DataFrame, reach: int, then: Callable[[DataFrame], DataFrame], rows: int = ROWS, bucket: Column | None = None, number: str | None = None) -> DataFrame:
    """then(df) for a function of windows that look back at most `reach` rows, with a ticker's rows in blocks of `rows`.

    Each block also gets the last `reach` rows before it, which go again once `then` is done: its windows are partitioned
    by block meanwhile. then must keep rows and may add columns. Values are those of the undivided windows. number: a column
    for each row's number in its ticker.
    """
    if reach > rows:
        raise ValueError("a block must hold what windows reach back")
    n = F.col("_n")
    own = F.floor(n / rows)
    copies = F.when(n % rows >= rows - reach, F.array(own, own + 1)).otherwise(F.array(own))
    x = numbered(df, "_n", bucket).withColumn("_halo", F.explode(copies))
    with partitioned_by(KEY, "_halo"):
        out = then(x)
    out = out.where(F.col("_halo") == own).drop("_halo")
    return out.withColumnRenamed("_n", number) if number else out.drop("_n")
