"""As-of joins: the last values known at a time, whether or not anything is dated on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.blocks import last_known
from tessella.functions.windows import KEY, TIME


def asof_join(left: DataFrame, right: DataFrame, columns: Sequence[str], by: Sequence[str] = (KEY,), time: str = TIME, strict: bool = False) -> DataFrame:
    """left with the last value that is not null of each of right's columns at or before left's time (strict: before it).

    by: columns that must be alike; without any, right is one series for all rows. Both sides' times are put into one
    timeline per key, tagged by side, and each time takes the last known values; only times and keys go through that, and
    left meets them by an equi-join. Rows of left stay as they are, null times take nothing. right's values on equal times
    and keys should be one row; of several any may be taken.
    """
    at = [*by, time]
    asked = left.where(F.col(time).isNotNull()).select(*at).distinct().select(*at, *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in columns), F.lit(1).alias("_side"))
    told = right.where(F.col(time).isNotNull()).select(*at, *columns, F.lit(2 if strict else 0).alias("_side"))
    known = last_known(asked.unionByName(told), columns, by, time, ["_side"]).where("_side = 1").drop("_side")
    known = known.withColumnsRenamed({c: f"_of_{c}" for c in at})
    return left.drop(*columns).join(known, F.expr(" AND ".join(f"`{c}` <=> `_of_{c}`" for c in at)), "left").drop(*(f"_of_{c}" for c in at))
