"""Features of each ticker over a stream of ticks, kept as state: returns, exponential means, on-balance volume.

Ticks wait until the watermark has passed them and are then taken in order of time, so ticks that come late, up to the
watermark's delay, count where they belong, and the stream's rows are those of a batch over the same ticks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TICK = "seconds double, tie long, price double, volume double"
STATE = "price double, mean double, balance double, n long"
FEATURES = "Ticker string, Time timestamp, tie long, Price double, Return double, EMA double, OBV double"


def step(state: tuple | None, price: float, volume: float, span: int) -> tuple[tuple, tuple]:
    """(state after a tick, (return, mean, balance) at it): the first tick has no return, and is its own mean."""
    if state is None:
        return (price, price, 0.0, 1), (None, price, 0.0)
    before, mean, balance, n = state
    change = price / before - 1 if before else None
    mean += 2 / (span + 1) * (price - mean)
    balance += volume * ((price > before) - (price < before))
    return (price, mean, balance, n + 1), (change, mean, balance)


class Features(StatefulProcessor):
    """One ticker's state, and its ticks that wait for the watermark, each with a timer at its time."""

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)
        self.waiting = handle.getListState("waiting", TICK)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        ticks = [t for part in rows for t in part[["seconds", "tie", "price", "volume"]].itertuples(index=False, name=None)]
        self.waiting.appendList([tuple(map(float, t[:1])) + (int(t[1]), float(t[2]), float(t[3])) for t in ticks])
        for ms in {int(t[0] * 1000) for t in ticks}:
            self.handle.registerTimer(max(ms, passed + 1))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(t) for t in self.waiting.get())
        now = [t for t in waiting if t[0] * 1000 <= until]
        if not now:
            yield pd.DataFrame()
            return
        later = [t for t in waiting if t[0] * 1000 > until]
        self.waiting.clear()
        if later:
            self.waiting.put(later)
        state = tuple(self.last.get()) if self.last.exists() else None
        rows = []
        for seconds, tie, price, volume in now:
            state, told = step(state, price, volume, self.span)
            rows.append((key[0], pd.Timestamp(round(seconds * 1e6), unit="us"), tie, price, *told))
        self.last.update(state)
        yield pd.DataFrame(rows, columns=["Ticker", "Time", "tie", "Price", "Return", "EMA", "OBV"])

    def close(self) -> None:
        pass


def features(ticks: DataFrame, key: str = "event_type", time: str = "ts", tie: str = "event_id", price: str = "value", volume: str | None = None, late: str = "1 day", span: int = 12) -> DataFrame:
    """FEATURES of a stream of ticks, in the order of their time, then tie; without a volume each tick counts 1.

    Ticks without a price or time are left out. Needs a state store that transformWithState can use (RocksDB).
    """
    t = F.col(time).cast("timestamp")
    x = ticks.select(F.col(key).cast("string").alias("Ticker"), t.alias("Time"), (F.unix_micros(t) / 1e6).alias("seconds"), F.col(tie).cast("long").alias("tie"), F.col(price).cast("double").alias("price"), (F.col(volume).cast("double") if volume else F.lit(1.0)).alias("volume"))
    x = x.where("price IS NOT NULL AND Time IS NOT NULL").withWatermark("Time", late)
    return x.groupBy("Ticker").transformWithStateInPandas(Features(span), FEATURES, "Append", "EventTime")
