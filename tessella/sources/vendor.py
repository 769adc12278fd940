"""Bars or series from a provider, as a Spark data source: one partition a ticker, rows from a function that is passed in."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessella.sources.io import panel_schema


def provider(fetch: Callable[[str, str, str], Iterable[tuple]], schema: str | None = None, name: str = "vendor_bars") -> type[DataSource]:
    """A data source whose rows are fetch(ticker, start, end); schema: of these rows, by default a panel's."""

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.tickers = [t for t in options.get("tickers", "").split(",") if t]
            self.span = options.get("start", ""), options.get("end", "")

        def partitions(self) -> Sequence[InputPartition]:
            return [InputPartition(t) for t in self.tickers]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from fetch(partition.value, *self.span)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self):
            return schema or panel_schema()

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return Source


def download(spark: SparkSession, source: type[DataSource], tickers: Sequence[str], start: str, end: str) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("tickers", ",".join(tickers)).option("start", start).option("end", end).load()
