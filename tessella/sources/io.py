"""Files in and out: Parquet, CSV and JSON with explicit schemas, first-that-exists sources, result tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.windows import nan_to_null

FORMATS = ("parquet", "csv", "json")


def panel_schema(*more: str) -> T.StructType:
    """Ticker, Date, prices and volume, and further columns, all double."""
    fields = [T.StructField("Date", T.DateType()), T.StructField("Ticker", T.StringType())]
    return T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in ("Open", "High", "Low", "Close", "Volume", *more)])


def bond_schema(lags: int = 3) -> T.StructType:
    names = ["Yield_Change", *(f"Yield_Change_Lag{k}" for k in range(1, lags + 1))]
    return T.StructType([T.StructField("Yield", T.DoubleType()), T.StructField("Date", T.DateType()), T.StructField("Ticker", T.StringType()), *(T.StructField(n, T.DoubleType()) for n in names)])


def load(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """A table of one of FORMATS. CSV and JSON need a schema, so that nothing is inferred by a pass of its own."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is none of {FORMATS}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    return nan_to_null(reader.format(fmt).load(path))


def save(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Overwrite path with df."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is none of {FORMATS}")
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def first_of(spark: SparkSession, sources: Sequence[tuple[str, str]], schema: T.StructType | None = None) -> DataFrame:
    """The first (path, format) that exists: a cleaned table, else a processed one, else the raw file."""
    for path, fmt in sources:
        if exists(spark, path):
            return load(spark, path, fmt, schema if fmt != "parquet" else None)
    raise FileNotFoundError(", ".join(p for p, _ in sources))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made and written first if it is not there."""
    if not exists(spark, path):
        save(make(), path)
    return load(spark, path)


def save_results(tables: dict[str, DataFrame], folder: str) -> None:
    """Small result tables, each as one CSV file with a header."""
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/{name}")


def to_records(df: DataFrame) -> DataFrame:
    """One JSON document a row, in column `json`."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
