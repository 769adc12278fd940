"""Helpers that the text operators share: patterns, materialised tables, row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the corpus contracts: space, and tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one of our own, on one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs no recomputation, and gives Spark the table's true size,
    by which it decides alone whether a join may broadcast it. Shuffle files of the write go as soon as it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessella_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by stored() that nothing reads any more."""
    path = getattr(df, "_tessella_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """A to Z only; other letters stay, unlike lower()."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def pieces(text: Column, separators: str) -> Column:
    """What stands between runs of separators; splitting takes half the time of matching what is between."""

    def bare(s: Column) -> Column:
        first, last = (F.get(s, F.lit(0)) == "").cast("int"), (F.element_at(s, -1) == "").cast("int")
        return F.slice(s, first + 1, F.greatest(F.size(s) - first - last, F.lit(0)))

    return let(F.split(text, separators, -1), bare)


def words(text: Column) -> Column:
    return pieces(text, SPACES)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two non-null longs naming a document: its id and its text. Repeated rows share a key and so a result."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("_tsl_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_tsl_text")]


def beta_strength(n: float | None, k: float | None, groups: int | None, n2: float | None, k2n: float | None) -> float:
    """Strength of the beta prior whose groups scatter as these do (moments of over-dispersed binomials).

    n, k: trials and failures in all groups; n2: sum of squared trials; k2n: sum of k_i^2 / n_i.
    """
    n, k, groups, n2, k2n = n or 0, k or 0, groups or 0, n2 or 0.0, k2n or 0.0
    rho = 0.01
    if 0 < k < n:
        p = k / n
        room = n - n2 / n - (groups - 1)
        if room > 0:
            rho = ((k2n - k * k / n) / (p * (1 - p)) - (groups - 1)) / room
    return round(1 / min(0.5, max(0.001, rho)) - 1, 6)


def beta_strength_sql(rel: str) -> str:
    """The same in SQL over a relation with columns n and k of groups (n > 0)."""
    return f"""(SELECT round(1 / least(0.5, greatest(0.001, coalesce(CASE WHEN k > 0 AND k < n AND n - n2 / n - (g - 1) > 0
        THEN ((k2n - k * k / n) / (k / n * (1 - k / n)) - (g - 1)) / (n - n2 / n - (g - 1)) END, 0.01))) - 1, 6)
    FROM (SELECT CAST(sum(n) AS DOUBLE) AS n, CAST(sum(k) AS DOUBLE) AS k, count(*) AS g, CAST(sum(n * n) AS DOUBLE) AS n2,
                 sum(CAST(k AS DOUBLE) * k / n) AS k2n FROM {rel} WHERE n > 0))"""


def strength_of(groups: DataFrame) -> float:
    """beta_strength() of a table with columns n and k; one aggregate row comes to the driver."""
    x = groups.where("n > 0").agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("g"), F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("k").cast("double") * F.col("k") / F.col("n")).alias("k2n"),
    ).first()
    return beta_strength(x.n, x.k, x.g, x.n2, x.k2n)


def strength_around(groups: DataFrame) -> float:
    """Strength of the beta priors whose means are the groups' parents' rates: groups has n, k and parent.

    With k of n over-dispersed around p, (k - np)^2 is expected to be np(1-p)(1 + (n - 1) rho), and strength is 1/rho - 1.
    """
    n, k, p = F.col("n").cast("double"), F.col("k").cast("double"), F.col("parent")
    x = groups.where("n > 0").agg(F.sum((k - n * p) * (k - n * p) - n * p * (1 - p)).alias("over"), F.sum(n * (n - 1) * p * (1 - p)).alias("room")).first()
    rho = x.over / x.room if x.room else 0.01
    return round(1 / min(0.5, max(0.001, rho)) - 1, 6)


def strength_around_sql(rel: str) -> str:
    """The same in SQL over a relation with columns n, k and parent."""
    return f"""(SELECT round(1 / least(0.5, greatest(0.001, coalesce(sum(CASE WHEN n > 0 THEN (k - n * parent) * (k - n * parent) - n * parent * (1 - parent) END)
        / nullif(sum(CASE WHEN n > 0 THEN CAST(n AS DOUBLE) * (n - 1) * parent * (1 - parent) END), 0), 0.01))) - 1, 6) FROM {rel})"""
