"""Feature tables: rolling statistics, lags, interactions, scaling and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.windows import kurtosis, lagged, last_rows, numeric_columns, ratio, skewness
from tessella.operators.returns import WINDOWS

METRICS = ("mean", "std", "min", "max", "skew", "kurtosis")
LAGS = (1, 2, 3, 5, 10, 21)


def rolling_stats(df: DataFrame, columns: Sequence[str] | None = None, windows: Sequence[int] = WINDOWS, metrics: Sequence[str] = METRICS) -> DataFrame:
    """{column}_Rolling_{Metric}_{n}; null until n values are there. Name the columns: their number multiplies.

    Each frame is aggregated once for all metrics. Skewness and kurtosis are sums over its values as an array: as
    aggregates they update all moments for every value of every frame, which took most of the time.
    """
    value = {
        "count": F.count, "mean": F.avg, "std": F.stddev, "min": F.min, "max": F.max, "values": lambda x: F.collect_list(x.cast("double")),
    }
    shape = {"skew": skewness, "kurtosis": kurtosis}
    needed = {"count", *(m for m in metrics if m not in shape), *(("mean", "std", "values") if set(metrics) & set(shape) else ())}
    frames, out = {}, {}
    for i, c in enumerate(columns or numeric_columns(df)):
        for n in windows:
            name = {k: f"_rolling_{k}_{i}_{n}" for k in needed}
            frames |= {name[k]: value[k](F.col(c)).over(last_rows(n)) for k in value if k in needed}
            for m in metrics:
                x = shape[m](F.col(name["values"]), F.col(name["mean"]).cast("double"), F.col(name["std"]), n) if m in shape else F.col(name[m])
                out[f"{c}_Rolling_{m.capitalize()}_{n}"] = F.when(F.col(name["count"]) >= n, x)
    return df.withColumns(frames).withColumns(out).drop(*frames)


def lag_features(df: DataFrame, columns: Sequence[str] | None = None, ks: Sequence[int] = LAGS) -> DataFrame:
    return df.withColumns({f"{c}_Lag_{k}": lagged(c, k) for c in columns or numeric_columns(df) for k in ks})


def interactions(df: DataFrame) -> DataFrame:
    """Products and ratios of those pairs whose columns are there."""
    has, c = set(df.columns), F.col
    out = {}
    if {"Volume", "Close_Adj"} <= has:
        out |= {"Price_Volume_Interaction": c("Close_Adj") * c("Volume"), "Volume_Price_Ratio": ratio(c("Volume"), c("Close_Adj"))}
    if {"Volatility_21", "Return"} <= has:
        out |= {"Volatility_Return_Interaction": c("Volatility_21") * c("Return"), "Return_Volatility_Ratio": ratio(c("Return"), c("Volatility_21"))}
    if {"RSI", "MACD"} <= has:
        out["RSI_MACD_Interaction"] = c("RSI") * c("MACD")
    if {"Sentiment_Score", "Return"} <= has:
        out["Sentiment_Return_Interaction"] = c("Sentiment_Score") * c("Return")
    return df.withColumns(out) if out else df


def scale_standard(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """{column}_Scaled: (x - mean) / population deviation over all rows; without spread 0.

    The moments are one aggregate row; they come back as constants, so the scaling itself moves nothing.
    """
    columns = list(columns or numeric_columns(df))
    m = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
    return df.withColumns({f"{c}_Scaled": (F.col(c) - F.lit(m[f"m{i}"]).cast("double")) / F.lit(m[f"s{i}"] or 1.0) for i, c in enumerate(columns)})


def scale_in_place(df: DataFrame) -> DataFrame:
    """df with every numeric column scaled as by scale_standard(), under its own name."""
    columns = numeric_columns(df)
    scaled = scale_standard(df, [f"`{c}`" for c in columns])
    return scaled.select(*(F.col(f"`{'`' * 2}{c}{'`' * 2}_Scaled`").alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns))


def scale_vector(df: DataFrame, columns: Sequence[str] | None = None, with_mean: bool = False) -> DataFrame:
    """features and scaled_features vectors; nulls are kept as NaN."""
    stages = [VectorAssembler(inputCols=list(columns or numeric_columns(df)), outputCol="features", handleInvalid="keep"), StandardScaler(inputCol="features", outputCol="scaled_features", withMean=with_mean, withStd=True)]
    return Pipeline(stages=stages).fit(df).transform(df)


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """a, b, corr of every pair of columns (a before b), pairwise complete, from one aggregate."""
    columns = list(columns or numeric_columns(df))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    safe = lambda a, b: F.when((F.var_pop(F.when(F.col(b).isNotNull(), F.col(a))) > 0) & (F.var_pop(F.when(F.col(a).isNotNull(), F.col(b))) > 0), F.corr(a, b))
    one = df.agg(*(safe(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("corr")) for k, (a, b) in enumerate(pairs)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def correlated(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.95) -> DataFrame:
    """column: those that an earlier column predicts, |corr| above the threshold."""
    return correlations(df, columns).where(F.abs("corr") > threshold).select(F.col("b").alias("column")).distinct()


def select_uncorrelated(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.95) -> DataFrame:
    return df.drop(*(r["column"] for r in correlated(df, columns, threshold).collect()))


def select_variance(df: DataFrame, columns: Sequence[str] | None = None, least: float = 0.0) -> DataFrame:
    """df without columns whose variance is not above `least`."""
    columns = list(columns or numeric_columns(df))
    v = df.agg(*(F.var_samp(c).alias(f"v{i}") for i, c in enumerate(columns))).first()
    return df.drop(*(c for i, c in enumerate(columns) if (v[f"v{i}"] or 0.0) <= least))


def mutual_information(df: DataFrame, target: str, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """feature, importance: mutual information of equal-count bins with the target's, over complete rows.

    Bin edges are quantiles (a few numbers); rows are then counted per cell, and only cells go on.
    """
    full = df.select(target, *columns).dropna()
    names = [target, *columns]
    levels = [i / bins for i in range(1, bins)]
    row = full.agg(*(F.percentile(c, F.array(*map(F.lit, levels))).alias(f"q{i}") for i, c in enumerate(names))).first()
    edges = {c: row[f"q{i}"] or [] for i, c in enumerate(names)}
    cell = lambda c: sum(((F.col(c) > e).cast("int") for e in edges[c]), F.lit(0))
    pairs = full.select(cell(target).alias("t"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), cell(c).alias("x")) for c in columns))).alias("f"))
    joint = pairs.groupBy("f.feature", "f.x", "t").agg(F.count("*").alias("n"))
    over = lambda *by: F.sum("n").over(Window.partitionBy(*by)).cast("double")
    all_, fx, ft = over("feature"), over("feature", "x"), over("feature", "t")
    part = joint.select("feature", (F.col("n") / all_ * F.ln(F.col("n") * all_ / (fx * ft))).alias("i"))
    return part.groupBy("feature").agg(F.sum("i").alias("importance"))


def forest_importance(df: DataFrame, target: str, columns: Sequence[str], trees: int = 20, depth: int = 5, seed: int = 42) -> DataFrame:
    """feature, importance: by how much each column's splits reduce the target's variance in a random forest; they sum to 1.

    Rows that are not complete are left out. Trees are grown level by level by Spark over all rows, from binned columns,
    so only bins' sums move. The same rows and seed give the same forest.
    """
    full = df.select(target, *columns).dropna().select(F.col(target).cast("double").alias("label"), *(F.col(c).cast("double").alias(c) for c in columns))
    full = VectorAssembler(inputCols=list(columns), outputCol="features").transform(full).select("label", "features")
    model = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed).fit(full)
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray(), strict=True)], "feature string, importance double")


def top_features(importance: DataFrame, k: int = 10) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(k)
