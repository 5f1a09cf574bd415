"""Profiles: statistics of many columns in one aggregate, then one row a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sample_kurtosis, sample_skewness
from .quantiles import percentile_table

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, k in df.dtypes if k in NUMERIC or k.startswith("decimal")]


def metric_columns(df: DataFrame) -> list[str]:
    """Numeric columns whose names don't mark weeks, flags or ids."""
    return [c for c in numeric_columns(df) if not any(x in c.lower() for x in ("weekofyear", "_flag", "_id"))]


def by_column(df: DataFrame, columns: list[str], stats: dict[str, callable]) -> DataFrame:
    """One aggregate over all columns, turned to rows (column, *stats)."""
    wide = df.agg(*[F.struct(*[f(F.col(c)).alias(k) for k, f in stats.items()]).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"_{i}.{k}").alias(k) for k in stats]) for i, c in enumerate(columns)])
    return wide.select(F.inline(rows))


def numeric_kpis(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, median, std, min, max, sum, quartiles, iqr, cv, skew, kurtosis, range and outer percentiles by column."""
    d = lambda f: lambda c: f(c.cast("double"))
    places = {"median": 0.5, "q25": 0.25, "q75": 0.75, "p5": 0.05, "p10": 0.1, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    stats = {"count": lambda c: F.count(c), "mean": d(F.avg), "std": d(F.stddev_samp), "min": d(F.min), "max": d(F.max), "sum": d(F.sum), "skewness": d(sample_skewness), "kurtosis": d(sample_kurtosis)}
    columns = columns or metric_columns(df)
    out = by_column(df, columns, stats).join(F.broadcast(percentile_table(df, columns, places)), "column")  # one row a column
    return out.withColumns({"iqr": F.col("q75") - F.col("q25"), "cv": F.when(F.col("mean") != 0, F.col("std") / F.col("mean")), "range": F.col("max") - F.col("min")})


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n, share) of the non-null values of several columns, in one grouped pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(pairs.alias("p")).select("p.*").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("column")))


def categorical_kpis(df: DataFrame, columns: list[str], top: int = 3) -> DataFrame:
    """distinct, mode (ties: the smallest value), its count and percent, entropy in bits, share of the top values in percent."""
    v = value_counts(df, columns).withColumn("_r", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value")))
    first = lambda c: F.max(F.when(F.col("_r") == 1, F.col(c)))
    return v.groupBy("column").agg(F.count("*").alias("distinct_values"), first("value").alias("mode"), first("n").alias("mode_count"), (100 * first("share")).alias("mode_percent"), (-F.sum(F.col("share") * F.log2("share"))).alias("entropy"), (100 * F.sum(F.when(F.col("_r") <= top, F.col("share")))).alias("top_concentration"))


def time_kpis(df: DataFrame, c: str) -> DataFrame:
    return df.agg(F.countDistinct(c).alias("periods"), F.min(c).alias("first"), F.max(c).alias("last"), F.count(F.when(F.col(c).isNull(), 1)).alias("missing"))


def missingness(df: DataFrame) -> DataFrame:
    stats = {"missing": lambda c: F.count(F.when(c.isNull(), 1)), "rows": lambda c: F.count(F.lit(1))}
    return by_column(df, df.columns, stats).withColumn("missing_share", F.try_divide(F.col("missing").cast("double"), F.col("rows").cast("double")))


def duplicate_rate(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows: counts per distinct row, then a sum, so both steps combine before the shuffle."""
    n = df.groupBy(df.columns).agg(F.count("*").alias("_n"))
    return n.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates")).withColumn("rate", F.try_divide(F.col("duplicates").cast("double"), F.col("rows").cast("double")))


def complete_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    full = F.lit(True)
    for c in columns or df.columns:
        full = full & F.col(c).isNotNull()
    return df.agg(F.count("*").alias("rows"), F.count(F.when(full, 1)).alias("complete"))


def column_flags(df: DataFrame, columns: list[str], many: float = 0.8, least: int = 100) -> DataFrame:
    """constant and high_cardinality by column."""
    stats = {"distinct_values": F.countDistinct, "values": F.count}
    out = by_column(df, columns, stats)
    return out.select("column", "distinct_values", (F.col("distinct_values") <= 1).alias("constant"), ((F.col("distinct_values") > least) & (F.col("distinct_values") > many * F.col("values"))).alias("high_cardinality"))


def feature_importance(df: DataFrame, columns: list[str]) -> DataFrame:
    stats = {"variance": F.var_samp, "share": lambda c: F.count(c) / F.count(F.lit(1))}
    return by_column(df, columns, stats).select("column", (F.col("variance") * F.col("share")).alias("importance"))


def extreme_values(df: DataFrame, columns: list[str], huge: float = 1e10) -> DataFrame:
    stats = {"infinite": lambda c: F.count(F.when(F.abs(c.cast("double")) == float("inf"), 1)), "huge": lambda c: F.count(F.when(F.abs(c) > huge, 1))}
    return by_column(df, columns, stats)


def histogram(df: DataFrame, c: str, bins: int = 30) -> DataFrame:
    """(bin from 1, n, density) over equal bins; the maximum falls in the last bin. A constant column is one bin without density."""
    b = df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"), F.count(c).alias("_n"))
    x = df.select(F.col(c).cast("double").alias("x")).where("x is not null").crossJoin(F.broadcast(b))  # one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.lit(bins), F.floor(F.coalesce(F.try_divide(F.col("x") - F.col("_lo"), width), F.lit(0.0))).cast("long") + 1)
    return x.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.try_divide(F.count("*").cast("double"), F.first("_n") * F.first(width)).alias("density"))


def quartile_classes(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many values are Low (at most the first quartile), Medium, High (above the third), over all columns."""
    q = percentile_table(df, columns, {"q1": 0.25, "q3": 0.75})
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("p")).select("p.*").where("x is not null")
    label = F.when(F.col("x") <= F.col("q1"), "Low").when(F.col("x") > F.col("q3"), "High").otherwise("Medium")
    return long.join(F.broadcast(q), "column").groupBy(label.alias("class")).agg(F.count("*").alias("n"))  # one row a column


def row_quality_bins(df: DataFrame, columns: list[str], bins: int = 5) -> DataFrame:
    """Null counts per row in equal bins that hold their right edge."""
    nulls = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    x = df.groupBy(nulls.alias("nulls")).agg(F.count("*").alias("n"))
    edge = x.agg(F.min("nulls").alias("_lo"), F.max("nulls").alias("_hi"))
    x = x.crossJoin(F.broadcast(edge))
    place = F.greatest(F.lit(1), F.ceil(F.try_divide((F.col("nulls") - F.col("_lo")).cast("double"), (F.col("_hi") - F.col("_lo")) / bins))).cast("long")
    return x.groupBy(F.coalesce(place, F.lit(1)).alias("bin")).agg(F.sum("n").alias("n"))


def kde(df: DataFrame, c: str, points: int = 100) -> DataFrame:
    """Gaussian kernel density on an even grid, bandwidth by Scott's rule. Values are pre-aggregated, the grid is fixed in size."""
    b = df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"), F.count(c).alias("_n"), F.stddev_samp(c).alias("_s"))
    x = df.groupBy(F.col(c).cast("double").alias("x")).agg(F.count("*").alias("w")).where("x is not null").crossJoin(F.broadcast(b))
    h = F.col("_s") * F.pow("_n", F.lit(-0.2))
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")
    x = x.where("_n > 10 and _s > 1e-10").select("*", grid).withColumn("at", F.col("_lo") + F.col("point") * (F.col("_hi") - F.col("_lo")) / (points - 1))
    return x.groupBy("point", "at").agg((F.sum(F.col("w") * F.exp(-0.5 * F.pow((F.col("at") - F.col("x")) / h, F.lit(2)))) / F.first(F.col("_n") * h * (2 * 3.141592653589793) ** 0.5)).alias("density"))
