"""p-values, verdicts and labels beside the statistics of `stats`: tables of one row, or one row a pair or group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import pvalues
from . import stats

def tail(f, *columns: Column) -> Column:
    """f(values of a row) as a column; null where a value is null."""

    @F.pandas_udf("double")
    def p(*xs: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*xs, strict=True)], dtype="float64")

    return p(*[c.cast("double") for c in columns])


def judged(df: DataFrame, p: Column, alpha: float = DEFAULTS.alpha) -> DataFrame:
    return df.withColumn("p_value", p).withColumn("significant", F.col("p_value") < alpha)


def t_test(df: DataFrame, value: str, group: str) -> DataFrame:
    out = judged(stats.t_test(df, value, group), tail(pvalues.t_two_sided, F.col("t"), F.col("df")))
    d = F.col("effect_size")
    return out.withColumn("effect", F.when(d >= 0.8, "large").when(d >= 0.5, "medium").when(d >= 0.2, "small").otherwise("negligible"))


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    return judged(stats.anova(df, value, group), tail(pvalues.f_tail, F.col("f"), F.col("df_between"), F.col("df_within")))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    return judged(stats.kruskal(df, value, group), tail(pvalues.chi2_tail, F.col("h"), F.col("df")))


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    return judged(stats.mann_whitney(df, value, group), tail(pvalues.normal_two_sided, F.col("z")))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    out = judged(stats.chi_square(df, a, b), tail(pvalues.chi2_tail, F.col("chi2"), F.col("df")))
    v = F.col("cramers_v")
    return out.withColumn("association", F.when(v >= 0.25, "strong").when(v >= 0.15, "moderate").when(v >= 0.05, "weak").otherwise("negligible"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r, n, p_value, significant, strength) of all pairs over rows complete in all columns."""
    n = df.dropna(subset=columns).agg(F.count("*").alias("n"))  # one row
    out = stats.pearson_pairs(df, columns).crossJoin(F.broadcast(n))
    out = judged(out, tail(lambda r, n: stats_p(r, int(n)), F.col("r"), F.col("n")))
    r = F.abs("r")
    return out.withColumn("strength", F.when(r >= 0.7, "strong").when(r >= 0.5, "moderate").when(r >= 0.3, "weak").otherwise("negligible"))


def stats_p(r: float, n: int) -> float | None:
    if n < 3:
        return None
    return 0.0 if abs(r) >= 1 else pvalues.t_two_sided(r * ((n - 2) / (1 - r * r)) ** 0.5, n - 2)


def linear_trend(df: DataFrame, y: str, x: str, group: str | None = None) -> DataFrame:
    """linear_trend with the p-value of its slope."""
    r = F.sqrt("r2")
    return judged(stats.linear_trend(df, y, x, group), tail(lambda r, n: stats_p(r, int(n)), r, F.col("n")))


def trends_over_time(df: DataFrame, time: str, metrics: list[str]) -> DataFrame:
    """(metric, slope, intercept, r2, n, direction, strength, p_value, significant) of several metrics over days, a row each, from one grouped pass."""
    days = F.unix_micros(F.col(f"`{time}`").cast("timestamp")) / 86_400_000_000
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("y")) for m in metrics]))
    return linear_trend(df.select(days.alias("x"), cells.alias("c")).select("x", "c.*"), "y", "x", "metric")


def cohens_d(df: DataFrame, value: str, group: str) -> DataFrame:
    """Mean gap of the first and last group by name over their pooled deviation."""
    m = stats.group_moments(df, value, group).agg(F.min_by(F.struct("n", "m", "v"), "g").alias("a"), F.max_by(F.struct("n", "m", "v"), "g").alias("b"))
    pooled = F.try_divide((F.col("a.n") - 1) * F.col("a.v") + (F.col("b.n") - 1) * F.col("b.v"), F.col("a.n") + F.col("b.n") - 2)
    return m.select(F.coalesce(F.try_divide(F.col("a.m") - F.col("b.m"), F.sqrt(pooled)), F.lit(0.0)).alias("d"))


def dagostino(df: DataFrame, c: str, least: int = 20) -> DataFrame:
    """D'Agostino and Pearson's omnibus test of normality from the moments: (n, k2, p_value), null below least rows or without spread."""
    s = df.agg(F.count(c).cast("double").alias("n"), F.skewness(c).alias("g1"), F.kurtosis(c).alias("g2"))
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(F.log(F.sqrt(w2)))
    spread = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 6 / (n + 1)) / F.sqrt(spread)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    cube = F.cbrt((1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4))))
    z2 = (1 - 2 / (9 * a) - cube) / F.sqrt(2 / (9 * a))
    k2 = F.when((n >= least) & ~F.isnan("g1") & g1.isNotNull(), z1 * z1 + z2 * z2)
    return s.select("n", k2.alias("k2"), F.exp(-k2 / 2).alias("p_value"))


def ks_normal(df: DataFrame, c: str, alpha: float = DEFAULTS.alpha) -> DataFrame:
    """(d, n, p_value, normal): the Kolmogorov-Smirnov test against the normal distribution fitted to the values."""
    out = stats.ks_normal(df, c)
    return out.withColumn("p_value", tail(pvalues.kolmogorov_tail, F.col("d"), F.col("n"))).withColumn("normal", F.col("p_value") > alpha)


def ks_exponential(df: DataFrame, c: str, alpha: float = DEFAULTS.alpha) -> DataFrame:
    """(d, n, p_value, exponential): the same against the exponential distribution of the values' mean; null where a value is negative."""
    out = stats.ks_exponential(df, c)
    return out.withColumn("p_value", tail(pvalues.kolmogorov_tail, F.col("d"), F.col("n"))).withColumn("exponential", F.col("p_value") > alpha)
