"""Statistics: correlation, trends, series, tests, distributions, inequality."""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pvalues
from . import ranked
from .quantiles import group_medians, percentiles


cloudpickle.register_pickle_by_value(pvalues)  # executors need not have the package


def average_ranks(df: DataFrame, c: str) -> DataFrame:
    """(value, n, rank): mean rank of each distinct value, smallest first. Values are counted first, then ranked by buckets."""
    v = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n"))
    return ranked.before(v, ["value"], F.col("n"), "_below").select("value", "n", (F.col("_below") + (F.col("n") + 1) / 2).alias("rank"))


def correlation(a: str, b: str) -> Column:
    """Pearson's r over rows that have both; null where one is constant (corr() would raise)."""
    x, y = F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")
    both = lambda v: F.when(x.isNotNull() & y.isNotNull(), v)
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(both(x)) * F.stddev_pop(both(y)), F.lit(0.0)))


def pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) over rows complete in all columns; constants give null. One aggregate for all pairs."""
    pairs = list(combinations(columns, 2))
    wide = df.dropna(subset=columns).agg(*[correlation(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(rows))


def spearman_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    full = df.dropna(subset=columns).select(columns)
    for c in columns:
        full = full.join(average_ranks(full, c).select(F.col("value").alias(c), F.col("rank").alias(f"_{c}")), c)
    return pearson_pairs(full.select(*[F.col(f"_{c}").alias(c) for c in columns]), columns)


def strong_pairs(pairs: DataFrame, least: float = 0.5, most: int = 10) -> DataFrame:
    strength = F.when(F.abs("r") >= 0.7, "strong").when(F.abs("r") >= 0.5, "moderate").when(F.abs("r") >= 0.3, "weak").otherwise("negligible")
    return pairs.where(F.abs("r") > least).withColumn("strength", strength).orderBy(F.desc(F.abs("r")), "a", "b").limit(most)


def linear_trend(df: DataFrame, y: str, x: str, group: str | None = None) -> DataFrame:
    """slope, intercept, r2, n, direction and strength of y over x, per group."""
    g = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(*([group] if group else []))
    out = g.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"))
    return out.withColumns({"direction": F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("flat"), "strength": F.when(F.col("r2") > 0.49, "strong").when(F.col("r2") > 0.09, "moderate").otherwise("weak")})


def growth(df: DataFrame, value: str, time: str) -> DataFrame:
    """First and last value by time, total growth in percent and compound growth per step."""
    s = df.where(F.col(value).isNotNull()).agg(F.min_by(value, time).alias("first"), F.max_by(value, time).alias("last"), F.count("*").alias("n"))
    total = 100 * F.try_divide(F.col("last") - F.col("first"), F.abs("first"))
    cagr = F.when((F.col("first") > 0) & (F.col("last") > 0) & (F.col("n") > 1), 100 * (F.pow(F.col("last") / F.col("first"), F.try_divide(F.lit(1.0), (F.col("n") - 1).cast("double"))) - 1))
    return s.withColumns({"total_growth": total, "compound_growth": cagr})


def monthly(df: DataFrame, time: str, value: str, f=F.avg) -> DataFrame:
    return df.groupBy(F.date_trunc("month", F.col(time).cast("timestamp")).cast("date").alias("month")).agg(f(value).alias("value"))


def gap_filled(months: DataFrame) -> DataFrame:
    """All months from the first to the last; months without rows have a null value."""
    spine = months.agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a is not null").select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    return spine.join(months, "month", "left")


def autocorrelation(series: DataFrame, order: str, value: str, most: int = 12) -> DataFrame:
    """(lag, r) for lags up to most. The series is an aggregate by period, so one task holds one row a period."""
    w = Window.orderBy(order)
    lags = range(1, most + 1)
    x = series.select(F.col(value).alias("x"), *[F.lag(value, k).over(w).alias(f"_{k}") for k in lags])
    wide = x.agg(*[correlation("x", f"_{k}").alias(f"_{k}") for k in lags])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"_{k}").alias("r")) for k in lags])))


def month_changes(months: DataFrame) -> DataFrame:
    """Growth against the month before in percent, and the deviation of the last three months (null until there are three)."""
    w = Window.orderBy("month")
    three = w.rowsBetween(-2, 0)
    return months.select("month", "value", (100 * (F.try_divide(F.col("value"), F.lag("value").over(w)) - 1)).alias("growth"), F.when(F.count("value").over(three) == 3, F.stddev_samp("value").over(three)).alias("volatility"))


def seasonal_means(months: DataFrame) -> DataFrame:
    return months.groupBy(F.month("month").cast("long").alias("month_of_year")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def group_moments(df: DataFrame, value: str, group: str) -> DataFrame:
    return df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count(value).cast("double").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))


def t_test(df: DataFrame, value: str, group: str) -> DataFrame:
    """Student's t of equal variances between the two groups, in order of their names, and the effect size."""
    m = group_moments(df, value, group).agg(F.min_by(F.struct("n", "m", "v"), "g").alias("a"), F.max_by(F.struct("n", "m", "v"), "g").alias("b"))
    pooled = ((F.col("a.n") - 1) * F.col("a.v") + (F.col("b.n") - 1) * F.col("b.v")) / (F.col("a.n") + F.col("b.n") - 2)
    t = F.try_divide(F.col("a.m") - F.col("b.m"), F.sqrt(pooled * (1 / F.col("a.n") + 1 / F.col("b.n"))))
    return m.select(t.alias("t"), (F.col("a.n") + F.col("b.n") - 2).alias("df"), F.try_divide(F.abs(F.col("a.m") - F.col("b.m")), F.sqrt((F.col("a.v") + F.col("b.v")) / 2)).alias("effect_size"))


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    m = group_moments(df, value, group)
    s = m.agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"))
    between = F.col("q") - F.col("n") * F.col("mean") * F.col("mean")
    return s.select(F.try_divide(between / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))).alias("f"), (F.col("k") - 1).cast("double").alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"))


def rank_sums(df: DataFrame, value: str, group: str) -> tuple[DataFrame, DataFrame]:
    """(g, n, rank_sum) per group, and one row (n, ties) of all; ties is the sum of t^3 - t."""
    x = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(value).alias("value"), F.col(group).alias("g")).agg(F.count("*").alias("c"))
    all_n = x.groupBy("value").agg(F.sum("c").alias("n"))
    r = ranked.before(all_n, ["value"], F.col("n"), "_below").withColumn("rank", F.col("_below") + (F.col("n") + 1) / 2)
    sums = x.join(r.select("value", "rank"), "value").groupBy("g").agg(F.sum("c").cast("double").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("rank_sum"))
    cube = F.col("n").cast("double")
    return sums, all_n.agg(F.sum("n").cast("double").alias("n"), F.sum(cube * cube * cube - cube).alias("ties"))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    sums, total = rank_sums(df, value, group)
    s = sums.agg(F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("q"), F.count("*").alias("k")).crossJoin(total)
    h = 12 / (F.col("n") * (F.col("n") + 1)) * F.col("q") - 3 * (F.col("n") + 1)
    untied = 1 - F.try_divide(F.col("ties"), F.pow("n", F.lit(3)) - F.col("n"))  # 0 where all values tie: no statistic
    return s.select(F.try_divide(h, untied).alias("h"), (F.col("k") - 1).cast("double").alias("df"))


def mann_whitney(df: DataFrame, value: str, group: str) -> DataFrame:
    """U of the first group by name, and z corrected for ties and continuity."""
    sums, total = rank_sums(df, value, group)
    s = sums.agg(F.min_by(F.struct("n", "rank_sum"), "g").alias("a"), F.max_by(F.struct("n", "rank_sum"), "g").alias("b")).crossJoin(total)
    n1, n2, n = F.col("a.n"), F.col("b.n"), F.col("n")
    u = F.col("a.rank_sum") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return s.select(u.alias("u"), F.try_divide(F.greatest(F.lit(0.0), F.abs(u - n1 * n2 / 2) - 0.5), sd).alias("z"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square of independence (with Yates' correction for a 2 x 2 table), degrees of freedom, Cramer's V. Cells are counted first."""
    c = contingency(df, a, b)
    rows, cols = c.groupBy(a).agg(F.sum("n").alias("ra")), c.groupBy(b).agg(F.sum("n").alias("rb"))
    t = c.agg(F.sum("n").alias("t"), F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"))
    grid = rows.crossJoin(cols).join(c, [a, b], "left").crossJoin(F.broadcast(t))  # one row a cell
    e = F.col("ra") * F.col("rb") / F.col("t")
    gap = F.abs(F.coalesce("n", F.lit(0)) - e)
    gap = F.when((F.col("ka") == 2) & (F.col("kb") == 2), gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    s = grid.agg(F.sum(gap * gap / e).alias("chi2"), F.first((F.col("ka") - 1) * (F.col("kb") - 1)).cast("double").alias("df"), F.first("t").alias("t"), F.first(F.least("ka", "kb") - 1).alias("m"))
    return s.select("chi2", "df", F.sqrt(F.try_divide(F.col("chi2"), (F.col("t") * F.col("m")).cast("double"))).alias("cramers_v"))


def jarque_bera(df: DataFrame, c: str) -> DataFrame:
    s = df.agg(F.count(c).alias("n"), F.skewness(c).alias("s"), F.kurtosis(c).alias("k"))
    jb = F.col("n") / 6 * (F.col("s") * F.col("s") + F.col("k") * F.col("k") / 4)
    return s.select(jb.alias("jb"), F.exp(-jb / 2).alias("p"))


def ks_exponential(df: DataFrame, c: str) -> DataFrame:
    """(d, n): distance between the values' distribution and the exponential one of their mean; no distance where a value is negative."""
    m = df.agg(F.avg(c).alias("m"), F.count(c).cast("double").alias("t"), F.min(c).alias("least"))
    v = average_ranks(df, c).select("value", (F.col("rank") - (F.col("n") + 1) / 2).alias("below"), "n").crossJoin(F.broadcast(m))
    v = v.withColumn("f", F.when(F.col("least") >= 0, 1 - F.exp(-F.try_divide(F.col("value"), F.col("m")))))
    return distance(v)


def distance(v: DataFrame) -> DataFrame:
    """(d, n): the largest gap between the share of values up to value (below and n of t) and the distribution function f."""
    gap = F.greatest((F.col("below") + F.col("n")) / F.col("t") - F.col("f"), F.col("f") - F.col("below") / F.col("t"))
    return v.agg(F.max(F.when(F.col("f").isNotNull(), gap)).alias("d"), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"))


def ks_normal(df: DataFrame, c: str) -> DataFrame:
    """(d, n): distance to the normal distribution with the values' mean and deviation. Values are counted first; SQL has no function for that distribution."""
    m = df.agg(F.avg(c).alias("m"), F.stddev_samp(c).alias("s"), F.count(c).cast("double").alias("t"))
    v = average_ranks(df, c).select("value", (F.col("rank") - (F.col("n") + 1) / 2).alias("below"), "n").crossJoin(F.broadcast(m))

    @F.pandas_udf("double")
    def phi(z: pd.Series) -> pd.Series:
        return pd.Series(pvalues.normal_cdf(z.to_numpy(float, na_value=math.nan))).mask(z.isna().to_numpy())

    return distance(v.withColumn("f", phi(F.try_divide(F.col("value") - F.col("m"), F.col("s")))))


def gini(df: DataFrame, group: str, value: str) -> DataFrame:
    """Gini index of group sums, their coefficient of variation and largest over smallest; one row a group is ranked."""
    s = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group).agg(F.sum(value).alias("x"))
    s = ranked.before(s, ["x", group], F.lit(1), "_i").withColumn("i", F.col("_i") + 1)
    n, total = F.count("*").cast("double"), F.sum("x")
    g = F.when((n > 1) & (total != 0), 2 * F.sum(F.col("i") * F.col("x")) / F.nullif(n * total, F.lit(0.0)) - (n + 1) / n).otherwise(0.0)
    out = s.agg(g.alias("gini"), F.try_divide(F.stddev_samp("x"), F.avg("x")).alias("cv"), F.when(F.min("x") > 0, F.max("x") / F.nullif(F.min("x"), F.lit(0.0))).otherwise(F.lit(float("inf"))).alias("ratio"))
    return out.withColumn("level", F.when(F.col("gini") > 0.4, "high").when(F.col("gini") > 0.25, "medium").otherwise("low"))


def entity_scores(df: DataFrame, entity: str, metrics: list[str]) -> DataFrame:
    """(entity, score): the mean over metrics of (entity mean - least value) / (largest - least value)."""
    b = df.agg(*[F.min(m).alias(f"_lo_{m}") for m in metrics], *[F.max(m).alias(f"_hi_{m}") for m in metrics])
    e = df.groupBy(entity).agg(*[F.avg(m).alias(m) for m in metrics]).crossJoin(F.broadcast(b))  # one row
    score = sum((F.try_divide(F.col(m) - F.col(f"_lo_{m}"), F.col(f"_hi_{m}") - F.col(f"_lo_{m}")) for m in metrics), F.lit(0.0)) / len(metrics)
    return e.select(entity, score.alias("score"))


def top_performers(df: DataFrame, entity: str, metrics: list[str], most: int = 10) -> DataFrame:
    """The entities with the highest scores, ties by name."""
    return entity_scores(df, entity, metrics).orderBy(F.desc("score"), entity).limit(most)


def score_statistics(df: DataFrame, entity: str, metrics: list[str]) -> DataFrame:
    """One row (entities, highest, lowest, mean, std) of the scores of all entities."""
    return entity_scores(df, entity, metrics).agg(F.count("*").alias("entities"), F.max("score").alias("highest"), F.min("score").alias("lowest"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"))


def regional(df: DataFrame, region: str, value: str) -> DataFrame:
    g = df.where(F.col(region).isNotNull() & F.col(value).isNotNull()).groupBy(region)
    out = g.agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count("*").alias("n"))
    return out.join(group_medians(df, [region], value, "median"), region)


def top_and_bottom(df: DataFrame, key: str, value: str, most: int = 5) -> DataFrame:
    top = df.orderBy(F.desc(value), key).limit(most).select(key, value, F.lit("top").alias("side"))
    return top.unionByName(df.orderBy(value, key).limit(most).select(key, value, F.lit("bottom").alias("side")))


def mode_of(df: DataFrame, c: str) -> DataFrame:
    """(mode, n): the most frequent value of a column, of equals the smallest. Values are counted first."""
    n = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("mode")).agg(F.count("*").alias("n"))
    return n.agg(F.min(F.struct((-F.col("n")).alias("n"), "mode")).alias("m")).select("m.mode", (-F.col("m.n")).alias("n"))


def distribution(df: DataFrame, c: str) -> DataFrame:
    from ..functions.scalars import sample_kurtosis, sample_skewness

    x = F.col(c).cast("double")
    low, mid, high = (F.lit(v).cast("double") for v in percentiles(df, [c], [0.25, 0.5, 0.75])[c])
    s = df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.var_samp(x).alias("variance"), sample_skewness(x).alias("skewness"), sample_kurtosis(x).alias("kurtosis"), (F.max(x) - F.min(x)).alias("range"))
    s = s.withColumns({"median": mid, "iqr": high - low})
    size = F.abs("skewness")
    return s.withColumn("skew_label", F.when(size < 0.5, "symmetric").when(size < 1, "moderate").otherwise("high")).withColumn("skew_direction", F.when(F.col("skewness") > 0, "right").otherwise("left"))
