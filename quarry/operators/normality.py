"""Tests of normality, and the tests that they choose: Shapiro-Wilk on bounded samples of groups, Kolmogorov-Smirnov beyond."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import pvalues
from . import significance, stats

#: Values of a group that the test of Shapiro and Wilk looks at; its p-value is known up to that size.
MOST = 5000


def hash_sample(df: DataFrame, groups: list[str], key: list[str], most: int = MOST, seed: int = 42, salts: int = 32) -> DataFrame:
    """Of each group the `most` rows with the least MD5 of seed and key, all of a smaller group. A sampling operator: the bound is its purpose.

    The key names a row; rows with one key stand or fall by the order of their other columns. Rows are counted by group and size of their hash (in bits) first,
    so of a larger group only about twice `most` rows are sorted; the groups' bounds, one row in `most` rows at most, are broadcast. Rows that share one key
    pass that bound together: each of `salts` parts of a group is cut before the whole.
    """
    h = F.md5(F.concat_ws("\\0", F.lit(str(seed)), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in key]).cast("binary"))
    rest = [F.col(f"`{c}`") for c in df.columns]
    rows = df.withColumn("_h", h).withColumn("_bits", F.length(F.bin(F.conv(F.substring("_h", 1, 15), 16, 10).cast("long"))))
    own = [f"_g{i}" for i in range(len(groups))]
    sizes = rows.groupBy(*[F.col(f"`{g}`").alias(o) for g, o in zip(groups, own, strict=True)], "_bits").agg(F.count("*").alias("_n"))
    until = F.sum("_n").over(Window.partitionBy(*own).orderBy("_bits"))  # at most 60 rows a group
    bounds = sizes.withColumn("_until", until).where(F.col("_until") >= most).groupBy(*own).agg(F.min("_bits").alias("_most_bits"))
    same = [F.col(f"`{g}`").eqNullSafe(F.col(o)) for g, o in zip(groups, own, strict=True)] or [F.lit(True)]
    rows = rows.join(F.broadcast(bounds), same, "left").where(F.col("_most_bits").isNull() | (F.col("_bits") <= F.col("_most_bits")))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*rest), F.lit(salts)))
    for by in (["_salt"], []):
        rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*groups, *by).orderBy("_h", *rest))).where(F.col("_place") <= most)
    return rows.select(rest)


def in_large_groups(df: DataFrame, group: str, least: int) -> DataFrame:
    """The rows in groups of at least `least` rows (nulls in none). Nothing is joined if that is all of them.

    The groups that hold a thousandth of the rows or more, at most a thousand, are broadcast; the rows of the others are joined by group.
    """
    full = df.where(F.col(f"`{group}`").isNotNull())
    sizes = full.groupBy(F.col(f"`{group}`").alias("_g")).agg(F.count("*").alias("_n"))
    small, rows = sizes.agg(F.count(F.when(F.col("_n") < least, 1)), F.sum("_n")).first()  # one row
    if not small:
        return full
    same, large = F.col(f"`{group}`") == F.col("_g"), sizes.where(F.col("_n") >= least)
    hot = F.broadcast(large.where(F.col("_n") >= rows / 1000))
    return full.join(hot, same, "left_semi").unionByName(full.join(hot, same, "left_anti").join(large, same, "left_semi"))


def shapiro(df: DataFrame, value: str, key: list[str], group: str | None = None, alpha: float = DEFAULTS.alpha, most: int = MOST) -> DataFrame:
    """(group, n, w, p_value, normal) of each group's values, null groups and values left out; n of all, the test from at most `most` of them.

    No statistic below three values or without spread.
    """
    g = F.col(f"`{group}`") if group else F.lit("all")
    rows = df.select(g.alias("group"), F.col(f"`{value}`").cast("double").alias("x"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(key)]).where("group is not null and x is not null")
    kind = dict(rows.dtypes)["group"]
    n = rows.groupBy("group").agg(F.count("*").alias("n"))

    def test(names: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        found = pvalues.shapiro_wilk(sample["x"].to_numpy())
        return pd.DataFrame({"group": [names[0]], "w": [found and found[0]], "p_value": [found and found[1]]}).astype({"w": "float64", "p_value": "float64"})

    sample = hash_sample(rows, ["group"], [f"_k{i}" for i in range(len(key))], most)
    found = sample.select("group", "x").groupBy("group").applyInPandas(test, f"group {kind}, w double, p_value double")  # at most `most` rows each
    nothing = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return n.join(found, "group").select("group", "n", nothing("w"), nothing("p_value")).withColumn("normal", F.col("p_value") > alpha)


def compare_groups(df: DataFrame, value: str, group: str, key: list[str], alpha: float = DEFAULTS.alpha, least: int = 3) -> DataFrame:
    """One row (groups, normal, test, statistic, p_value, significant, effect_size): the test that suits the groups of at least `least` values.

    Two groups that both pass for normal: Student's t; else Mann and Whitney. More groups, all normal: analysis of variance; else Kruskal and Wallis. No
    row for fewer than two groups. Groups that are too small take no part.
    """
    full = in_large_groups(df.where(F.col(f"`{value}`").isNotNull()), group, least)
    gate = shapiro(full, value, key, group, alpha).agg(F.count("*").alias("k"), F.every(F.coalesce("normal", F.lit(False))).alias("normal")).first()  # one row
    tests = {
        (True, True): ("Independent t-test", significance.t_test, "t"), (True, False): ("Mann-Whitney U test", significance.mann_whitney, "u"),
        (False, True): ("One-way ANOVA", significance.anova, "f"), (False, False): ("Kruskal-Wallis test", significance.kruskal, "h"),
    }
    name, test, statistic = tests[gate["k"] == 2, bool(gate["normal"])]
    out = test(full, value, group).select(F.lit(gate["k"]).cast("long").alias("groups"), F.lit(bool(gate["normal"])).alias("normal"), F.lit(name).alias("test"), F.col(statistic).alias("statistic"), "p_value", "significant")
    effect = stats.t_test(full, value, group).select(F.col("effect_size") if gate["k"] == 2 else F.lit(None).cast("double").alias("effect_size"))
    return out.crossJoin(effect).where(F.col("groups") >= 2)  # one row each


def normality_tests(df: DataFrame, columns: list[str], key: list[str], alpha: float = DEFAULTS.alpha, most: int = MOST) -> DataFrame:
    """(column, test, n, statistic, p_value, normal): Shapiro-Wilk up to `most` values, Kolmogorov-Smirnov for more. Columns of fewer than four values are left out."""
    counts = df.agg(*[F.count(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns)]).first()  # one row
    out = None
    for i, c in enumerate(columns):
        if counts[i] <= 3:
            continue
        if counts[i] <= most:
            one = shapiro(df, c, key, None, alpha, most).select(F.lit(c).alias("column"), F.lit("Shapiro-Wilk").alias("test"), "n", F.col("w").alias("statistic"), "p_value", "normal")
        else:
            one = significance.ks_normal(df, c, alpha).select(F.lit(c).alias("column"), F.lit("Kolmogorov-Smirnov").alias("test"), F.col("n").cast("long").alias("n"), F.col("d").alias("statistic"), "p_value", "normal")
        out = one if out is None else out.unionByName(one)
    return df.sparkSession.createDataFrame([], "column string, test string, n long, statistic double, p_value double, normal boolean") if out is None else out


def distribution_tests(df: DataFrame, c: str, key: list[str], alpha: float = DEFAULTS.alpha, most: int = MOST) -> DataFrame:
    """One row (p_normal, is_normal, p_exponential, is_exponential): Shapiro-Wilk up to `most` values and Jarque-Bera beyond; Kolmogorov-Smirnov
    against the exponential distribution, if no value is negative."""
    n = df.agg(F.count(f"`{c}`")).first()[0]
    normal: Column = F.col("p_value") if n <= most else F.col("p")
    one = shapiro(df, c, key, None, alpha, most) if n <= most else stats.jarque_bera(df, c)
    exponential = significance.ks_exponential(df, c, alpha).select(F.col("p_value").alias("p_exponential"), F.col("exponential").alias("is_exponential"))
    return one.select(normal.alias("p_normal"), (normal > alpha).alias("is_normal")).crossJoin(exponential)  # one row each
