"""Cleaning: imputation, duplicates, outliers, sparse columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from .profile import value_counts
from .quantiles import group_medians, percentile_table, percentiles


def drop_sparse(df: DataFrame, most: float = DEFAULTS.drop_null_share) -> DataFrame:
    """Drops columns whose share of nulls exceeds most (one aggregate decides)."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if (shares[c] or 0) > most])


def impute_median(df: DataFrame, c: str) -> DataFrame:
    (value,) = percentiles(df, [c], [0.5])[c]
    return df if value is None else df.withColumn(c, F.coalesce(F.col(c).cast("double"), F.lit(float(value))))


def impute_group_median(df: DataFrame, c: str, group: str) -> DataFrame:
    """Fills nulls with the median of their group; rows of a null group, or of a group of nulls, stay null.

    Medians come from running counts and are joined, so a large group is in no single task.
    """
    m = group_medians(df, [group], c, "_m")
    return df.join(m, group, "left").withColumn(c, F.coalesce(F.col(c).cast("double"), "_m")).drop("_m").select(df.columns)


def impute_mode(df: DataFrame, c: str) -> DataFrame:
    """Fills nulls with the most frequent value, of equals the smallest."""
    top = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).first()
    return df if top is None else df.withColumn(c, F.coalesce(F.col(c), F.lit(top[0])))


def impute(df: DataFrame, medians: list[str] = (), modes: list[str] = (), placeholders: list[str] = (), groups: dict[str, str] | None = None, text: str = "MISSING") -> DataFrame:
    """Fills nulls of many columns at once: with medians, with modes (ties: the smallest value), with a placeholder, or with the median of their group and
    then of the column. A column without a value stays as it is. Two steps over the table for all medians and modes, and a join for each grouped column.
    """
    groups, kinds = groups or {}, dict(df.dtypes)
    middle = {c: v[0] for c, v in percentiles(df, [*medians, *groups], [0.5]).items()} if medians or groups else {}
    top = {}
    if modes:
        first = F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"]
        top = {r["column"]: r["value"] for r in value_counts(df, list(modes)).groupBy("column").agg(first.alias("value")).collect()}  # one row a column
    out = df
    for c, group in groups.items():
        name = f"_median_of_{c}"
        out = out.join(group_medians(df, [group], c, name).withColumnRenamed(group, f"_group_of_{c}"), F.col(f"`{group}`") == F.col(f"`_group_of_{c}`"), "left")
    new = {c: F.coalesce(F.col(f"`{c}`").cast("double"), *([F.col(f"`_median_of_{c}`")] if c in groups else []), F.lit(middle[c]).cast("double")) for c in [*medians, *groups]}
    new |= {c: F.coalesce(F.col(f"`{c}`"), F.lit(top[c]).cast(kinds[c])) for c in modes if c in top}
    new |= {c: F.coalesce(F.col(f"`{c}`"), F.lit(text)) for c in placeholders}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns])


def impute_placeholder(df: DataFrame, c: str, text: str = "MISSING") -> DataFrame:
    return df.withColumn(c, F.coalesce(F.col(c), F.lit(text)))


def dedupe(df: DataFrame, columns: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Equal rows once; with order, the first by it (nulls are equal)."""
    if order is None:
        return df.dropDuplicates(columns)
    keys = columns or [c for c in df.columns if c != order]
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(keys).agg(F.min_by(F.struct(*others), F.col(order)).alias("_f")).select(*keys, "_f.*").select(df.columns)


def iqr_bounds(df: DataFrame, columns: list[str], k: float = DEFAULTS.iqr_multiplier) -> DataFrame:
    q = percentile_table(df, columns, {"q25": 0.25, "q75": 0.75})
    return q.withColumns({"lower": F.col("q25") - k * (F.col("q75") - F.col("q25")), "upper": F.col("q75") + k * (F.col("q75") - F.col("q25"))})


def bounds_of(df: DataFrame, columns: list[str], k: float = DEFAULTS.iqr_multiplier) -> dict[str, tuple[float, float]]:
    return {r["column"]: (r["lower"], r["upper"]) for r in iqr_bounds(df, columns, k).collect() if r["lower"] is not None}  # one row a column


def outside(c: str, bounds: tuple[float, float]) -> Column:
    return F.coalesce((F.col(c) < bounds[0]) | (F.col(c) > bounds[1]), F.lit(False))


def flag_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    b = bounds_of(df, columns)
    return df.withColumns({f"{c}_outlier_flag": outside(c, b[c]) for c in b})


def remove_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    b = bounds_of(df, columns)
    for c in b:
        df = df.where(~outside(c, b[c]))
    return df


def outlier_policy(df: DataFrame, columns: list[str], most: float = DEFAULTS.outlier_remove_share) -> DataFrame:
    """Removes rows outside the bounds of columns where they are at most this share of rows; flags the other columns."""
    b = bounds_of(df, columns)
    counts = df.agg(F.count("*").alias("rows"), *[F.count(F.when(outside(c, b[c]), 1)).alias(c) for c in b]).first()
    few = [c for c in b if 0 < counts[c] <= most * counts["rows"]]
    out = df.withColumns({f"{c}_outlier_flag": outside(c, b[c]) for c in b if counts[c] > most * counts["rows"]})
    for c in few:
        out = out.where(~outside(c, b[c]))
    return out


def _one(df: DataFrame, c: str, other: DataFrame) -> DataFrame:
    return df.select(F.col(c).cast("double").alias("x")).where("x is not null").crossJoin(F.broadcast(other))  # other has one row


def zscore_outliers(df: DataFrame, c: str, z: float = DEFAULTS.z) -> DataFrame:
    m = df.agg(F.avg(c).alias("m"), F.stddev_pop(c).alias("s"))
    return _one(df, c, m).agg(F.count(F.when(F.abs(F.try_divide(F.col("x") - F.col("m"), F.col("s"))) > z, 1)).alias("outliers"), F.count("*").alias("rows"))


def modified_zscore_outliers(df: DataFrame, c: str, z: float = DEFAULTS.modified_z) -> DataFrame:
    (m,) = percentiles(df, [c], [0.5])[c]
    gaps = df.select(F.abs(F.col(c).cast("double") - F.lit(m).cast("double")).alias("gap"), F.col(c).cast("double").alias("x")).where("x is not null")
    (mad,) = percentiles(gaps, ["gap"], [0.5])["gap"]
    score = F.try_divide(0.6745 * F.col("gap"), F.lit(mad).cast("double"))
    return gaps.agg(F.count(F.when(score > z, 1)).alias("outliers")).withColumn("mad", F.lit(mad).cast("double"))


def outlier_impact(df: DataFrame, c: str) -> DataFrame:
    """Mean, median and deviation with and without values outside the bounds, how many those are, and of them the value farthest from the
    median (farthest; of two as far the larger; null if there is none)."""
    low, mid, high = percentiles(df, [c], [0.25, 0.5, 0.75])[c]
    x = df.select(F.col(c).cast("double").alias("x")).where("x is not null")
    bound = lambda v: F.lit(v).cast("double")
    k = DEFAULTS.iqr_multiplier
    inside = (F.col("x") >= bound(None if mid is None else low - k * (high - low))) & (F.col("x") <= bound(None if mid is None else high + k * (high - low)))
    kept, far = F.when(inside, F.col("x")), F.when(~inside, F.struct(F.abs(F.col("x") - bound(mid)), "x"))
    (mid_inside,) = percentiles(x.where(inside), ["x"], [0.5])["x"]
    out = x.agg(F.avg("x").alias("mean_all"), F.avg(kept).alias("mean_inside"), F.stddev_samp("x").alias("std_all"), F.stddev_samp(kept).alias("std_inside"), (F.count("*") - F.count(kept)).alias("outliers"), F.max(far)["x"].alias("farthest"))
    return out.withColumns({"median_all": bound(mid), "median_inside": bound(mid_inside)})


def outlier_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    b = bounds_of(df, columns)
    total = sum((F.count(F.when(outside(c, b[c]), 1)) for c in b), F.lit(0))
    return df.agg(total.alias("outliers"), F.try_divide(total.cast("double"), (F.count("*") * len(columns)).cast("double")).alias("share"))


def group_rank(df: DataFrame, group: str, c: str, name: str = "rank", of: DataFrame | None = None) -> DataFrame:
    """Rank in the group, largest first, equals share their mean rank; null has none. of: a table with the same rows from which values are counted.

    Distinct values are counted first, so the window holds distinct values rather than rows.
    """
    v = (df if of is None else of).where(F.col(c).isNotNull() & F.col(group).isNotNull()).groupBy(group, c).agg(F.count("*").alias("_n"))
    above = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy(F.desc(c)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    v = v.select(group, c, (above + (F.col("_n") + 1) / 2).alias(name))
    return df.join(v, [group, c], "left").select(*df.columns, name)
