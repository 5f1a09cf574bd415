"""Summaries of tables for reports: one aggregate a table, a few rows out."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import parse_number, parse_time
from .profile import by_column, metric_columns, missingness, numeric_columns, value_counts
from .quantiles import group_medians, percentile_table


def describe(df: DataFrame, columns: list[str], places: int = 2) -> DataFrame:
    """(column, count, mean, std, min, q25, median, q75, max), rounded."""
    d = lambda f: lambda c: F.round(f(c.cast("double")), places)
    out = by_column(df, columns, {"count": F.count, "mean": d(F.avg), "std": d(F.stddev_samp), "min": d(F.min), "max": d(F.max)})
    out = out.join(F.broadcast(percentile_table(df, columns, {"q25": 0.25, "median": 0.5, "q75": 0.75})), "column")  # one row a column
    return out.select("column", "count", "mean", "std", "min", *[F.round(q, places).alias(q) for q in ("q25", "median", "q75")], "max")


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns by kind, missing cells and their share, complete rows."""
    numeric, kinds = numeric_columns(df), dict(df.dtypes)
    times = [c for c, k in kinds.items() if k == "date" or k.startswith("timestamp")]
    nulls = sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    out = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(nulls), F.lit(0)).alias("missing_cells"), F.count(F.when(nulls == 0, 1)).alias("complete_rows"))
    count = lambda x: F.lit(x).cast("long")
    return out.withColumns({"columns": count(len(df.columns)), "numeric_columns": count(len(numeric)), "time_columns": count(len(times)), "other_columns": count(len(df.columns) - len(numeric) - len(times)), "missing_share": F.try_divide(F.col("missing_cells").cast("double"), (F.col("rows") * len(df.columns)).cast("double"))})


def top_values(df: DataFrame, columns: list[str], most: int = 5) -> DataFrame:
    """(column, place, value, n): the most frequent values of each column, ties by value."""
    w = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return value_counts(df, columns).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most).select("column", "place", "value", "n")


def date_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, first, last, days, missing) of date columns."""
    out = by_column(df, columns, {"first": lambda c: F.min(c.cast("date")), "last": lambda c: F.max(c.cast("date")), "missing": lambda c: F.count(F.when(c.isNull(), 1))})
    return out.withColumn("days", F.datediff("last", "first").cast("long"))


def region_completeness(df: DataFrame, region: str, metrics: list[str]) -> DataFrame:
    """Per region: records, completeness in percent over the metrics, and total, mean and median of each."""
    filled = sum((F.count(m) for m in metrics), F.lit(0))
    parts = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("total", F.sum), ("mean", F.avg))]
    out = df.where(F.col(region).isNotNull()).groupBy(region).agg(F.count("*").alias("records"), (100 * filled / (F.count("*") * len(metrics))).alias("completeness"), *parts)
    for m in metrics:
        out = out.join(group_medians(df, [region], m, f"{m}_median"), region, "left")
    return out


def analysis_quality(df: DataFrame) -> DataFrame:
    """One row: completeness, sample size, variability and type diversity of 0 to 100, and their weighted mean of 0 to 1."""
    numeric = numeric_columns(df)
    varied = [F.coalesce((F.min(c) < F.max(c)).cast("int"), F.lit(0)) for c in numeric]
    m = df.agg(F.count("*").alias("rows"), sum((F.count(f"`{c}`") for c in df.columns), F.lit(0)).alias("filled"), sum(varied, F.lit(0)).alias("varied"))
    rows = F.col("rows")
    scores = {
        "completeness_score": F.coalesce(100 * F.try_divide(F.col("filled").cast("double"), (rows * len(df.columns)).cast("double")), F.lit(0.0)),
        "sample_size_score": F.when(rows >= 1000, 100.0).when(rows >= 100, 80.0).when(rows >= 30, 60.0).otherwise(30.0),
        "variability_score": 100.0 * F.col("varied") / len(numeric) if numeric else F.lit(50.0),
        "data_type_diversity_score": F.lit(100.0 * min(1.0, len({k for _, k in df.dtypes}) / 3)),
    }
    weights = dict(zip(scores, (0.3, 0.25, 0.25, 0.2), strict=True))
    overall = sum((scores[k] * w for k, w in weights.items()), F.lit(0.0)) / 100
    return m.select(*[v.alias(k) for k, v in scores.items()], F.round(overall, 3).alias("overall_score"))


def cleaning_flags(before: DataFrame, after: DataFrame, missing: float = 0.30, loss: float = 0.10) -> DataFrame:
    """(column, high_missing, zero_variance, row_loss): what a cleaned table is flagged for, a row a metric column."""
    rows = before.agg(F.count("*").alias("_before")).crossJoin(after.agg(F.count("*").alias("_after")))  # one row each
    share = missingness(after).select("column", "missing_share")
    spread = by_column(after, metric_columns(after), {"least": lambda c: F.min(c.cast("double")), "largest": lambda c: F.max(c.cast("double"))})
    out = spread.join(F.broadcast(share), "column").crossJoin(F.broadcast(rows))
    lost = F.try_divide((F.col("_before") - F.col("_after")).cast("double"), F.col("_before").cast("double"))
    return out.select("column", (F.col("missing_share") > missing).alias("high_missing"), F.coalesce(F.col("least") == F.col("largest"), F.lit(False)).alias("zero_variance"), F.coalesce(lost > loss, F.lit(False)).alias("row_loss"))


def by_grain(df: DataFrame, time: str, value: str, grain: str) -> DataFrame:
    """(period, total, mean, n, growth) by day, week, month, quarter or year; growth in percent against the period before."""
    out = df.where(F.col(time).isNotNull()).groupBy(F.date_trunc(grain, F.col(time).cast("timestamp")).cast("date").alias("period")).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.withColumn("growth", 100 * (F.try_divide(F.col("total"), F.lag("total").over(Window.orderBy("period"))) - 1))  # one row a period


def head_fingerprint(df: DataFrame, order: list[str], columns: list[str], most: int = 100) -> DataFrame:
    """MD5 of the first rows by order, columns as text, null as empty."""
    row = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    head = df.orderBy(*order).limit(most).select(F.struct(*order, row.alias("_row")).alias("x"))
    return head.agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["_row"]), "\n").cast("binary")).alias("md5"))


def schema_fingerprint(df: DataFrame) -> str:
    """MD5 of a table's column names and types, whatever the order of columns."""
    return hashlib.md5("\n".join(f"{c}:{k}" for c, k in sorted(df.dtypes)).encode(), usedforsecurity=False).hexdigest()


def sample_values(df: DataFrame, columns: list[str], most: int = 5) -> DataFrame:
    """(column, samples): the most frequent values of each column as text, ties by value; a column of nulls has none."""
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string").coalesce(1)
    top = top_values(df, columns, most).groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("samples"))  # at most `most` a column
    return every.join(top, "column", "left").select("column", F.coalesce("samples", F.expr("cast(array() as array<string>)")).alias("samples"))


def text_preview(df: DataFrame, order: list[str], most: int = 5) -> DataFrame:
    """The first rows by order, every column as text, null as NULL."""
    return df.orderBy(*order).limit(most).select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")).alias(c) for c in df.columns])


# Words of column names whose values become numbers if any of them is one.
NUMBER_NAMES = ["week", "day", "month", "year"]
# Words that a cast to boolean takes for true and false.
TRUTH = {"true": True, "false": False, "1": True, "0": False, "yes": True, "no": False, "y": True, "n": False, "t": True, "f": False, "1.0": True, "0.0": False}


def strings_to_numbers(df: DataFrame, least: float = 0.7) -> DataFrame:
    """String columns of which more than that share of all rows are numbers, as doubles; what is no number becomes null.

    Of a column whose name speaks of weeks, days, months or years one number is enough.
    """
    texts = [c for c, k in df.dtypes if k == "string"]
    if not texts:
        return df
    n = df.agg(F.count("*"), *[F.count(parse_number(F.col(f"`{c}`"))) for c in texts]).first()  # one row
    named = lambda c: any(w in c.lower() for w in NUMBER_NAMES)
    chosen = [c for i, c in enumerate(texts, 1) if n[i] > least * n[0] or n[i] and named(c)]
    return df.withColumns({c: parse_number(F.col(f"`{c}`")) for c in chosen})


def cast_to(c: str, kind: str) -> Column:
    """A column as numeric, float (double), integer (bigint; a number with a fraction is none), datetime, boolean (by TRUTH) or categorical; of any other kind, as text."""
    x, text = F.col(f"`{c}`"), F.col(f"`{c}`").cast("string")
    if kind in ("numeric", "float"):
        return parse_number(text)
    if kind == "integer":
        number = parse_number(text)
        return F.coalesce(F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("bigint")), F.when(number == F.floor(number), number.try_cast("bigint")))
    if kind == "datetime":
        return parse_time(text)
    if kind == "boolean":
        low = F.lower(F.trim(text))
        return F.when(low.isin([w for w, v in TRUTH.items() if v]), True).when(low.isin([w for w, v in TRUTH.items() if not v]), False)
    return x if kind == "categorical" else text


def safe_cast(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns cast by cast_to(); a value that does not fit becomes null. cast_report() tells what was lost, and which columns are absent."""
    return df.withColumns({c: cast_to(c, k) for c, k in kinds.items() if c in df.columns})


def cast_report(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(column, kind, status, lost): a row for each cast that was asked for; status is cast or missing, lost the values that became null. One aggregate."""
    there = [c for c in kinds if c in df.columns]
    lost = df.agg(F.lit(0), *[F.count(F.when(F.col(f"`{c}`").isNotNull() & cast_to(c, kinds[c]).isNull(), 1)) for c in there]).first()  # one row
    rows = [(c, k, "cast" if c in there else "missing", lost[1 + there.index(c)] if c in there else None) for c, k in kinds.items()]
    return df.sparkSession.createDataFrame(rows, "column string, kind string, status string, lost long")
