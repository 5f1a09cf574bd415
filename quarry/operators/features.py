"""Feature engineering: calendar parts, ratios, trends, groups, encodings, scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions.scalars import parse_time, safe_ratio
from . import ranked, series
from .profile import numeric_columns


def calendar(df: DataFrame, c: str) -> DataFrame:
    """Twelve calendar features of a time column; flags are 0 or 1."""
    t = F.col(c)
    day = t.cast("date")
    first_of = lambda unit: F.date_trunc(unit, t.cast("timestamp")).cast("date") == day
    quarter_end = (F.dayofmonth(F.date_add(day, 1)) == 1) & (F.pmod(F.month(t), F.lit(3)) == 0)
    parts = {"year": F.year(t), "month": F.month(t), "quarter": F.quarter(t), "day": F.dayofmonth(t), "dayofweek": F.weekday(t), "dayofyear": F.dayofyear(t), "weekofyear": F.weekofyear(t), "is_weekend": F.weekday(t) >= 5, "is_month_start": F.dayofmonth(t) == 1, "is_month_end": F.last_day(day) == day, "is_quarter_start": first_of("quarter"), "is_quarter_end": quarter_end}
    return df.withColumns({f"{c}_{k}": v.cast("long") if k in ("year", "month", "quarter", "day", "dayofweek", "dayofyear", "weekofyear") else v.cast("int").cast("long") for k, v in parts.items()})


def parsed_dates(df: DataFrame, least: float = 0.5) -> tuple[DataFrame, list[str]]:
    """Text columns named after dates, times, years or months of which more than that share of all rows are times, as timestamps; and all time columns.

    One aggregate decides for all columns; what is no time becomes null.
    """
    kinds = dict(df.dtypes)
    named = [c for c in df.columns if kinds[c] == "string" and any(w in c.lower() for w in ("date", "time", "year", "month"))]
    n = df.agg(F.count("*"), *[F.count(parse_time(F.col(f"`{c}`"))) for c in named]).first()  # one row
    chosen = [c for i, c in enumerate(named, 1) if n[i] > least * n[0]]
    times = [c for c in df.columns if c in chosen or kinds[c] == "date" or kinds[c].startswith("timestamp")]
    return df.withColumns({c: parse_time(F.col(f"`{c}`")) for c in chosen}), times


def per_capita(df: DataFrame, denominators: list[str]) -> DataFrame:
    """<number>_per_<denominator without underscores> for all numeric columns and denominators (see naming.columns_for), and <number>_per_1000 for
    populations. A denominator of 0 gives null."""
    out: dict[str, Column] = {}
    numbers = [c for c in numeric_columns(df) if not c.endswith(("_per_capita", "_normalized"))]
    for d in denominators:
        for c in [c for c in numbers if c != d]:
            out[f"{c}_per_{d.replace('_', '')}"] = safe_ratio(F.col(f"`{c}`"), F.col(f"`{d}`"))
            if "population" in d.lower():
                out[f"{c}_per_1000"] = safe_ratio(F.col(f"`{c}`"), F.col(f"`{d}`")) * 1000
    return df.withColumns(out)


def per_unit(df: DataFrame, metrics: list[str], unit: str, times: int = 1) -> DataFrame:
    return df.withColumns({f"{m}_per_{unit}": safe_ratio(F.col(m), F.col(unit)) * times for m in metrics})


def ratio_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    out = {}
    for a, b in pairs:
        out |= {f"{a}_{b}_ratio": safe_ratio(F.col(a), F.col(b)), f"{a}_pct_of_total": 100 * safe_ratio(F.col(a), F.col(a) + F.col(b))}
    return df.withColumns(out)


def interactions(df: DataFrame, columns: list[str], most: int = DEFAULTS.ratio_pairs) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]][:most]
    return df.withColumns({f"{a}_{b}_ratio": safe_ratio(F.col(a), F.col(b)) for a, b in pairs})


def trends(df: DataFrame, metrics: list[str], time: str, key: str, partition: list[str] | None = None, windows: tuple[int, ...] = DEFAULTS.windows) -> DataFrame:
    """Rolling means, lag, difference and percent change in time order (nulls last, ties by key), within each partition or over the whole table.

    The order of a whole table is cut into buckets with halos (see series), so no task holds it. Percent change fills gaps forward first; x / 0 is infinite.
    """
    if partition:
        order = Window.partitionBy(*partition).orderBy(F.col(time).asc_nulls_last(), key)
        whole, carry = None, lambda m: F.lit(None).cast("double")
    else:
        whole = series.Ordered(df, time, key, max([1, *[k - 1 for k in windows]]), metrics)
        order, carry = whole.window, whole.carry
    out: dict[str, Column] = {}
    for m in metrics:
        c, back = F.col(m).cast("double"), F.lag(F.col(m).cast("double")).over(order)
        out |= {f"{m}_rolling_{k}": F.avg(c).over(order.rowsBetween(-(k - 1), 0)) for k in windows}
        out |= {f"{m}_lag1": back, f"{m}_diff": c - back}
        filled = F.coalesce(F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), carry(m))
        before = F.coalesce(F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), carry(m))
        change = F.when(before != 0, (filled / F.nullif(before, F.lit(0.0)) - 1) * 100).when((before == 0) & (filled > 0), F.lit(float("inf"))).when((before == 0) & (filled < 0), F.lit(float("-inf")))
        out[f"{m}_pct_change"] = change
    return whole.finished(out) if whole else df.withColumns(out)


def group_stats(df: DataFrame, group: str, metrics: list[str], of: DataFrame | None = None) -> DataFrame:
    """Mean, sum, sample deviation and count of each group joined back to its rows; a null group has null statistics.

    of: a table with the same rows from which they are aggregated, where df is a long plan; so below.
    """
    stats = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "count": F.count}
    s = (df if of is None else of).where(F.col(group).isNotNull()).groupBy(group).agg(*[f(m).alias(f"{m}_by_{group}_{k}") for m in metrics for k, f in stats.items()])
    return df.join(s, group, "left")


def binary_encode(df: DataFrame, c: str, order: str, of: DataFrame | None = None) -> DataFrame:
    """Two values: the one seen first by order is 0, the other 1; null stays null."""
    first = (df if of is None else of).where(F.col(c).isNotNull()).agg(F.min_by(c, order)).first()[0]
    return df.withColumn(f"{c}_encoded", F.when(F.col(c).isNotNull(), (F.col(c) != F.lit(first)).cast("long")))


def one_hot(df: DataFrame, c: str, most: int = DEFAULTS.one_hot_most, of: DataFrame | None = None) -> DataFrame:
    """A 0/1 column for each value, and one for null. Refuses more than most values."""
    values = [r[0] for r in (df if of is None else of).where(F.col(c).isNotNull()).select(c).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{c} has more than {most} values")
    return df.withColumns({f"{c}_{v}": F.col(c).eqNullSafe(F.lit(v)).cast("long") for v in sorted(values)} | {f"{c}_nan": F.col(c).isNull().cast("long")})


def label_encode(df: DataFrame, c: str, of: DataFrame | None = None) -> DataFrame:
    """Codes of the sorted distinct values from 0; null stays null. Distinct values are ranked by buckets."""
    codes = (df if of is None else of).where(F.col(c).isNotNull()).select(c).distinct()
    codes = ranked.before(codes, [c], F.lit(1), "_code").select(c, F.col("_code").cast("long").alias(f"{c}_encoded"))
    return df.join(codes, c, "left").select(*df.columns, f"{c}_encoded")


def scaled(df: DataFrame, columns: list[str], of: DataFrame | None = None) -> DataFrame:
    """<c>_std (population deviation; 0 for a constant) and <c>_norm (0 to 1), from one aggregate."""
    s = (df if of is None else of).agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns]).first()
    out = {}
    for c in columns:
        if (m := s[c])["m"] is not None:
            x = F.col(c).cast("double")
            out[f"{c}_std"] = (x - m["m"]) / (m["s"] or 1.0)
            out[f"{c}_norm"] = (x - float(m["lo"])) / ((m["hi"] - m["lo"]) or 1.0)
    return df.withColumns(out)


def log_skewed(df: DataFrame, columns: list[str], skew: float = DEFAULTS.skew, of: DataFrame | None = None) -> DataFrame:
    """<c>_log = log1p of columns without negatives whose sample skewness exceeds skew in size."""
    from ..functions.scalars import sample_skewness

    s = (df if of is None else of).agg(*[F.struct(sample_skewness(F.col(c).cast("double")).alias("k"), F.min(c).alias("lo")).alias(c) for c in columns]).first()
    return df.withColumns({f"{c}_log": F.log1p(F.col(c).cast("double")) for c in columns if s[c]["k"] is not None and abs(s[c]["k"]) > skew and s[c]["lo"] >= 0})
