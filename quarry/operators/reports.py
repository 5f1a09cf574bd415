"""Tables for reports and reviews: summaries, previews, findings and advice, a row a column, test or finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Thresholds
from . import stats
from .profile import by_column, categorical_kpis, duplicate_rate, metric_columns, missingness, numeric_columns, value_counts
from .quantiles import percentile_table, percentiles
from .summary import top_values

# Priorities in their order, weights of effort, endings and parts of the names of derived columns.
PRIORITIES = ["critical", "high", "medium", "low"]
EFFORT = {"low": 1, "medium": 3, "high": 5}
DERIVED_ENDS = ["_encoded", "_std", "_norm", "_log"]
DERIVED_PARTS = ["_ratio", "_year", "_month", "_day"]


def share(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def summary_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, kind, count, missing_percent) of numeric and text columns, with mean, std, min, max or distinct_values and mode."""
    kinds, numeric = dict(df.dtypes), set(numeric_columns(df))
    columns = columns or df.columns
    d = lambda f: lambda c: f(c.cast("double"))
    base = {"count": F.count, "missing_percent": lambda c: 100 * share(F.count(F.when(c.isNull(), 1)), F.count(F.lit(1)))}
    moments = {"mean": d(F.avg), "std": d(F.stddev_samp), "min": d(F.min), "max": d(F.max)}
    numbers, texts = [c for c in columns if c in numeric], [c for c in columns if kinds[c] == "string"]
    names = ["column", "kind", *base, *moments, "distinct_values", "mode"]
    parts = []
    if numbers:
        parts.append(by_column(df, numbers, base | moments).withColumns({"kind": F.lit("numeric"), "distinct_values": F.lit(None).cast("long"), "mode": F.lit(None).cast("string")}))
    if texts:
        modes = categorical_kpis(df, texts).select("column", "distinct_values", "mode")
        parts.append(by_column(df, texts, base).join(modes, "column", "left").withColumns({"kind": F.lit("categorical"), **{m: F.lit(None).cast("double") for m in moments}}))
    if not parts:
        raise ValueError("no numeric or text column")
    out = parts[0].select(names)
    return out.unionByName(parts[1].select(names)) if len(parts) > 1 else out


def statistical_summary(df: DataFrame, least_complete: float = 90.0, most_duplicates: float = 0.05) -> DataFrame:
    """One row: completeness in percent, columns with nulls, complete rows, mean coefficient of variation and columns above 1, two flags."""
    counts = F.array(*[F.count(F.col(f"`{c}`")) for c in df.columns])
    full = sum((F.col(f"`{c}`").isNull().cast("int") for c in df.columns), F.lit(0)) == 0
    cvs = [F.try_divide(F.stddev_samp(f"`{c}`"), F.nullif(F.avg(f"`{c}`"), F.lit(0.0))) for c in numeric_columns(df)]
    m = df.agg(F.count("*").alias("rows"), counts.alias("counts"), F.count(F.when(full, 1)).alias("complete_rows"), F.array(*cvs).cast("array<double>").alias("cvs"))
    m = m.withColumn("cvs", F.filter("cvs", lambda x: x.isNotNull()))
    completeness = 100 * share(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x), F.col("rows") * len(df.columns))
    out = m.crossJoin(duplicate_rate(df).select("rate"))  # one row each
    return out.select(
        completeness.alias("completeness"), F.size(F.filter("counts", lambda x: x < F.col("rows"))).cast("long").alias("columns_with_missing"), "complete_rows",
        share(F.aggregate("cvs", F.lit(0.0), lambda a, x: a + x), F.size("cvs")).alias("average_cv"), F.size(F.filter("cvs", lambda x: x > 1)).cast("long").alias("high_cv_columns"),
        F.coalesce(completeness < least_complete, F.lit(False)).alias("much_missing"), F.coalesce(F.col("rate") > most_duplicates, F.lit(False)).alias("many_duplicates"),
    )


def coordinate_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, latitude_share, longitude_share): shares of values within 90 and 180 degrees."""
    within = lambda most: lambda c: share(F.count(F.when(F.abs(c.cast("double")) <= most, 1)), F.count(c))
    return by_column(df, columns, {"latitude_share": within(90), "longitude_share": within(180)})


def domain_scan(df: DataFrame, order: list[str], rows: int = 100, columns: int = 10) -> DataFrame:
    """What a look at a table's head shows: (column, samples, min, max, mean), five smallest values of text columns, three numbers of the others. A look at a head: its size is its purpose."""
    numeric = set(numeric_columns(df))
    head = df.orderBy(*order).limit(rows)
    texts = lambda c: F.array_join(F.slice(F.array_sort(F.collect_set(c)), 1, 5), ", ")
    none, x = F.lit(None), lambda c: F.col(f"`{c}`").cast("double")
    row = lambda c: F.struct(F.lit(c).alias("column"), (none.cast("string") if c in numeric else texts(F.col(f"`{c}`").cast("string"))).alias("samples"), *[(f(x(c)) if c in numeric else none.cast("double")).alias(n) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    picked = df.columns[:columns]
    wide = head.agg(*[row(c).alias(f"_{i}") for i, c in enumerate(picked)])
    return wide.select(F.inline(F.array(*[f"_{i}" for i in range(len(picked))])))


def detection_sample(df: DataFrame, key: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """n rows in MD5 order of the key. A sampling operator: n is its purpose."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def before_and_after(before: DataFrame, after: DataFrame, order: str, rows: int = 5) -> DataFrame:
    """(column, transformation, before, after): whether each column was preserved, dropped or added, with its first values by order."""

    def head(df: DataFrame, side: str) -> DataFrame:
        top = df.orderBy(order).limit(rows).select(F.col(order).alias("_order"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")).alias(f"_{i}") for i, c in enumerate(df.columns)])
        joined = lambda i: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_order", f"_{i}"))), lambda x: x[f"_{i}"]), ", ")
        wide = top.agg(*[joined(i).alias(f"_{i}") for i in range(len(df.columns))])
        return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias(side)) for i, c in enumerate(df.columns)])))

    both = head(before, "before").join(head(after, "after"), "column", "full_outer")  # one row a column
    kind = F.when(F.col("after").isNull(), "dropped").when(F.col("before").isNull(), "added").otherwise("preserved")
    return both.select("column", kind.alias("transformation"), F.coalesce("before", F.lit("COLUMN_ADDED")).alias("before"), F.coalesce("after", F.lit("COLUMN_DROPPED")).alias("after"))


def cleaning_preview(df: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """(column, operation, rows_affected) that cleaning would do, without doing it."""
    numeric = numeric_columns(df)
    missing = F.col("missing")
    operation = F.when(F.col("missing_share") > cfg.drop_null_share, "DROP_COLUMN").when(missing > 0, F.when(F.col("column").isin(numeric), "MEDIAN_IMPUTE").otherwise("MODE_IMPUTE"))
    columns = missingness(df).select("column", operation.alias("operation"), F.when(operation == "DROP_COLUMN", F.col("rows")).otherwise(missing).alias("rows_affected")).where("operation is not null")
    copies = duplicate_rate(df).where("duplicates > 0").select(F.lit("ALL_COLUMNS").alias("column"), F.lit("REMOVE_DUPLICATES").alias("operation"), F.col("duplicates").alias("rows_affected"))
    return columns.unionByName(copies)


def transformation_check(before: DataFrame, after: DataFrame, huge: float = 1e10) -> DataFrame:
    """One row: columns before and after, more than twice as many new ones, columns with infinite and with huge values, validity."""
    x = lambda c: F.abs(F.nanvl(c.cast("double"), F.lit(0.0)))
    numeric, new = numeric_columns(after), len(after.columns) - len(before.columns)
    n = lambda v: F.lit(v).cast("long")
    largest = after.agg(F.array(*[F.max(x(F.col(f"`{c}`"))) for c in numeric]).cast("array<double>").alias("m"))
    infinite, great = F.size(F.filter("m", lambda v: v == float("inf"))).cast("long"), F.size(F.filter("m", lambda v: v > huge)).cast("long")
    return largest.select(n(len(before.columns)).alias("original_columns"), n(len(after.columns)).alias("transformed_columns"), n(new).alias("new_columns"), F.lit(new > 2 * len(before.columns)).alias("many_new_columns"), infinite.alias("infinite_columns"), great.alias("huge_columns"), (infinite == 0).alias("valid"))


def feature_importance(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, importance, completeness), the most important first: variance times completeness of numbers, completeness of others."""
    numeric = set(numeric_columns(df))
    whole = lambda c: share(F.count(f"`{c}`"), F.count(F.lit(1)))
    weight = lambda c: F.coalesce(F.var_samp(f"`{c}`"), F.lit(0.0)) * whole(c) if c in numeric else whole(c)
    wide = df.agg(*[F.struct(F.lit(c).alias("feature"), weight(c).alias("importance"), whole(c).alias("completeness")).alias(f"_{i}") for i, c in enumerate(columns)])
    return wide.select(F.inline(F.array(*[f"_{i}" for i in range(len(columns))]))).orderBy(F.desc("importance"), "feature")


def feature_advice(df: DataFrame, correlated: float = 0.9, std: float = 1000.0, spread: float = 10000.0, most: int = 50) -> DataFrame:
    """One row: pairs of numeric columns that correlate above 0.9, columns to scale, text columns of more than 50 values."""
    numeric, texts = numeric_columns(df), [c for c, k in df.dtypes if k == "string"]
    pairs = [F.abs(stats.correlation(a, b)) for i, a in enumerate(numeric) for b in numeric[i + 1 :]]
    scale = [(F.stddev_samp(c) > std) | ((F.max(c) - F.min(c)) > spread) for c in numeric]
    count = lambda conditions: sum((F.coalesce(x.cast("long"), F.lit(0)) for x in conditions), F.lit(0).cast("long"))
    return df.agg(count([p > correlated for p in pairs]).alias("correlated_pairs"), count(scale).alias("columns_to_scale"), count([F.countDistinct(c) > most for c in texts]).alias("wide_categories"))


def fill_derived(df: DataFrame) -> DataFrame:
    """Nulls of derived columns filled: numbers with the median, others with the mode (ties: the smallest). """
    kinds, numeric = dict(df.dtypes), set(numeric_columns(df))
    columns = [c for c in df.columns if c.endswith(tuple(DERIVED_ENDS)) or any(p in c for p in DERIVED_PARTS)]
    if not columns:
        return df
    numbers, others = [c for c in columns if c in numeric], [c for c in columns if c not in numeric]
    fills = {c: v[0] for c, v in percentiles(df, numbers, [0.5]).items()} if numbers else {}
    if others:
        top = value_counts(df, others).groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), "value"))["value"].alias("value"))
        fills |= {r["column"]: r["value"] for r in top.collect()}  # one row a column
    value = lambda c, v: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(v)) if c in numeric else F.coalesce(F.col(f"`{c}`"), F.lit(v).cast(kinds[c]))
    return df.withColumns({c: value(c, fills[c]) for c in columns if fills.get(c) is not None})


def seasonality(df: DataFrame, time: str, value: str, least: int = 24, lags: int = 12) -> DataFrame:
    """One row: months, seasonality_score (largest autocorrelation of monthly means by size, up to a quarter of the months or 12 lags), lags above 0.3. 0 below 24 months."""
    series = stats.monthly(df, time, value)
    by = stats.autocorrelation(series, "month", "value", lags).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "r"))), lambda x: F.abs(x["r"])).alias("r"))  # one row a lag
    m = series.agg(F.count("*").alias("months")).crossJoin(by)
    r = F.filter(F.slice("r", 1, F.least(F.lit(lags), F.greatest(F.lit(1), F.floor(F.col("months") / 4).cast("int")))), lambda x: x.isNotNull() & ~F.isnan(x))
    enough = F.col("months") >= least
    return m.select("months", F.when(enough, F.coalesce(F.array_max(r), F.lit(0.0))).otherwise(0.0).alias("seasonality_score"), F.when(enough, F.size(F.filter(r, lambda x: x > 0.3))).otherwise(0).cast("long").alias("significant_lags"))


def schema_info(scores: DataFrame) -> DataFrame:
    """One row from type_scores: columns, those of high, medium and low confidence, share of high ones, ids to check."""
    x = F.col("confidence")
    n = lambda cond: F.count(F.when(cond, 1))
    return scores.agg(F.count("*").alias("total_columns"), n(x > 0.8).alias("high_confidence"), n((x >= 0.6) & (x <= 0.8)).alias("to_review"), n(x < 0.6).alias("low_confidence"), share(n(x > 0.8), F.count("*")).alias("confidence_rate"), n(F.col("id") >= 0.6).alias("likely_ids"))


def test_summary(tests: DataFrame) -> DataFrame:
    """One row: tests, significant ones, their share."""
    return tests.agg(F.count("*").alias("tests"), F.count(F.when(F.col("significant"), 1)).alias("significant"), share(F.count(F.when(F.col("significant"), 1)), F.count("*")).alias("significant_share"))


def by_priority(df: DataFrame, priority: str = "priority") -> DataFrame:
    """Rows by priority, unknown ones last."""
    return df.orderBy(F.coalesce(F.nullif(F.array_position(F.lit(PRIORITIES), F.col(priority)), F.lit(0)), F.lit(len(PRIORITIES) + 1)))


def remediation(gates: DataFrame, scores: DataFrame) -> DataFrame:
    """(type, priority, subject, value, effort) by priority: failed gates, and low scores of the one row (data_completeness,
    data_consistency, schema_quality, overall_score), each of 0 to 100."""
    failed = gates.where(~F.col("passed")).select(F.lit("validation_failure").alias("type"), F.when(F.col("severity") == "critical", "high").otherwise("medium").alias("priority"), F.col("gate").alias("subject"), F.col("value").cast("double").alias("value"), F.lit("medium").alias("effort"))
    rule = lambda kind, priority, score, effort, cond: F.when(cond, F.struct(F.lit(kind).alias("type"), F.lit(priority).alias("priority"), F.lit(score).alias("subject"), F.col(score).cast("double").alias("value"), F.lit(effort).alias("effort")))
    rules = F.array(
        rule("data_quality", "high", "data_completeness", "high", F.col("data_completeness") < 80),
        rule("data_quality", "medium", "data_consistency", "medium", F.col("data_consistency") < 70),
        rule("schema_inference", "medium", "schema_quality", "low", F.col("schema_quality") < 60),
        rule("overall_quality", "critical", "overall_score", "high", F.col("overall_score") < 50),
        rule("overall_quality", "high", "overall_score", "medium", (F.col("overall_score") >= 50) & (F.col("overall_score") < 70)),
    )
    return by_priority(failed.unionByName(scores.select(F.inline(F.filter(rules, lambda r: r.isNotNull())))))


def total_effort(recommendations: DataFrame) -> DataFrame:
    """One row: weight of all efforts and its label."""
    weights = F.create_map(*[F.lit(v) for pair in EFFORT.items() for v in pair])
    w = recommendations.agg(F.coalesce(F.sum(F.coalesce(weights[F.col("effort")], F.lit(3))), F.lit(0)).alias("weight"))
    return w.withColumn("effort", F.when(F.col("weight") <= 3, "low").when(F.col("weight") <= 8, "medium").otherwise("high"))


def evidence(kpis: DataFrame, correlations: DataFrame, inequality: DataFrame | None = None, tests: DataFrame | None = None, trends: DataFrame | None = None) -> DataFrame:
    """(kind, subject, value, label): every mean, the five strongest significant correlations, levels of inequality, up to three significant tests, all
    significant trends.

    kpis have column and mean; correlations a, b, r and significant; inequality metric, gini and level; tests name, p_value and significant; trends metric,
    slope, direction and significant."""
    out = kpis.select(F.lit("kpi").alias("kind"), F.col("column").alias("subject"), F.col("mean").alias("value"), F.lit(None).cast("string").alias("label"))
    strong = correlations.where("significant").orderBy(F.desc(F.abs("r")), "a", "b").limit(5)
    out = out.unionByName(strong.select(F.lit("correlation").alias("kind"), F.concat_ws(" ~ ", "a", "b").alias("subject"), F.col("r").alias("value"), F.when(F.col("r") > 0, "positive").otherwise("negative").alias("label")))
    if inequality is not None:
        out = out.unionByName(inequality.select(F.lit("inequality").alias("kind"), F.col("metric").alias("subject"), F.col("gini").alias("value"), F.col("level").alias("label")))
    if tests is not None:
        found = tests.where("significant").orderBy("p_value", "name").limit(3)
        out = out.unionByName(found.select(F.lit("test").alias("kind"), F.col("name").alias("subject"), F.col("p_value").alias("value"), F.lit("significant").alias("label")))
    if trends is not None:
        out = out.unionByName(trends.where("significant").select(F.lit("trend").alias("kind"), F.col("metric").alias("subject"), F.col("slope").alias("value"), F.col("direction").alias("label")))
    return out


def findings_confidence(findings: DataFrame, confidence: str = "confidence") -> DataFrame:
    """One row: findings, percent of HIGH ones and the level from it, and the mean of 90, 70 and 50 (75 without findings) with its level."""
    c = F.coalesce(F.col(confidence), F.lit("MEDIUM"))
    high = F.coalesce(100 * share(F.count(F.when(c == "HIGH", 1)), F.count("*")), F.lit(0.0))
    mean = F.coalesce(F.avg(F.when(c == "HIGH", 90.0).when(c == "MEDIUM", 70.0).otherwise(50.0)), F.lit(75.0))
    m = findings.agg(F.count("*").alias("findings"), high.alias("high_percent"), mean.alias("score"))
    level = lambda x, a, b: F.when(x >= a, "HIGH").when(x >= b, "MEDIUM").otherwise("LOW")
    return m.withColumns({"insight_level": level(F.col("high_percent"), 60, 30), "score_level": level(F.col("score"), 80, 60)})


def overall_confidence(errors: int, score: float = 100.0) -> str:
    """Level of a whole run: errors first, then its quality score."""
    if errors:
        return "LOW" if errors > 3 else "MEDIUM"
    return "HIGH" if score >= 85 else "MEDIUM" if score >= 70 else "LOW"


def profile_flags(df: DataFrame, most_missing: float = 0.10, most_duplicates: float = 0.05, many: float = 0.8, least: int = 100, most_outliers: float = 0.05) -> DataFrame:
    """(flag, subject, value): what is odd about a table. much_missing and many_duplicates (shares, of the whole table), high_cardinality of
    text columns (distinct values), many_outliers of numeric columns (values outside the quartile bounds), constant columns (distinct values, 0 or 1)."""
    kinds, numeric = dict(df.dtypes), numeric_columns(df)
    texts = [c for c in df.columns if kinds[c] == "string"]
    cells = sum((F.col(f"`{c}`").isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    whole = df.agg(F.try_divide(F.sum(cells).cast("double"), (F.count("*") * len(df.columns)).cast("double")).alias("value"))
    out = whole.where(F.col("value") > most_missing).select(F.lit("much_missing").alias("flag"), F.lit(None).cast("string").alias("subject"), "value")
    out = out.unionByName(duplicate_rate(df).where(F.col("rate") > most_duplicates).select(F.lit("many_duplicates").alias("flag"), F.lit(None).cast("string").alias("subject"), F.col("rate").alias("value")))
    if texts:
        sizes = value_counts(df, texts).groupBy("column").agg(F.count("*").alias("n")).crossJoin(df.agg(F.count("*").alias("_rows")))  # one row
        wide = sizes.where((F.col("n") > least) & (F.col("n") > many * F.col("_rows")))
        out = out.unionByName(wide.select(F.lit("high_cardinality").alias("flag"), F.col("column").alias("subject"), F.col("n").cast("double").alias("value")))
    if numeric:
        bounds = {r["column"]: r for r in percentiles_of(df, numeric).collect()}  # one row a column
        far = {c: (F.col(f"`{c}`") < r["q1"] - 1.5 * (r["q3"] - r["q1"])) | (F.col(f"`{c}`") > r["q3"] + 1.5 * (r["q3"] - r["q1"])) for c, r in bounds.items() if r["q1"] is not None}
        if far:
            wide = df.agg(F.count("*").alias("_rows"), F.array(*[F.struct(F.lit(c).alias("subject"), F.count(F.when(x, 1)).cast("double").alias("value")) for c, x in far.items()]).alias("c"))
            wide = wide.select("_rows", F.inline("c")).where(F.col("value") > most_outliers * F.col("_rows"))
            out = out.unionByName(wide.select(F.lit("many_outliers").alias("flag"), "subject", "value"))
    one = by_column(df, [c for c in df.columns if not kinds[c].startswith("map")], {"lo": lambda c: F.min(c.cast("string")), "hi": lambda c: F.max(c.cast("string"))})
    constant = one.where(F.col("lo").eqNullSafe(F.col("hi")))
    return out.unionByName(constant.select(F.lit("constant").alias("flag"), F.col("column").alias("subject"), F.col("lo").isNotNull().cast("double").alias("value")))


def percentiles_of(df: DataFrame, columns: list[str]) -> DataFrame:
    return percentile_table(df, columns, {"q1": 0.25, "q3": 0.75})


def fallback_findings(evidence_rows: DataFrame) -> DataFrame:
    """(id, kind, finding, evidence, confidence): findings by rule from the rows of evidence(): the first indicator by name, and the most unequal metric."""
    first = evidence_rows.where("kind = 'kpi'").orderBy("subject").limit(1).select(
        F.lit(1).alias("id"), "kind", F.format_string("Key metric %s shows significant variation across the dataset", "subject").alias("finding"), F.format_string("Mean value: %.1f", F.coalesce("value", F.lit(0.0))).alias("evidence"), F.lit("MEDIUM").alias("confidence"))
    second = evidence_rows.where("kind = 'inequality'").orderBy(F.desc("value"), "subject").limit(1).select(
        F.lit(2).alias("id"), "kind", F.format_string("Significant geographic inequality detected in %s", "subject").alias("finding"), F.format_string("Inequality level: %s", F.coalesce("label", F.lit("unknown"))).alias("evidence"), F.lit("HIGH").alias("confidence"))
    return first.unionByName(second)


def fallback_recommendations(findings: DataFrame) -> DataFrame:
    """(recommendation, finding, priority, timeframe): one row for the first finding, none without findings."""
    return findings.orderBy("id").limit(1).select(F.lit("Conduct detailed analysis of identified patterns for targeted interventions").alias("recommendation"), "finding", F.lit("HIGH").alias("priority"), F.lit("Short-term").alias("timeframe"))


def data_summary(df: DataFrame, numbers: int = 10, texts: int = 8, most_pairs: int = 10, place: str | None = None) -> DataFrame:
    """(section, subject, item, value): a table in few rows: mean, std, min, max and outliers of the first numeric columns, the five most frequent values of
    the first text columns, the strongest pairs above 0.5, and the highest and lowest places by the mean of the first numeric column."""
    numeric, kinds = metric_columns(df)[:numbers], dict(df.dtypes)
    words = [c for c in df.columns if kinds[c] == "string"][:texts]
    empty = df.sparkSession.createDataFrame([], "section string, subject string, item string, value double")
    parts = [empty]
    if numeric:
        d = lambda f: lambda c: f(c.cast("double"))
        k = by_column(df, numeric, {"mean": d(F.avg), "std": d(F.stddev_samp), "min": d(F.min), "max": d(F.max)})
        b = {r["column"]: r for r in percentiles_of(df, numeric).collect()}  # one row a column
        outside = {c: F.count(F.when((F.col(f"`{c}`") < r["q1"] - 1.5 * (r["q3"] - r["q1"])) | (F.col(f"`{c}`") > r["q3"] + 1.5 * (r["q3"] - r["q1"])), 1)) if r["q1"] is not None else F.lit(0) for c, r in b.items()}
        items = F.array(*[F.struct(F.lit(s).alias("item"), F.col(s).alias("value")) for s in ("mean", "std", "min", "max")])
        parts.append(k.select(F.lit("numeric").alias("section"), F.col("column").alias("subject"), F.inline(items)))
        counts = df.agg(F.array(*[F.struct(F.lit(c).alias("subject"), x.cast("double").alias("value")) for c, x in outside.items()]).alias("c")).select(F.inline("c"))
        parts.append(counts.select(F.lit("numeric").alias("section"), "subject", F.lit("outliers").alias("item"), "value"))
    if words:
        top = top_values(df, words).select(F.lit("categorical").alias("section"), F.col("column").alias("subject"), F.col("value").alias("item"), F.col("n").cast("double").alias("value"))
        parts.append(top)
    if len(numeric) > 1:
        pairs = stats.strong_pairs(stats.pearson_pairs(df, numeric), 0.5, most_pairs)
        parts.append(pairs.select(F.lit("pair").alias("section"), F.col("a").alias("subject"), F.col("b").alias("item"), F.col("r").alias("value")))
    if place and numeric:
        means = df.where(F.col(place).isNotNull()).groupBy(place).agg(F.avg(numeric[0]).alias("value"))
        ends = stats.top_and_bottom(means, place, "value", 3)
        parts.append(ends.select(F.col("side").alias("section"), F.col(place).cast("string").alias("subject"), F.lit(numeric[0]).alias("item"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
