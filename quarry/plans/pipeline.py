"""The fixed pipeline over one table: ingest, infer, standardise, clean, transform, validate, analyse.

Every stage takes a table and returns a table, a report of what was done and small result tables. Decisions come from a few aggregates a
stage. A stage's table is stored in the shared folder, so the next stage's aggregates read columns instead of planning the chain again. The
trace has a row a stage; rows are counted by the writes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import stores
from ..config import DEFAULTS, Context, Thresholds
from ..functions.scalars import nan_to_null
from ..operators import clean, detect, features, naming, normality, profile, quality, reports, significance, stats, summary, units
from ..operators.requirements import Requirements, cardinalities, requirements
from .trace import Trace


@dataclass(frozen=True)
class StageResult:
    df: DataFrame
    report: list[dict] = field(default_factory=list)
    tables: dict[str, DataFrame] = field(default_factory=dict)


def ingest(df: DataFrame) -> StageResult:
    """NaN becomes null in every floating column."""
    out = df.select(*[nan_to_null(F.col(f"`{c}`")).alias(c) if k in ("float", "double") else F.col(f"`{c}`") for c, k in df.dtypes])
    return StageResult(out, [{"columns": len(df.columns)}])


def inferred(df: DataFrame, context: Context = Context(), cfg: Thresholds = DEFAULTS) -> tuple[StageResult, list[naming.Named]]:
    """Types and canonical names proposed for all columns."""
    simple = [c for c, k in df.dtypes if not k.startswith(("array", "map", "struct", "binary"))]
    scores = stores.stored(detect.type_scores(df, simple), "types") if simple else None
    found = [(r["column"], r["type"], r["confidence"]) for r in scores.collect()] if simple else []  # one row a column
    proposals = naming.mapping(found, context.domain, {**detect.ALIASES, **cfg.aliases})
    report = [{"column": p.original, "canonical": p.canonical, "type": p.kind, "confidence": p.confidence, "rule": p.rule, "hint": p.hint} for p in proposals]
    return StageResult(df, report, {"types": scores, "schema_info": reports.schema_info(scores), "samples": summary.sample_values(df, simple)} if simple else {}), proposals


def standardize(df: DataFrame, proposals: list[naming.Named], cfg: Thresholds = DEFAULTS) -> StageResult:
    """Renames by the proposals, cleans text, normalises units, casts to the proposed types."""
    out, renames = naming.renamed(df, proposals, cfg.type_confidence)
    out, truths = units.normalized_text(out)
    out, unit_log = units.normalized_units(out)
    out, casts = naming.converted(out, proposals, cfg.type_confidence)
    casts = stores.stored(casts, "casts")
    report = [{"action": "rename", **r} for r in renames] + [{"action": "unit", **u} for u in unit_log] + [{"action": "truth words", "column": c} for c in truths]
    report += [{"action": "cast", **r.asDict()} for r in casts.collect()]  # one row a column
    return StageResult(out, report, {"casts": casts})


def cleaned(df: DataFrame, cfg: Thresholds = DEFAULTS) -> StageResult:
    """Imputes by share of nulls, removes duplicates, flags or removes outliers."""
    m = {r["column"]: r["missing_share"] or 0.0 for r in profile.missingness(df).collect()}  # one row a column
    numeric, kinds = set(profile.numeric_columns(df)), dict(df.dtypes)
    sparse = [c for c, s in m.items() if s > cfg.drop_null_share]
    sparse = sparse if len(sparse) < len(m) else []  # a table of nulls alone keeps its columns
    out = df.drop(*sparse)
    report = [{"column": c, "action": "dropped", "share": m[c]} for c in sparse]
    group = next((c for c in out.columns if kinds[c] == "string" and m[c] == 0), None)
    holes = [c for c in out.columns if m[c] > 0]
    few = {c for c, n in cardinalities(out, [c for c in holes if kinds[c] == "string" and m[c] < cfg.group_below]).items() if n < 20}
    chosen: dict[str, list[str]] = {"flagged": [], "median": [], "group median": [], "mode": [], "placeholder": []}
    for c in holes:
        if m[c] >= cfg.group_below or c not in numeric and kinds[c] != "string":
            chosen["flagged"].append(c)
        elif c in numeric:
            chosen["median" if m[c] < cfg.median_below or group is None else "group median"].append(c)
        else:
            chosen["mode" if c in few else "placeholder"].append(c)
    report += [{"column": c, "action": action, "share": m[c]} for action, columns in chosen.items() for c in columns]
    out = clean.impute(out, chosen["median"], chosen["mode"], chosen["placeholder"], dict.fromkeys(chosen["group median"], group))
    if not any(k.startswith("map") for k in kinds.values()):
        out = clean.dedupe(out)
    metrics = [c for c in profile.metric_columns(out) if c in numeric]
    if metrics:
        out = stores.stored(out, "imputed")
        out = clean.outlier_policy(out, metrics, cfg.outlier_remove_share)
    return StageResult(out, report, {"missingness": profile.missingness(df)})


def transformed(df: DataFrame, cfg: Thresholds = DEFAULTS, trend_metrics: int = 5, group_metrics: int = 3, most_groups: int = 2) -> StageResult:
    """Times, per capita, trends, group features, encodings, scales, logs and ratios where the table asks for them; nulls of derived columns filled."""
    out, times = features.parsed_dates(df)
    for c in times:
        out = features.calendar(out, c)
    out = features.per_capita(out, naming.columns_for(df, "denominator"))
    metrics = profile.metric_columns(df)
    ordered = [c for c in naming.columns_for(df, "time") if dict(out.dtypes)[c] in ("date", "timestamp", "timestamp_ntz") or c in profile.numeric_columns(out)]
    if ordered and metrics:
        row = "_row_of_trends"
        plain = [c for c, k in df.dtypes if not k.startswith("map")]
        out = stores.stored(out.withColumn(row, F.xxhash64(*[F.col(f"`{c}`") for c in plain])), "dated")
        n = out.count()
        out = features.trends(out, metrics[:trend_metrics], ordered[0], row, windows=tuple(w for w in cfg.windows if n >= w)).drop(row)
    need = requirements(df, cfg)
    for g in need.groups[:most_groups]:
        out = features.group_stats(out, g, metrics[:group_metrics], of=df)
        for c in metrics[:group_metrics]:
            out = clean.group_rank(out, g, c, f"{c}_by_{g}_rank", of=df)
    for c in need.binary:
        out = features.binary_encode(out, c, c, of=df)
    for c in need.one_hot:
        out = features.one_hot(out, c, cfg.one_hot_most, of=df)
    for c in need.label:
        out = features.label_encode(out, c, of=df)
    scale = [c for c in need.scale if c in metrics]
    if scale:
        out = features.scaled(out, scale, of=df)
    if need.skewed:
        out = features.log_skewed(out, [c for c in need.skewed if c in metrics], cfg.skew, of=df)
    if need.interactions and len(metrics) >= 2:
        out = features.interactions(out, metrics, cfg.ratio_pairs)
    out = reports.fill_derived(stores.stored(out, "derived"))
    tables = {"transformation_check": reports.transformation_check(df, out), "feature_catalog": reports.feature_importance(out, [c for c in out.columns if c not in df.columns])} if len(out.columns) > len(df.columns) else {}
    return StageResult(out, [{"added": c} for c in out.columns if c not in df.columns] + [{"asked": k, "columns": v} for k, v in asked(need).items()], tables)


def asked(need: Requirements) -> dict[str, list[str]]:
    return {k: v for k, v in vars(need).items() if isinstance(v, list) and v}


def validated(before: DataFrame, df: DataFrame, added: int, failed_casts: int, schema_share: float, cfg: Thresholds = DEFAULTS) -> StageResult:
    """Gates, component scores, the overall confidence, flags of cleaning and advice."""
    gates = stores.stored(quality.gates(df, cfg), "gates")
    rows = [r.asDict() for r in gates.collect()]  # one row a gate
    critical = any(not g["passed"] and g["severity"] == "critical" for g in rows)
    p = summary.dataset_profile(df).first()
    parts = {
        "data_completeness": 100 * (1 - (p["missing_share"] or 0.0)) if p["rows"] else 0.0, "data_consistency": 100.0 - min(20, 5 * failed_casts),
        "transformation_quality": float(min(100, 70 + 5 * added)), "validation_gates": 100 * sum(bool(g["passed"]) for g in rows) / len(rows), "schema_quality": 100 * schema_share,
    }
    score, level = quality.confidence(*parts.values(), critical)
    scores = df.sparkSession.createDataFrame([(*parts.values(), score, level)], ", ".join(f"{k} double" for k in parts) + ", overall_score double, level string")
    flags = summary.cleaning_flags(before, df) if profile.metric_columns(df) else None
    advice = reports.remediation(gates, scores)
    tables = {"gates": gates, "scores": scores, "advice": advice, "effort": reports.total_effort(advice)} | ({"cleaning_flags": flags} if flags is not None else {})
    return StageResult(df, [*rows, {"score": round(score, 1), "level": level}, {"route": quality.route(rows, cfg.retries, cfg.retries)}], tables)


def analyzed(df: DataFrame, cfg: Thresholds = DEFAULTS, most: int = 10) -> StageResult:
    """Indicators, correlations, normality, group comparisons, trends and distributions of the cleaned table, a small table each."""
    metrics, numeric = profile.metric_columns(df), set(profile.numeric_columns(df))
    texts = [c for c, k in df.dtypes if k == "string"]
    key = [c for c, k in df.dtypes if not k.startswith(("map", "array", "struct"))]
    need = requirements(df, cfg)
    tables: dict[str, DataFrame] = {"quality": summary.analysis_quality(df), "profile": summary.dataset_profile(df)}
    if metrics:
        tables["numeric_kpis"] = profile.numeric_kpis(df, metrics)
        tables["outliers"] = clean.outlier_summary(df, metrics[:most])
        tables["normality"] = normality.normality_tests(df, metrics[:most], key, cfg.alpha)
    if texts:
        tables["categorical_kpis"] = profile.categorical_kpis(df, texts)
        tables["top_values"] = summary.top_values(df, texts)
    if len(metrics) > 1:
        tables["correlations"] = significance.correlations(df, metrics)
        tables["strong_pairs"] = stats.strong_pairs(stats.pearson_pairs(df, metrics))
    if need.groups and metrics:
        tables["group_comparison"] = normality.compare_groups(df, metrics[0], need.groups[0], key, cfg.alpha)
    if len(need.groups) > 1:
        tables["independence"] = significance.chi_square(df, need.groups[0], need.groups[1])
    times = [c for c in naming.columns_for(df, "time") if c not in numeric and dict(df.dtypes)[c] != "string"] + [c for c in need.times if c not in naming.columns_for(df, "time")]
    if times and metrics:
        tables["trends"] = significance.trends_over_time(df, times[0], metrics[:most])
        tables["monthly"] = stats.monthly(df, times[0], metrics[0])
        tables["seasonality"] = reports.seasonality(df, times[0], metrics[0])
    places = naming.columns_for(df, "geographic")
    if places and metrics:
        tables["inequality"] = stats.gini(df, places[0], metrics[0]).select(F.lit(metrics[0]).alias("metric"), "gini", "cv", "ratio", "level")
        tables["regions"] = stats.top_and_bottom(stats.regional(df, places[0], metrics[0]), places[0], "total")
    if "numeric_kpis" in tables and "correlations" in tables:
        tables["evidence"] = reports.evidence(tables["numeric_kpis"], tables["correlations"], tables.get("inequality"), trends=tables.get("trends"))
    main = tables.get("numeric_kpis", df.limit(0))
    return StageResult(main, [{"table": name} for name in tables], tables)


def attempt(trace: Trace, name: str, f: Callable[[], StageResult], retries: int) -> StageResult:
    """A stage with its row in the trace, its table stored; tried again after an error, up to retries times."""
    for n in range(retries + 1):
        try:
            with trace.stage(name) as s:
                out = f()
                s.metrics |= {"columns": len(out.df.columns), "attempt": n}
                return StageResult(stores.stored(s.observed(out.df), name), out.report, out.tables)
        except Exception:
            if n == retries:
                raise
    raise AssertionError


def run(df: DataFrame, cfg: Thresholds = DEFAULTS, context: Context = Context(), trace: Trace | None = None, retries: int = 0) -> dict[str, StageResult]:
    """All stages; a failed critical gate is reported as route fail. The trace is the result of stage "trace"."""
    trace = trace or Trace(df.sparkSession)
    raw = attempt(trace, "ingest", lambda: ingest(df), retries)
    types, proposals = inferred(raw.df, context, cfg)
    std = attempt(trace, "standardize", lambda: standardize(raw.df, proposals, cfg), retries)
    cln = attempt(trace, "clean", lambda: cleaned(std.df, cfg), retries)
    new = attempt(trace, "transform", lambda: transformed(cln.df, cfg), retries)
    lost = sum(1 for r in std.report if r.get("action") == "cast" and (r["status"] == "missing" or r["lost"]))
    share = sum(p.confidence > 0.8 for p in proposals) / len(proposals) if proposals else 0.5
    added = sum("added" in r for r in new.report)
    with trace.stage("validate"):
        checked = validated(std.df, cln.df, added, lost, share, cfg)
    with trace.stage("analyze"):
        analysis = analyzed(cln.df, cfg)
    return {"ingest": raw, "infer": types, "standardize": std, "clean": cln, "transform": new, "validate": checked, "analyze": analysis, "trace": StageResult(trace.table())}


def run_record(result: dict[str, StageResult], run_id: str, dataset: str, domain: str, now: str) -> DataFrame:
    """The row of a run for the run memory (see run_memory.TABLES)."""
    df, scores = result["clean"].df, result["validate"].tables["scores"].first()
    rows = df.count()
    return df.sparkSession.range(1).select(
        F.lit(run_id).alias("run_id"), F.lit(dataset).alias("dataset_name"), F.lit(domain).alias("domain"), F.lit(summary.schema_fingerprint(result["ingest"].df)).alias("schema_hash"), F.lit(None).cast("string").alias("sample_hash"),
        F.lit(now).cast("timestamp").alias("timestamp"), F.lit(scores["overall_score"] / 100).alias("confidence_score"), F.lit(scores["overall_score"]).alias("quality_score"), F.lit(rows).cast("long").alias("rows_processed"),
        F.lit(len(df.columns)).cast("long").alias("columns_processed"), F.lit(int(result["validate"].report[-1]["route"] == "continue")).alias("success"),
    )
