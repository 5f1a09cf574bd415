"""What a run leaves behind: nine JSON documents, a preview, a trace and a Markdown report, in one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import reports
from ..sources import sinks
from .pipeline import StageResult
from .trace import trace_summary

# The documents of a run and the stage that each is about.
DOCUMENTS = {
    "data_profile": "ingest", "schema_mapping": "infer", "standardization_summary": "standardize", "cleaning_summary": "clean", "feature_catalog": "transform",
    "validation_report": "validate", "analysis_results": "analyze", "insights": "analyze", "run_summary": "trace",
}


def insights(result: dict[str, StageResult]) -> dict[str, DataFrame]:
    """Findings by rule from a run's evidence, advice and confidence; none without evidence."""
    evidence = result["analyze"].tables.get("evidence")
    if evidence is None:
        return {}
    findings = reports.fallback_findings(evidence)
    return {"findings": findings, "recommendations": reports.fallback_recommendations(findings), "confidence": reports.findings_confidence(findings)}


def contents(result: dict[str, StageResult], name: str) -> dict:
    """The plain data of a document: the stage's report and its small tables."""
    stage = result[DOCUMENTS[name]]
    tables = {"insights": insights(result), "run_summary": {"summary": trace_summary(result["trace"].df), "stages": result["trace"].df}}.get(name, stage.tables)
    return {"document": name, "columns": len(stage.df.columns), "report": stage.report if name not in ("insights", "run_summary") else [], **{k: sinks.to_document(t) for k, t in tables.items()}}


def write_run(spark: SparkSession, result: dict[str, StageResult], folder: str) -> None:
    """Writes the cleaned and the transformed table, all documents, a preview of what changed, the trace and the report."""
    folder = folder.rstrip("/")
    sinks.write_table(result["standardize"].df, f"{folder}/standardized")
    sinks.write_table(result["clean"].df, f"{folder}/cleaned")
    sinks.write_table(result["transform"].df, f"{folder}/transformed")
    for name in DOCUMENTS:
        sinks.write_document(spark, contents(result, name), f"{folder}/documents/{name}")
    sinks.write_preview(reports.cleaning_preview(result["standardize"].df), f"{folder}/preview")
    sinks.append_log(spark, [{"stage": stage, **row} for stage in ("standardize", "clean", "transform") for row in result[stage].report], f"{folder}/transform_log")
    sinks.append_log(spark, [row for row in result["validate"].report if "gate" in row], f"{folder}/quality_log")
    sections = {"Profile": result["analyze"].tables["profile"], "Scores": result["validate"].tables["scores"], "Gates": result["validate"].tables["gates"], "Advice": result["validate"].tables["advice"]}
    sections |= {name.replace("_", " ").capitalize(): t for name, t in {**insights(result), **{k: result["analyze"].tables[k] for k in ("numeric_kpis", "strong_pairs", "group_comparison") if k in result["analyze"].tables}}.items()}
    text = sinks.report_text("Run", sections)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/report")
