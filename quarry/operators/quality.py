"""Validation gates and scores from a few aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Thresholds
from .profile import duplicate_rate, missingness


def gates(df: DataFrame, cfg: Thresholds = DEFAULTS) -> DataFrame:
    """(gate, passed, severity, value) of the four validation gates."""
    m = missingness(df).agg(F.max("rows").alias("rows"), F.avg((F.col("missing") < F.col("rows")).cast("double")).alias("filled"), F.max("missing_share").alias("worst"))
    s = m.crossJoin(duplicate_rate(df).select("rate"))  # one row each
    g = lambda n, ok, sev, v: F.struct(F.lit(n).alias("gate"), ok.alias("passed"), F.lit(sev).alias("severity"), v.cast("double").alias("value"))
    return s.select(F.inline(F.array(
        g("sufficient_data", F.col("rows") >= cfg.least_rows, "critical", F.col("rows")),
        g("key_columns_present", F.col("filled") >= cfg.key_columns, "critical", F.col("filled")),
        g("high_missingness", F.col("worst") <= cfg.most_missing, "warning", F.col("worst")),
        g("reasonable_duplicates", F.col("rate") <= cfg.most_duplicates, "warning", F.col("rate")),
    )))


def named_gates(df: DataFrame, names: list[str], cfg: Thresholds = DEFAULTS) -> list[dict]:
    """The gates of some names, in that order. One that is not known passes with a note; if the gates can't be computed, all known ones fail with the error."""
    try:
        found, error = {r["gate"]: r.asDict() for r in gates(df, cfg).collect()}, None
    except Exception as e:  # noqa: BLE001  a gate that breaks has failed
        found, error = {}, f"{type(e).__name__}: {e}"[:500]
    known = {"sufficient_data": "critical", "key_columns_present": "critical", "high_missingness": "warning", "reasonable_duplicates": "warning"}
    out = []
    for name in names:
        if name not in known:
            out.append({"gate": name, "passed": True, "severity": "warning", "value": None, "details": "gate not implemented"})
        elif error:
            out.append({"gate": name, "passed": False, "severity": known[name], "value": None, "details": f"gate failed: {error}"})
        else:
            out.append(found[name] | {"details": None})
    return out


def route(gate_rows: list, retries: int = 0, most: int = 2) -> str:
    """continue, retry or fail: a failed critical gate is retried up to most times."""
    bad = [g for g in gate_rows if not g["passed"] and g["severity"] == "critical"]
    return "continue" if not bad else "retry" if retries < most else "fail"


def confidence(completeness: float, consistency: float, transformation: float, gate_share: float, schema: float, critical: bool) -> tuple[float, str]:
    """Weighted score of 0 to 100 and its level; a failed critical gate halves it."""
    score = 0.25 * completeness + 0.20 * consistency + 0.15 * transformation + 0.25 * gate_share + 0.15 * schema
    score *= 0.5 if critical else 1
    return score, "HIGH" if score >= 85 else "MEDIUM" if score >= 70 else "LOW"


def cleaning_score(missing_share: float, row_loss: float, warnings: int = 0, errors: int = 0, infos: int = 0) -> int:
    return int(max(0, min(100, 100 - 30 * missing_share - 20 * row_loss - 10 * warnings - 20 * errors - 2 * infos)))
