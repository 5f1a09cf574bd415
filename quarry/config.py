"""Default thresholds of all operators, in one place, and how they are set: defaults, a YAML file, a context file, arguments, in that order."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Thresholds:
    drop_null_share: float = 0.95
    high_missing: float = 0.30
    median_below: float = 0.05
    group_below: float = 0.20
    iqr_multiplier: float = 1.5
    outlier_remove_share: float = 0.01
    type_confidence: float = 0.6
    alpha: float = 0.05
    encode_most: int = 50
    one_hot_most: int = 10
    scale_std: float = 1000.0
    scale_range: float = 10000.0
    skew: float = 2.0
    ratio_pairs: int = 5
    group_least: int = 2
    group_most: int = 20
    windows: tuple[int, ...] = (3, 6, 12)
    z: float = 3.0
    modified_z: float = 3.5
    least_rows: int = 100
    key_columns: float = 0.95
    most_missing: float = 0.5
    most_duplicates: float = 0.1
    retries: int = 2
    keep_days: int = 90
    sample_rows: int = 500
    denominators: tuple[str, ...] = ("population", "households", "families")
    aliases: dict[str, str] = field(default_factory=dict)


DEFAULTS = Thresholds()


@dataclass(frozen=True)
class Context:
    """What a run is about."""

    domain: str = "other"
    scope: str = ""
    description: str = ""
    stakeholders: str = ""
    business_questions: tuple[str, ...] = ()
    key_metrics: tuple[str, ...] = ()


# Keys of a configuration file, by section, and the threshold that each sets. The path of a nested key is joined by dots.
KEYS = {
    "data_quality.drop_column_threshold": "drop_null_share", "data_quality.high_missingness_threshold": "high_missing",
    "data_quality.num_median_impute_threshold": "median_below", "data_quality.group_impute_threshold": "group_below",
    "data_quality.outlier_iqr_multiplier": "iqr_multiplier", "data_quality.max_auto_drop_rows_percent": "outlier_remove_share",
    "data_quality.low_confidence_type_threshold": "type_confidence", "statistics.significance_alpha": "alpha",
    "pipeline.max_retries": "retries", "pipeline.sample_rows_default": "sample_rows", "security.data_retention_days": "keep_days",
    "feature_engineering.rolling_windows": "windows", "feature_engineering.per_capita_denominators": "denominators",
    "feature_engineering.transformation_controls.categorical_encoding.max_cardinality": "encode_most",
    "feature_engineering.transformation_controls.numeric_scaling.variance_threshold": "scale_std",
    "feature_engineering.transformation_controls.numeric_scaling.range_threshold": "scale_range",
    "feature_engineering.transformation_controls.skew_handling.skewness_threshold": "skew",
    "feature_engineering.transformation_controls.interaction_features.max_interactions": "ratio_pairs",
}
# Names of validation gates in a configuration file and the threshold that each sets.
GATES = {"sufficient_data": "least_rows", "key_columns_present": "key_columns", "high_missingness": "most_missing", "reasonable_duplicates": "most_duplicates"}
# Keys and sections of such files that say nothing about this library's work.
UNUSED = (
    "groq", "output", "domains", "memory", "observability", "insights", "development", "security.pii_patterns", "security.auto_delete_raw_data",
    "security.redact_pii_in_llm_calls", "security.max_sample_size_for_llm", "data_quality.kpi_missingness_threshold",
    "data_quality.llm_fallback_confidence_range", "statistics.effect_size_thresholds", "statistics.correlation_threshold", "statistics.min_sample_size",
    "pipeline.chunk_size_large_files", "pipeline.max_memory_usage_mb", "pipeline.retry_delay_seconds", "feature_engineering.per_capita_multipliers",
    "feature_engineering.time_aggregations", "feature_engineering.growth_periods", "feature_engineering.quantile_buckets",
    "feature_engineering.transformation_controls",
)


def from_tree(tree: dict) -> dict:
    """Thresholds by name from a parsed configuration file. A key that is not known raises."""
    out: dict = {}

    def walk(node: dict, path: str) -> None:
        for k, v in node.items():
            at = f"{path}.{k}" if path else str(k)
            if at in KEYS:
                out[KEYS[at]] = tuple(v) if isinstance(v, list) else v
            elif at == "standardization.column_aliases":
                out["aliases"] = {a: x["canonical"] for x in v for a in x["aliases"]}
            elif at in ("validation_gates.critical", "validation_gates.warning"):
                for gate in v:
                    if gate["name"] not in GATES:
                        raise ValueError(f"unknown gate in the configuration: {gate['name']}")
                    out[GATES[gate["name"]]] = gate["threshold"]
            elif isinstance(v, dict) and any(known.startswith(f"{at}.") for known in (*KEYS, *UNUSED, "standardization.column_aliases", "validation_gates.critical")):
                walk(v, at)
            elif not any(at == u or at.startswith(f"{u}.") for u in UNUSED):
                raise ValueError(f"unknown key in the configuration: {at}")

    walk(tree, "")
    return out


def _parsed(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f) or {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no keys")
    return found


def load_config(path: str | None = None, **arguments) -> Thresholds:
    """Defaults, then what a YAML file on the driver says, then arguments. Unknown names raise."""
    known = {f.name for f in fields(Thresholds)}
    if unknown := set(arguments) - known:
        raise ValueError(f"unknown thresholds: {', '.join(sorted(unknown))}")
    return replace(DEFAULTS, **((from_tree(_parsed(path)) if path else {}) | arguments))


def load_context(path: str | None = None, **arguments) -> Context:
    """What a run is about, from a YAML file on the driver and arguments, which win. Unknown names raise."""
    found = (_parsed(path) if path else {}) | arguments
    known = {f.name for f in fields(Context)}
    if unknown := set(found) - known:
        raise ValueError(f"unknown keys of a context: {', '.join(sorted(unknown))}")
    return Context(**{k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if v is not None})
