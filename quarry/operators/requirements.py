"""What a table asks for: cardinalities, spreads and skews that decide which transformations are made."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Thresholds
from ..functions.scalars import sample_skewness
from .profile import by_column, numeric_columns, value_counts


@dataclass(frozen=True)
class Requirements:
    """Columns by the transformation that they ask for."""

    binary: list[str] = field(default_factory=list)
    one_hot: list[str] = field(default_factory=list)
    label: list[str] = field(default_factory=list)
    scale: list[str] = field(default_factory=list)
    skewed: list[str] = field(default_factory=list)
    times: list[str] = field(default_factory=list)
    groups: list[str] = field(default_factory=list)
    interactions: bool = False

    @property
    def encode(self) -> list[str]:
        return [*self.binary, *self.one_hot, *self.label]


def cardinalities(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Distinct values (without null) of several columns, from one grouped pass."""
    if not columns:
        return {}
    found = {r["column"]: r["n"] for r in value_counts(df, columns).groupBy("column").agg(F.count("*").alias("n")).collect()}  # one row a column
    return {c: found.get(c, 0) for c in columns}


def requirements(df: DataFrame, cfg: Thresholds = DEFAULTS, least_values: int = 3) -> Requirements:
    """Text columns of 2, of up to one_hot_most and of up to encode_most values are encoded in one of three ways; numbers that spread far are scaled,
    skewed ones logged. Columns that are encodings, scalings or logs already are left alone."""
    kinds = dict(df.dtypes)
    texts = [c for c in df.columns if kinds[c] == "string"]
    distinct = cardinalities(df, texts)
    numbers = [c for c in numeric_columns(df) if not c.endswith("_encoded")]
    stats = {}
    if numbers:
        d = lambda f: lambda c: f(c.cast("double"))
        stats = {r["column"]: r for r in by_column(df, numbers, {"n": F.count, "std": d(F.stddev_samp), "lo": d(F.min), "hi": d(F.max), "skew": d(sample_skewness)}).collect()}  # one row a column
    far = lambda s: (s["std"] or 0) > cfg.scale_std or s["n"] and s["hi"] - s["lo"] > cfg.scale_range
    return Requirements(
        binary=[c for c in texts if distinct[c] == 2],
        one_hot=[c for c in texts if 2 < distinct[c] <= cfg.one_hot_most],
        label=[c for c in texts if cfg.one_hot_most < distinct[c] <= cfg.encode_most],
        scale=[c for c in numbers if far(stats[c])],
        skewed=[c for c in numbers if not c.endswith(("_std", "_norm")) and stats[c]["n"] >= least_values and abs(stats[c]["skew"] or 0) > cfg.skew],
        times=[c for c in df.columns if kinds[c] == "date" or kinds[c].startswith("timestamp")],
        groups=[c for c in texts if cfg.group_least <= distinct[c] <= cfg.group_most],
        interactions=len(numbers) >= 2,
    )
