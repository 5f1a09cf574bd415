"""Column functions: parsing, cleaning of text, safe arithmetic, moments with sample correction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date formats of the type detector and of date parsing, tried in this order.
DATE_FORMATS = ["yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "yyyy-M-d H:m:s", "d-M-yyyy", "yyyy/M/d", "d.M.yyyy", "yyyy", "M/yyyy", "d-MMM-yyyy", "d MMMM yyyy", "MMMM d, yyyy"]
ISO_TIME = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"
TRUE_WORDS, FALSE_WORDS = ["yes", "y", "true", "1", "on", "enabled"], ["no", "n", "false", "0", "off", "disabled"]


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def parse_number(c: Column) -> Column:
    """Double from text; null for what is no plain decimal or scientific number (no hex, no type suffix)."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def time_by(c: Column, pattern: str) -> Column:
    """Timestamp from text by one pattern, null if it does not fit; a year alone has four digits."""
    c = F.when(c.rlike(r"^\d{4}$"), c) if pattern == "yyyy" else c
    return F.try_to_timestamp(c, F.lit(pattern))


def iso_time(c: Column) -> Column:
    return F.when(c.rlike(ISO_TIME), F.try_to_timestamp(c))


def parse_time(c: Column) -> Column:
    """Timestamp without zone from text, by the first pattern that fits, then as ISO 8601; null if none does."""
    c = c.cast("string")
    return F.coalesce(*[time_by(c, f) for f in DATE_FORMATS], iso_time(c)).cast("timestamp_ntz")


def strip_currency(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9.]", "").try_cast("double")


def strip_percent(c: Column) -> Column:
    return F.regexp_replace(c, "%", "").try_cast("double") / 100


def collapse_blanks(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\s+", " ")


def boolean_text(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin(TRUE_WORDS), "True").when(t.isin(FALSE_WORDS), "False").otherwise(c)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def sample_skewness(c: Column) -> Column:
    n = F.count(c)
    return F.when((n >= 3) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2, F.lit(0)))


def sample_kurtosis(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.when((n >= 4) & (F.stddev_pop(c) > 0), F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def redact_pii(c: Column) -> Column:
    """E-mail addresses, 12-digit ids and phone numbers replaced by tags, in that order."""
    c = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]")
    c = F.regexp_replace(c, r"\b\d{4}[ -]?\d{4}[ -]?\d{4}\b", "[ID]")
    return F.regexp_replace(c, r"\+?\d[\d ()-]{8,14}\d", "[PHONE]")


# Patterns of lower-cased column names whose values are money, shares or times.
UNIT_NAMES = {"currency": r".*(?:rs|rupees|inr).*", "percent": r".*(?:percent|%|pct).*", "date": r".*(?:date|time).*"}
