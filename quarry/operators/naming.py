"""Canonical names of columns: aliases, ordered patterns by domain, cleaned names; renaming and casting by a mapping."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from .detect import ALIASES, domain_hint
from .profile import numeric_columns
from .summary import cast_report, safe_cast

# Patterns of lower-cased names, anchored at the start, and the names they stand for; the first that fits counts.
PATTERNS = [
    (r".*dist.*name.*|.*district.*", "district"),
    (r".*mandal.*name.*|.*sub.*dist.*", "mandal"),
    (r".*village.*name.*|.*gram.*", "village"),
    (r".*reg.*date.*|.*registration.*date.*", "registration_date"),
    (r".*created.*date.*|.*entry.*date.*", "created_date"),
    (r".*fin.*year.*|.*financial.*year.*", "financial_year"),
    (r".*total.*count.*|.*count.*total.*", "total_count"),
    (r".*amount.*rs.*|.*amount.*inr.*", "amount_inr"),
    (r".*per.*capita.*|.*per.*1000.*", "per_capita"),
    (r".*application.*id.*|.*app.*id.*", "application_id"),
    (r".*beneficiary.*id.*|.*ben.*id.*", "beneficiary_id"),
]
# Further patterns of a domain, sought after the others.
DOMAIN_PATTERNS = {
    "transport": [(r".*vehicle.*reg.*|.*registration.*no.*", "vehicle_registration"), (r".*license.*no.*|.*dl.*no.*", "license_number"), (r".*vehicle.*type.*|.*category.*", "vehicle_category")],
    "health": [(r".*patient.*id.*|.*patient.*no.*", "patient_id"), (r".*hospital.*name.*|.*facility.*", "facility_name"), (r".*diagnosis.*|.*disease.*", "diagnosis")],
    "education": [(r".*student.*id.*|.*enrollment.*", "student_id"), (r".*school.*name.*|.*institution.*", "school_name"), (r".*class.*|.*grade.*|.*std.*", "class_grade")],
}
# Words in column names by which columns of a role are found, in the order in which they are sought.
ROLES = {
    "geographic": ["district", "state", "city", "region", "location", "area", "zone", "mandal", "tehsil"],
    "chart": ["district", "region", "state", "city", "area", "zone", "mandal", "tehsil"],
    "entity": ["area", "district", "region", "zone", "division", "mandal", "block", "village"],
    "kpi_time": ["year", "date", "time"],
    "time": ["year", "month", "date", "time"],
    "denominator": ["population", "households", "families"],
}


def suggested_name(name: str, domain: str | None = None, aliases: dict[str, str] = ALIASES) -> tuple[str, str]:
    """(canonical name, rule): by alias, by the first pattern that fits (those of all domains, then the domain's own), else the name cleaned."""
    low = name.lower().strip()
    if low in aliases:
        return aliases[low], "alias"
    found = next((name for pattern, name in [*PATTERNS, *DOMAIN_PATTERNS.get(domain or "", [])] if re.match(pattern, low)), low)
    if found != low:
        return found, "pattern"
    cleaned = re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "", name)).lower().strip("_")
    return cleaned or name, "cleaned"


def columns_for(df: DataFrame, role: str) -> list[str]:
    """The columns whose names speak of a role (see ROLES), case aside, in their order.

    Entities are text columns of more than one value, denominators numbers with a sum above 0; one aggregate decides.
    """
    kinds, named = dict(df.dtypes), [c for c in df.columns if any(w in c.lower() for w in ROLES[role])]
    if role == "entity":
        named = [c for c in named if kinds[c] == "string"]
        keeps = lambda c: F.min(f"`{c}`") < F.max(f"`{c}`")
    elif role == "denominator":
        named = [c for c in named if c in numeric_columns(df)]
        keeps = lambda c: F.sum(F.col(f"`{c}`").cast("double")) > 0
    else:
        return named
    kept = df.agg(F.lit(0), *[keeps(c) for c in named]).first()  # one row
    return [c for i, c in enumerate(named, 1) if kept[i]]


@dataclass(frozen=True)
class Named:
    """What is proposed for a column."""

    original: str
    canonical: str
    kind: str
    confidence: float
    rule: str
    hint: str | None = None


def mapping(types: list[tuple[str, str, float]], domain: str | None = None, aliases: dict[str, str] = ALIASES) -> list[Named]:
    """Proposals for columns from (column, type, confidence), as type_scores() finds them.

    A name that says what kind of column it is (see domain_hint) adds 0.1 to the confidence, up to 0.9; that a column is an id does not.
    """
    out = []
    for c, kind, confidence in types:
        hint = domain_hint(c, kind)
        name, rule = suggested_name(c, domain, aliases)
        out.append(Named(c, name, kind, min(0.9, confidence + 0.1) if hint not in (None, "identifier") else confidence, rule, hint))
    return out


def proposal_for(column: str, proposals: list[Named]) -> Named | None:
    """The first proposal whose original or canonical name is that of a column, which may be renamed already."""
    return next((p for p in proposals if column in (p.canonical, p.original)), None)


def renamed(df: DataFrame, proposals: list[Named], least: float = DEFAULTS.type_confidence) -> tuple[DataFrame, list[dict]]:
    """Canonical names where the confidence exceeds least, and a log of them. A name in use gets _1, _2 and so on."""
    by_name, used, new, log = {p.original: p for p in proposals}, set(df.columns), {}, []
    for c in df.columns:
        p = by_name.get(c)
        if p is None or p.canonical == c or p.confidence <= least:
            continue
        name, i = p.canonical, 0
        while name in used:
            i += 1
            name = f"{p.canonical}_{i}"
        used.add(name)
        new[c] = name
        log.append({"original": c, "canonical": name, "confidence": p.confidence, "rule": p.rule})
    return df.select(*[F.col(f"`{c}`").alias(new.get(c, c)) for c in df.columns]), log


#: Types of type_scores() as kinds of safe_cast(); others stay as they are.
CASTS = {"numeric": "numeric", "integer": "integer", "float": "float", "datetime": "datetime", "boolean": "boolean"}


def converted(df: DataFrame, proposals: list[Named], least: float = DEFAULTS.type_confidence) -> tuple[DataFrame, DataFrame]:
    """Text columns cast to their proposed types where the confidence exceeds least, and the report of cast_report().

    Columns may bear their original or their canonical names.
    """
    kinds = {}
    for c, kind in df.dtypes:
        p = proposal_for(c, proposals)
        if kind == "string" and p is not None and p.confidence > least and p.kind in CASTS:
            kinds[c] = CASTS[p.kind]
    return safe_cast(df, kinds), cast_report(df, kinds)
