"""Semantic types of columns, canonical names and sampling."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DATE_FORMATS, iso_time, parse_number, time_by
from . import ranked

# Types in the order that settles ties, pairs of truth values, words of places, forms of ids, marks of currency.
TYPES = ["numeric", "integer", "float", "datetime", "boolean", "categorical", "geographic", "id", "currency", "text"]
BOOLEAN_SETS = [["true", "false"], ["1", "0"], ["yes", "no"], ["y", "n"], ["t", "f"], ["1.0", "0.0"]]
PLACES = ["district", "state", "city", "village", "mandal", "tehsil", "block", "ward", "constituency", "pincode", "zip"]
ID_PATTERNS = [r"^\d+$", r"^[A-Z]+\d+$", r"^\d+[A-Z]+\d*$", r"^[A-Z0-9]+$"]
PLACE_SHARE = 0.05  # of the values hold a word of places, if it counts: one of twenty
CURRENCY_MARKS = ["₹", r"\$", r"rs\.?", "inr", "crore", "lakh"]


def type_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, distinct_share, scores by type, type, confidence): all detectors of all columns, over all rows.

    Values are counted by column first; each distinct one is looked at once, with its count as weight. The best score wins, ties by the order of TYPES,
    and below 0.6 a column is text. A column of nulls is unknown with confidence 0. Times are the 12 formats and ISO 8601; a number is no time but for a
    year of four digits. A word of places counts if PLACE_SHARE of the values hold it, so that types don't hang on the size of a table.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("s")) for c in columns]))
    counts = df.select(pairs.alias("p")).select("p.*").where("s is not null").groupBy("column", "s").agg(F.count("*").alias("w"))
    s, w = F.col("s"), F.col("w")
    low = F.lower(F.trim(s))
    parts = {"x": parse_number(s), "low": low, "said": F.when(~low.isin("nan", "none", ""), low), "bare": parse_number(F.regexp_replace(s, r"[₹$,\s]", ""))}
    parts |= {f"time{i}": t.isNotNull() for i, t in enumerate([*[time_by(s, f) for f in DATE_FORMATS], iso_time(s)])}
    parts |= {f"id{i}": s.rlike(p) for i, p in enumerate(ID_PATTERNS)} | {f"mark{i}": s.rlike(f"(?i){p}") for i, p in enumerate(CURRENCY_MARKS)}
    x, n = F.col("x"), F.sum("w")
    share = lambda cond: F.coalesce(F.try_divide(F.sum(F.when(cond, w)).cast("double"), n.cast("double")), F.lit(0.0))
    of_numbers = lambda cond: F.coalesce(F.try_divide(F.sum(F.when(cond, w)).cast("double"), F.sum(F.when(x.isNotNull(), w)).cast("double")), F.lit(0.0))
    sums = {
        "n": n, "values": F.count("*"), "numeric": share(x.isNotNull()), "whole": share(x == F.floor(x)), "broken": share(x != F.floor(x)),
        "latitude": of_numbers(x.between(-90, 90)), "longitude": of_numbers(x.between(-180, 180)), "amount": share(F.col("bare").isNotNull()),
        "time": F.greatest(*[share(F.col(p)) for p in parts if p.startswith("time")]), "form": F.greatest(*[share(F.col(p)) for p in parts if p.startswith("id")]),
        "mark": F.greatest(*[share(F.col(p)) for p in parts if p.startswith("mark")]),
        "boolean": F.greatest(*[F.coalesce(F.min(F.col("said").isin(p).cast("double")), F.lit(0.0)) for p in BOOLEAN_SETS]),
        "places": sum((share(F.col("low").contains(p)) >= PLACE_SHARE).cast("int") for p in PLACES),
    }
    found = counts.select("column", "s", "w", *[v.alias(k) for k, v in parts.items()]).groupBy("column").agg(*[v.alias(k) for k, v in sums.items()])
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string").coalesce(1)
    found = every.join(found, "column", "left")
    distinct = F.try_divide(F.col("values").cast("double"), F.col("n").cast("double"))
    numeric = F.col("numeric")
    scores = {
        "numeric": numeric,
        "integer": F.when(numeric >= 0.8, F.col("whole")),
        "float": F.when(numeric >= 0.8, F.col("broken")),
        "datetime": F.col("time"),
        "boolean": F.col("boolean"),
        "categorical": F.when((distinct < 0.1) & (F.col("values") > 1), 1 - distinct),
        "geographic": F.when((numeric > 0.8) & ((F.col("latitude") > 0.8) | (F.col("longitude") > 0.8)), 0.9).otherwise(F.least(F.lit(0.8), 0.3 * F.col("places"))),
        "id": F.when(distinct >= 0.95, distinct * F.col("form")),
        "currency": F.greatest("mark", "amount"),
        "text": F.lit(0.3),
    }
    rows = found.select("column", F.coalesce("n", F.lit(0)).alias("n"), distinct.alias("distinct_share"), *[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in scores.items()])
    best = F.greatest(*TYPES)
    kind = None
    for k in TYPES:
        kind = F.when(F.col(k) == best, k) if kind is None else kind.when(F.col(k) == best, k)
    return rows.withColumns({"type": F.when(F.col("n") == 0, "unknown").when(best < 0.6, "text").otherwise(kind), "confidence": F.when(F.col("n") == 0, 0.0).otherwise(best)})


# Aliases of column names and the names that they stand for.
ALIASES = {
    "dist": "district", "district_name": "district", "district_id": "district",
    "mandal_name": "mandal", "mandal_id": "mandal", "sub_district": "mandal",
    "village_name": "village", "village_id": "village", "gram_panchayat": "village",
    "reg_date": "date", "registration_date": "date", "created_date": "date",
    "fin_year": "year", "financial_year": "year", "fy": "year",
    "total_count": "total", "count": "total", "number": "total", "qty": "total",
    "amount_rs": "amount", "amount_inr": "amount", "value_rs": "amount",
}
# Words of column names that hint at a kind of column.
HINTS = {
    "geographic": ["district", "mandal", "village", "zone", "area", "region", "location"],
    "temporal": ["date", "time", "year", "month", "quarter", "period"],
    "metric": ["count", "total", "amount", "value", "rate", "percent", "number"],
    "identifier": ["id", "code", "number", "ref", "key"],
}


def domain_hint(name: str, kind: str) -> str | None:
    """The hint of a column's name, for a kind of type_scores: places in text, times in text or datetimes, metrics in numbers; an id wins over all."""
    low, fits = name.lower(), {"geographic": ("text", "categorical", "geographic"), "temporal": ("text", "datetime"), "metric": ("numeric", "integer", "float")}
    found = [h for h, words in HINTS.items() if any(w in low for w in words) and kind in fits.get(h, (kind,))]
    return found[-1] if found else None


def canonical_name(name: str, aliases: dict[str, str] | None = None) -> str:
    """Snake case without symbols; an alias (see ALIASES) wins; names that are empty or start with a digit get a prefix."""
    if aliases and name.lower() in aliases:
        return aliases[name.lower()]
    out = re.sub(r"[^A-Za-z0-9\s_]", "", name)
    out = re.sub(r"_+", "_", re.sub(r"\s+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", out)).lower()).strip("_")
    return f"col_{out}" if not out or out[0].isdigit() else out


def rename_canonical(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Renames to canonical names; clashes get _1, _2 and so on."""
    used, out = set(), []
    for c in df.columns:
        name, i = canonical_name(c, aliases), 0
        while (new := f"{name}_{i}" if i else name) in used:
            i += 1
        used.add(new)
        out.append(F.col(f"`{c}`").alias(new))
    return df.select(out)


def systematic_sample(df: DataFrame, order: str, n: int) -> DataFrame:
    """Every k-th row of the order, k = rows // n. Row numbers are counted by buckets of the order, not in one global window."""
    rows = df.count()
    step = max(1, rows // n)
    return numbered(df, order).where(F.col("_row_id") % step == 0).drop("_row_id")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds _row_id: 0, 1, 2... in the order of columns, nulls first."""
    return ranked.before(df, list(order), F.lit(1), "_row_id")


def positional_sample(df: DataFrame, order: str, n: int) -> DataFrame:
    """n // 3 rows from the start, the middle and the end of the order; all rows if there are at most n."""
    rows = df.count()
    if rows <= n:
        return df
    k, i = n // 3, F.col("_row_id")
    mid = rows // 2 - k // 2
    return numbered(df, order).where((i < k) | ((i >= mid) & (i < mid + k)) | (i >= rows - k)).drop("_row_id")


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """About n rows, as many of each stratum, in hash order of the key. A sampling operator: n is its purpose."""
    groups = df.select(stratum).distinct().count()
    each = max(1, n // max(1, groups))
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), key), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= each).drop("_r")
