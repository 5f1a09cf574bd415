"""Units by column names: money, shares and times written as text, truth words and blanks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import FALSE_WORDS, TRUE_WORDS, UNIT_NAMES, boolean_text, collapse_blanks, parse_time, strip_currency, strip_percent
from .profile import numeric_columns


def units_of(name: str) -> list[str]:
    """The units that a column's name speaks of, in the order in which they are applied."""
    return [unit for unit, pattern in UNIT_NAMES.items() if re.match(pattern, name.lower())]


def normalized_units(df: DataFrame) -> tuple[DataFrame, list[dict]]:
    """Columns named after money, percent or times as numbers, shares and timestamps, and a log of what was done.

    Money and percent in text lose their marks; what is no number then is null. Numbers named after percent are divided by 100 if the largest
    is above 1 and at most 100 (one aggregate for all of them). Text named after times is parsed.
    """
    kinds, numeric = dict(df.dtypes), set(numeric_columns(df))
    shares = [c for c in df.columns if c in numeric and "percent" in units_of(c)]
    largest = df.agg(F.lit(0), *[F.max(F.col(f"`{c}`").cast("double")) for c in shares]).first()  # one row
    top, new, log = dict(zip(shares, largest[1:], strict=True)), {}, []
    for c in df.columns:
        for unit in units_of(c):
            x = F.col(f"`{c}`")
            if kinds[c] == "string" and c not in new:
                new[c] = {"currency": strip_currency, "percent": strip_percent, "date": parse_time}[unit](x)
            elif unit == "percent" and c in numeric and top[c] is not None and 1 < top[c] <= 100:
                new[c] = x.cast("double") / 100
            else:
                continue
            log.append({"column": c, "unit": unit})
    return df.withColumns(new), log


def normalized_text(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Text columns without blanks at their ends and in runs; in those that hold a truth word, all truth words as True and False. And the latter columns."""
    texts = [c for c, k in df.dtypes if k == "string"]
    word = lambda c: F.lower(F.trim(F.col(f"`{c}`"))).isin(TRUE_WORDS + FALSE_WORDS)
    any_word = df.agg(F.lit(0), *[F.max(word(c).cast("int")) for c in texts]).first()  # one row
    truths = [c for i, c in enumerate(texts, 1) if any_word[i]]
    new = {c: collapse_blanks(boolean_text(F.col(f"`{c}`")) if c in truths else F.col(f"`{c}`")) for c in texts}
    return df.withColumns(new), truths
