"""Exact percentiles by narrowing, and medians of groups by running counts: no task ever holds the values of a column or group.

A sketch gives two values between which a wanted rank must lie; counting what lies below and between them proves it. While much lies between, the
sketch is taken again of that part alone; each time it shrinks several thousandfold. The few values that are left are counted
and ranked. Every step is one aggregate over the table, in which partitions are combined before the shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranked

#: Accuracy of the sketches, and values between two bounds that are ranked directly.
ACCURACY, FEW = 10_000, 20_000


@dataclass
class Wanted:
    """A rank of a column that is looked for: the values lo to hi (None: no bound) hold ranks k and k + 1, and below come before lo."""

    column: str
    place: float
    n: int
    lo: float | None = None
    hi: float | None = None
    below: int = 0
    inside: int = 0

    @property
    def k(self) -> int:
        return math.floor(self.place * (self.n - 1))

    @property
    def next(self) -> int:
        return math.ceil(self.place * (self.n - 1))

    @property
    def closed(self) -> bool:
        """All values within the bounds are equal."""
        return self.lo is not None and (self.lo == self.hi or math.isnan(self.lo))

    def within(self, x: Column) -> Column:
        out = x.isNotNull()
        if self.lo is not None:
            out = out & (x >= F.lit(self.lo))
        return out if self.hi is None else out & (x <= F.lit(self.hi))


def percentiles(df: DataFrame, columns: list[str], places: list[float], accuracy: int = ACCURACY, few: int = FEW) -> dict[str, list[float | None]]:
    """Of each column the percentiles at places of 0 to 1 (interpolated between neighbours); null where it has no value. NaN is the largest value.

    Reads df about four times, and once more for every factor of accuracy / 4 by which its rows exceed accuracy * few; hand in a stored table if df is dear.
    """
    x = {c: F.col(f"`{c}`").cast("double") for c in columns}
    counts = df.agg(*[F.count(v).alias(f"_{i}") for i, v in enumerate(x.values())]).first()
    wanted = [Wanted(c, p, counts[i], inside=counts[i]) for i, c in enumerate(columns) for p in places if counts[i]]
    margin = 2.0
    while wide := [w for w in wanted if w.inside > few and not w.closed]:
        around = lambda w, rank, by: min(1.0, max(0.0, (rank - w.below) / w.inside + by * margin / accuracy))
        sketch = df.agg(*[F.percentile_approx(F.when(w.within(x[w.column]), x[w.column]), F.array(F.lit(around(w, w.k, -1)), F.lit(around(w, w.next + 1, 1))), F.lit(accuracy)).alias(f"_{i}") for i, w in enumerate(wide)]).first()
        tries = [Wanted(w.column, w.place, w.n, *sketch[i]) for i, w in enumerate(wide)]
        found = df.agg(*[f.alias(f"_{k}{i}") for i, t in enumerate(tries) for k, f in (("b", F.count(F.when(x[t.column] < F.lit(t.lo), 1))), ("i", F.count(F.when(t.within(x[t.column]), 1))))]).first()
        shrunk = False
        for i, (w, t) in enumerate(zip(wide, tries, strict=True)):
            below, inside = found[f"_b{i}"], found[f"_i{i}"]
            if below <= w.k and w.next < below + inside and (inside < w.inside or t.closed):
                w.lo, w.hi, w.below, w.inside = t.lo, t.hi, below, inside
                shrunk = True
        margin *= 1 if shrunk else 10  # the sketch missed: ask for more room
        if margin > accuracy:
            break
    out = {c: [None] * len(places) for c in columns}
    for (column, place), value in ranked_values(df, wanted, x).items():
        out[column] = [value if p == place else v for p, v in zip(places, out[column], strict=True)]
    return out


def ranked_values(df: DataFrame, wanted: list[Wanted], x: dict[str, Column]) -> dict[tuple[str, float], float]:
    """The percentile of each, from the values between its bounds."""
    out = {(w.column, w.place): w.lo for w in wanted if w.closed}
    rest = [w for w in wanted if (w.column, w.place) not in out]
    if not rest:
        return out
    cells = [F.when(w.within(x[w.column]), F.struct(F.lit(i).alias("i"), x[w.column].alias("x"))) for i, w in enumerate(rest)]
    n = df.select(F.explode(F.array_compact(F.array(*cells))).alias("c")).groupBy("c.i", "c.x").agg(F.count("*").alias("n"))
    number = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("i") + 1)
    until = F.sum("n").over(Window.partitionBy("i").orderBy("x")) + number([w.below for w in rest])
    near = n.withColumn("until", until).where((F.col("until") > number([w.k for w in rest])) & (F.col("until") - F.col("n") <= number([w.next for w in rest])))
    values: dict[int, list] = {}
    for r in near.orderBy("i", "x").collect():  # one or two rows each
        values.setdefault(r["i"], []).append(r)
    for i, w in enumerate(rest):
        at = lambda k: next(r["x"] for r in values[i] if r["until"] > k)  # noqa: B023, E731
        lower, upper, position = at(w.k), at(w.next), w.place * (w.n - 1)
        out[w.column, w.place] = lower if lower == upper else (w.next - position) * lower + (position - w.k) * upper
    return out


def percentile_table(df: DataFrame, columns: list[str], places: dict[str, float], **options) -> DataFrame:
    """(column, a column for each named place): one row a column."""
    found = percentiles(df, columns, list(places.values()), **options)
    schema = "column string, " + ", ".join(f"`{k}` double" for k in places)
    return df.sparkSession.createDataFrame([(c, *found[c]) for c in columns], schema).coalesce(1)


def group_medians(df: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """The median of value in each group (nulls in groups are left out), whatever the groups' sizes.

    Values are counted by group, and the counts summed up in buckets of the order by group and value. Where its group's middle ranks fall,
    a value is taken; a large group is spread over many buckets.
    """
    full = df.where(F.col(f"`{value}`").isNotNull())
    for g in groups:
        full = full.where(F.col(f"`{g}`").isNotNull())
    counts = full.groupBy(*groups, F.col(f"`{value}`").cast("double").alias("_value")).agg(F.count("*").alias("_n"))
    rows = ranked.before(counts, [*groups, "_value"], F.col("_n"), "_below")
    starts = rows.groupBy(groups).agg(F.min("_below").alias("_start"), F.sum("_n").alias("_all"))
    rank = F.col("_below") - F.col("_start")
    lower, upper = F.floor((F.col("_all") - 1) / 2), F.ceil((F.col("_all") - 1) / 2)
    holds = lambda k: (rank <= k) & (k < rank + F.col("_n"))
    near = rows.join(starts, groups).where(holds(lower) | holds(upper))
    return near.groupBy(groups).agg((0.5 * F.max(F.when(holds(lower), F.col("_value"))) + 0.5 * F.max(F.when(holds(upper), F.col("_value")))).alias(name))
