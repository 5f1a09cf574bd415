"""Running sums and row numbers over a whole table: a sample sort with buckets.

A sample of whole sort keys gives the edges of buckets that hold about as many rows each. Edges are read once and are
literals in the plan, so every branch of it sees the same buckets. Each bucket is one window, and the sums of the
buckets before it are its offset. Only one row a bucket meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled rows for each bucket: a bucket's size then stays within about a third of the mean.
SAMPLED = 60


def comparable(df: DataFrame, c: str) -> Column:
    """The column as a number, text or bytes in the same order, so that its values can be read and written back as literals."""
    kind, x = dict(df.dtypes)[c], F.col(f"`{c}`")
    if kind == "date":
        return F.unix_date(x)
    if kind == "timestamp":
        return F.unix_micros(x)
    if kind == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', `{c}`)")
    return x


def edges(df: DataFrame, keys: list[Column], buckets: int) -> tuple[list[tuple], list[str]]:
    """The keys at which each bucket but the first begins, from a sample of rows, and the keys' types."""
    at = df.select(*[k.alias(f"_{i}") for i, k in enumerate(keys)])
    kinds = [k for _, k in at.dtypes]
    rows, wanted = at.count(), SAMPLED * buckets
    if buckets < 2 or rows < 2:
        return [], kinds
    if rows > 2 * wanted:
        at = at.sample(fraction=wanted / rows, seed=17)
    found = [tuple(r) for r in at.orderBy(*at.columns).collect()]  # about SAMPLED rows a bucket
    return list(dict.fromkeys(found[i * len(found) // buckets] for i in range(1, buckets))) if found else [], kinds


def bucket(df: DataFrame, keys: list[Column], buckets: int | None = None) -> Column:
    """Index of the row's bucket in ascending order of keys, nulls first; as many buckets as shuffle partitions if nothing else is said."""
    cuts, kinds = edges(df, keys, buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = F.struct(*[k.alias(f"_{i}") for i, k in enumerate(keys)])
    edge = [F.struct(*[F.lit(v).cast(kind).alias(f"_{i}") for i, (v, kind) in enumerate(zip(cut, kinds, strict=True))]) for cut in cuts]

    def search(lo: int, hi: int) -> Column:
        """Edges at or below the key, of which at least lo and at most hi are known to be: a binary search as nested conditions."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(own < edge[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(edge))


def before(df: DataFrame, order: list[str], amount: Column, name: str, ties: list[str] | None = None) -> DataFrame:
    """Adds the sum of amount over all rows before this one, in ascending order of columns, nulls first.

    ties: columns by which rows that are equal in order are spread over buckets and follow each other; without them, rows that tie in all of order share a
    bucket and follow each other in any order.
    """
    b, a, o = (f"_{k}_{name}" for k in ("bucket", "amount", "offset"))
    columns = [*order, *(ties or [])]
    rows = df.withColumns({b: bucket(df, [comparable(df, c) for c in columns]), a: amount})
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(b).agg(F.sum(a).alias(a))
    sums = sums.select(b, F.coalesce(F.sum(a).over(until(Window.orderBy(b))), F.lit(0)).alias(o))  # one row a bucket
    inside = F.coalesce(F.sum(a).over(until(Window.partitionBy(b).orderBy(*[F.col(f"`{c}`") for c in columns]))), F.lit(0))
    return rows.withColumn(name, inside).join(F.broadcast(sums), b).withColumn(name, F.col(name) + F.col(o)).select(*[F.col(f"`{c}`") for c in df.columns], name)
