"""Windows over one order of a whole table: buckets of the order, each with a halo of the rows that stand before it.

Every bucket is one window. The last rows of each bucket are handed to the buckets after it, as many as the widest frame
reaches back, and of each column the last value before the bucket goes along. Only a few rows a bucket meet anywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import ranked


def reaching_back(sizes: dict[int, int], halo: int) -> list[tuple[int, int, int]]:
    """(source, target, rows): how many last rows of which bucket a bucket needs, so that it sees the `halo` rows before it."""
    out, held = [], []  # buckets so far, the nearest first, with their sizes
    for b in sorted(sizes):
        missing = halo
        for source, n in held:
            if missing <= 0:
                break
            out.append((source, b, min(n, missing)))
            missing -= n
        held.insert(0, (b, sizes[b]))
        while len(held) > 1 and sum(n for _, n in held[:-1]) >= halo:
            held.pop()
    return out


class Ordered:
    """A table in the order of a column (nulls last), ties by key, cut into buckets with halos. window: the frame's order inside a bucket."""

    def __init__(self, df: DataFrame, by: str, key: str, halo: int, carried: list[str], buckets: int | None = None):
        """carried: numeric columns of which the last value (not null) before each bucket is known in it, as carry(column)."""
        self.columns = df.columns
        self.bucket, self.late, self.extra, self.place, self.target, self.take = self._free(df, "bucket", "late", "extra", "place", "target", "take")
        late = F.col(f"`{by}`").isNull()
        rows = df.withColumn(self.late, late)
        rows = rows.withColumn(self.bucket, ranked.bucket(rows, [late, ranked.comparable(df, by), ranked.comparable(df, key)], buckets))
        self.order = [F.col(self.late), F.col(f"`{by}`"), F.col(f"`{key}`")]
        place = F.row_number().over(Window.partitionBy(self.bucket).orderBy(*[F.desc(self.late), F.desc_nulls_last(by), F.desc_nulls_last(key)]))
        sizes = {r[0]: r[1] for r in rows.groupBy(self.bucket).count().collect()}  # one row a bucket
        spread = df.sparkSession.createDataFrame(reaching_back(sizes, halo) or [(-1, -1, 0)], f"{self.bucket} int, {self.target} int, {self.take} int")
        last = rows.withColumn(self.place, place).where(F.col(self.place) <= halo)
        last = last.join(F.broadcast(spread), self.bucket).where(F.col(self.place) <= F.col(self.take))
        last = last.drop(self.bucket, self.place, self.take).withColumnRenamed(self.target, self.bucket).withColumn(self.extra, F.lit(True))
        self.rows = rows.withColumn(self.extra, F.lit(False)).unionByName(last)
        if carried:
            at = F.struct(*self.order)
            lasts = rows.groupBy(self.bucket).agg(*[F.max_by(F.col(f"`{c}`").cast("double"), F.when(F.col(f"`{c}`").isNotNull(), at)).alias(self.carry_name(c)) for c in carried])
            back = Window.orderBy(self.bucket).rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
            lasts = lasts.select(self.bucket, *[F.last(self.carry_name(c), ignorenulls=True).over(back).alias(self.carry_name(c)) for c in carried])
            self.rows = self.rows.join(F.broadcast(lasts), self.bucket, "left")

    @staticmethod
    def _free(df: DataFrame, *names: str) -> list[str]:
        taken = {c.lower() for c in df.columns}
        return [next(x for i in range(len(taken) + 1) if (x := f"{'_' * (i + 1)}{n}") not in taken) for n in names]

    def carry_name(self, c: str) -> str:
        return f"_carried_{c}"

    def carry(self, c: str) -> Column:
        return F.col(f"`{self.carry_name(c)}`")

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(self.bucket).orderBy(*self.order)

    def finished(self, new: dict[str, Column]) -> DataFrame:
        """The table with new columns, computed over window."""
        return self.rows.withColumns(new).where(~F.col(self.extra)).select(*[F.col(f"`{c}`") for c in self.columns if c not in new], *new)
