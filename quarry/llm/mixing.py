"""Operator 4, mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_names, scratch, stored, words_of

#: Documents a bucket of the shuffled order holds on average; running sums inside a bucket are one window each.
BUCKET_ROWS = 5_000
#: Stands for a null source, which comes after all others.
AFTER_ALL = "\U0010ffff" * 4


def targets(sizes: DataFrame, weights, share: float, most: int) -> DataFrame:
    """Targets per source from (source, source_size): adds weight and target (double).

    Sources in code point order, null last, take the weights in turn. share times all sizes is dealt by weight; a
    source stops at most times its size and its excess is dealt again. That is one level of filling: with sources
    sorted by the level at which they are full, the level with the first k of them full rises with k until the
    next is no longer full and falls after that, so it is the largest. One row a source: small windows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    out = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place))
    cap = most * F.col("source_size")
    below = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    total = lambda x, over: F.coalesce(F.sum(x).over(over), F.lit(0))
    level = (share * total("source_size", whole) - total(cap, below)) / (total("weight", whole) - total("weight", below))
    out = out.withColumn("_level", level).withColumn("_level", F.max("_level").over(whole))
    return out.select("source", "source_size", "weight", F.least(cap.cast("double"), F.col("_level") * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=(3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """The input's columns with size, source_size (long), target (double), finish, served (arrays, one entry a pass), taken (long).

    Weighted fair queueing: each source's documents stand in a hash-shuffled order, most passes over; a document's
    virtual finish time is the running size of its source over the source's target. All passes of all documents are
    range-sorted by finish time and truncated at the budget, all targets together: what is before the cut
    is served whole, the pass at the cut as far as the budget goes (served, in words). Running sums have two levels, of
    documents within a bucket of hashes or a range of times, and of the totals before it, so a source that holds most rows
    is no single task.
    Null text has size 0 and takes 0. Null sources are one source, the last. Equal hashes go by id, then size; rows
    equal in all are interchangeable, and equal finish times go by source. The order hangs on ids and seed only, so reruns agree.
    Input columns with the names of new ones are replaced, all others pass through. An empty table gives none.
    """
    with scratch(docs.sparkSession) as keep:
        out, *tables = queued(docs, doc_id, text, source, weights, share, most, seed)
        keep(*tables)
    new = dict(zip(["size", "source_size", "target", "finish", "served", "taken"], out.columns[len(docs.columns) :], strict=True))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new], *[F.col(c).alias(name) for name, c in new.items()])


def queued(docs: DataFrame, doc_id: str, text: str, source: str, weights, share: float, most: int, seed: int) -> tuple[DataFrame, ...]:
    """The input with the new columns under free names, as its last six, and the stored tables that it reads."""
    size, total, goal, finish, served, taken, h, bucket, run, of, at, before = free_names(docs, "_size", "_source_size", "_target", "_finish", "_served", "_taken", "_h", "_bucket", "_run", "_of", "_at", "_before")
    # 60 bits of a public hash, the same in every engine.
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary")), 1, 15), 16, 10).cast("long")
    rows = docs.withColumns({size: F.size(words_of(F.col(text))).cast("long"), h: order})
    totals = rows.groupBy(F.col(source).alias("source"), F.shiftright(h, 40).alias("cell")).agg(F.sum(size).alias("in"), F.count("*").alias("n"))
    totals = stored(totals, "mix-cells")  # at most 2**20 cells a source, fewer than rows
    n = totals.agg(F.sum("n")).first()[0] or 0
    bits = min(20, max(1, (n // BUCKET_ROWS).bit_length()))  # of the hash that name a bucket
    part = lambda x, width: F.shiftright(x, width - bits)
    goals = stored(targets(totals.groupBy("source").agg(F.sum("in").alias("source_size")), weights, share, most), "mix-targets")
    buckets = totals.groupBy("source", part("cell", 20).alias("bucket")).agg(F.sum("in").alias("in"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("source", "bucket", F.coalesce(F.sum("in").over(earlier), F.lit(0)).alias("before"))
    goals_ = goals.select(F.col("source").alias("own"), "source_size", "target")
    side = buckets.join(goals_, F.col("source").eqNullSafe(F.col("own"))).select(F.col("source").alias(of), F.col("bucket").alias(at), F.col("before").alias(before), F.col("source_size").alias(total), F.col("target").alias(goal))
    side = stored(side, "mix-starts")
    within = Window.partitionBy(source, bucket).orderBy(h, doc_id, size).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(bucket, part(h, 60)).withColumn(run, F.coalesce(F.sum(size).over(within), F.lit(0)))
    rows = rows.join(side, F.col(source).eqNullSafe(F.col(of)) & (F.col(bucket) == F.col(at)))
    start = [F.col(before) + F.col(run) + k * F.col(total) for k in range(most)]
    rows = rows.withColumn(finish, F.array(*[F.try_divide((s + F.col(size)).cast("double"), F.col(goal)) for s in start]))
    budget = int(min(share, most) * (goals.agg(F.sum("source_size")).first()[0] or 0))  # what all targets add up to
    time, last, rest = cut(rows.where(F.col(size) > 0).select(F.explode(finish).alias("finish"), F.col(source).alias("source"), F.col(size).alias("size")), budget)
    name = F.coalesce(F.col(source).cast("string"), F.lit(AFTER_ALL))
    early = lambda x: (x < time) | ((x == time) & (name < last))
    one = lambda x: F.when(early(x), F.col(size)).when((x == time) & (name == last), F.lit(rest)).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn(served, F.when(F.col(size) > 0, F.transform(finish, one)).otherwise(F.array(*[F.lit(0).cast("long")] * most)))
    rows = rows.withColumn(taken, F.aggregate(served, F.lit(0).cast("long"), lambda a, x: a + x))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], size, total, goal, finish, served, taken), side


def cut(passes: DataFrame, budget: int) -> tuple[float, str, int]:
    """Where the global order by finish time (then source) is truncated: time and source of the pass at the cut, words left for it.

    Passes (finish, source, size) are range-sorted; totals of ranges tell the range with the cut, and running sums inside it the pass.
    """
    keys = F.col("finish"), F.coalesce(F.col("source").cast("string"), F.lit(AFTER_ALL)).alias("source")
    ranges = passes.select(*keys, "size").repartitionByRange("finish", "source").sortWithinPartitions("finish", "source")
    ranges = stored(ranges.withColumn("range", F.spark_partition_id()), "mix-order")
    ends = ranges.groupBy("range").agg(F.sum("size").alias("in"))  # one row a partition
    through = F.sum("in").over(Window.orderBy("range"))
    found = ends.withColumn("through", through).where(F.col("through") >= budget).orderBy("range").first() if budget > 0 else None
    if found is None:  # nothing is cut off, or nothing taken
        return (math.inf if budget > 0 else -1.0), "", 0
    inside = Window.orderBy("finish", "source")  # of one range alone
    rows = ranges.where(F.col("range") == found["range"]).withColumn("through", F.sum("size").over(inside) + found["through"] - found["in"])
    at = rows.where(F.col("through") >= budget).orderBy("finish", "source").first()
    return at["finish"], at["source"], budget - (at["through"] - at["size"])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself, with the input's columns: a document once for every pass that serves it at least by half,
    range-sorted by virtual finish time, so that every stretch of the output has the target proportions."""
    text, doc_id, source = (options.get(c, c) for c in ("text", "doc_id", "source"))
    with scratch(docs.sparkSession) as keep:
        mix, *tables = queued(docs, doc_id, text, source, *[options.get(k, v) for k, v in (("weights", (3, 1, 2)), ("share", 1.5), ("most", 2), ("seed", 0))])
        keep(*tables)
    size, _, _, finish, served, _ = mix.columns[len(docs.columns) :]
    turn, passes = free_names(mix, "_turn", "_pass")
    zipped = F.zip_with(finish, served, lambda f, s: F.struct(f.alias("finish"), s.alias("served")))
    times = F.explode(F.filter(zipped, lambda x: (x["served"] > 0) & (2 * x["served"] >= F.col(size))))
    out = mix.withColumn(passes, times).withColumn(turn, F.col(f"{passes}.finish"))
    return out.repartitionByRange(turn).sortWithinPartitions(turn).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")
