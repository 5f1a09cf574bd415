"""Operator 6, line dedup: document frequencies of line keys kept in levelled sorted runs."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, delete, dropped, free_names, lower_ascii, row_key, scratch, shared_folder, stored

#: Rows of a table of frequent lines that may be broadcast: two 64-bit hashes each, so at most 1.6 MB.
BROADCAST_ROWS = 100_000


def line_key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(BLANKS)))


class LineRuns:
    """Counts of line keys (h1, h2, n) as sorted runs in levels: tables of the shared folder, bucketed by key and sorted in each bucket.

    A new batch is merge-joined with the runs, which takes no exchange or sort of theirs. Keys that the runs already hold
    min_docs times are settled and leave the batch (an anti-join); its other counts become a run of level 0, and keys that
    reach min_docs with them are noted. When a level has fanout runs they are merged into one run of the next level, so keys are
    rewritten once a level and a batch reads few runs. Batches must hold different documents.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 3):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.reached: list[DataFrame] = []

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def _write(self, counts: DataFrame) -> str:
        """A run: one sorted file a bucket."""
        name = f"quarry_run_{uuid.uuid4().hex}"
        rows = counts.repartition(self.buckets, "h1", "h2").sortWithinPartitions("h1", "h2")
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{shared_folder(self.spark)}/{name}").saveAsTable(name)
        return name

    def totals(self, counts: DataFrame) -> DataFrame:
        """A batch of counts (h1, h2, n), one row a key, with what the runs hold of its keys (before)."""
        out, before = counts, F.lit(0).cast("long")
        for i, run in enumerate(self.runs()):
            out = out.join(self.spark.table(run).withColumnRenamed("n", f"n{i}"), ["h1", "h2"], "left")
            before = before + F.coalesce(f"n{i}", F.lit(0))
        return out.select("h1", "h2", "n", before.alias("before"))

    def add(self, counts: DataFrame) -> None:
        with run_order(self.spark):
            batch = stored(self.totals(counts).where(F.col("before") < self.min_docs), "line-batch")
            self.reached.append(stored(batch.where(F.col("before") + F.col("n") >= self.min_docs).select("h1", "h2"), "line-keys"))
            self._put(0, batch.select("h1", "h2", "n"))
            dropped(self.spark, batch)

    def _put(self, level: int, counts: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._write(counts))
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            # Read as plain files: parts of a union of bucketed tables are not one bucket each.
            plain = [self.spark.read.schema("h1 long, h2 long, n long").parquet(f"{shared_folder(self.spark)}/{name}") for name in old]
            merged = stored(reduce(DataFrame.unionByName, plain).groupBy("h1", "h2").agg(F.sum("n").alias("n")), "line-merge")
            self._put(level + 1, merged)
            self._remove(old)
            dropped(self.spark, merged)

    def _remove(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
        delete(self.spark, set(names))

    def close(self) -> DataFrame:
        """All keys that stand in min_docs documents or more; the runs go."""
        self._remove(self.runs())
        return reduce(DataFrame.unionByName, self.reached)


@contextmanager
def run_order(spark: SparkSession):
    """While plans are made inside, scans of bucketed tables with one file a bucket are known to be sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def line_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, batches: int = 4) -> DataFrame:
    """The input's columns with n_lines, n_dropped (long) and kept_text.

    Lines end at \\n. A line's key is its text without blanks at its ends, A-Z lower-cased. Keys of at least
    min_chars code points found in at least min_docs documents lose all their lines everywhere. Rows with one
    id (or without one) are one document in the count. Null or empty text is one empty line, which stays
    because its key is empty; repeated rows give repeated results. Documents go to batches by id. Of the text only hashes
    of its lines are counted; frequent keys are broadcast up to BROADCAST_ROWS, beyond that joined by shuffle. Input columns with the
    names of new ones are replaced, all others pass through. An empty table gives none.
    """
    with scratch(docs.sparkSession) as keep:
        drop = dropped_lines(docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")), min_docs, min_chars, batches)
        keep(drop)
    key, text_hash, drop_, lines_, kept_ = free_names(docs, "_key", "_hash", "_drop", "_lines", "_kept")
    out = docs.select("*", *[c.alias(name) for c, name in zip(row_key(doc_id, text), (key, text_hash), strict=True)])
    out = out.join(drop.toDF(key, text_hash, drop_), [key, text_hash], "left")
    out = out.withColumn(lines_, F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    every = F.sequence(F.lit(0), F.size(lines_) - 1)
    out = out.withColumn(kept_, F.when(F.col(drop_).isNull(), every).otherwise(F.array_except(every, F.col(drop_))))
    text_of = F.element_at(F.transform(F.array(lines_), lambda x: F.array_join(F.transform(kept_, lambda i: F.get(x, i)), "\n")), 1)
    n = F.size(lines_).cast("long")
    out = out.withColumns({"n_lines": n, "n_dropped": n - F.size(kept_), "kept_text": text_of})
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text")], "n_lines", "n_dropped", "kept_text")


def dropped_lines(docs: DataFrame, min_docs: int, min_chars: int, batches: int) -> DataFrame:
    """(_key, _hash, _drop): the numbers of the lines that each (_doc, _text) loses, where it loses any."""
    spark = docs.sparkSession
    keys = F.transform(F.split(F.coalesce(F.col("_text"), F.lit("")), "\n", -1), line_key)
    lines = docs.select(*row_key("_doc", "_text"), F.posexplode(keys).alias("_line", "_k")).where(F.length("_k") >= max(1, min_chars))
    lines = lines.select("_key", "_hash", "_line", F.xxhash64("_k").alias("h1"), F.xxhash64(F.lit("second"), "_k").alias("h2"), F.pmod(F.xxhash64("_key"), F.lit(batches)).cast("int").alias("batch"))
    lines = stored(lines, "lines", by="batch")  # a batch reads its own rows only
    runs = LineRuns(spark, min_docs)
    for b in range(batches):
        part = lines.where(F.col("batch") == b)
        runs.add(part.select("_key", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n")))
    frequent = stored(runs.close(), "frequent-lines")
    if frequent.count() <= BROADCAST_ROWS:
        frequent = F.broadcast(frequent)
    return stored(lines.join(frequent, ["h1", "h2"], "left_semi").groupBy("_key", "_hash").agg(F.collect_set("_line").alias("_drop")), "dropped-lines")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
