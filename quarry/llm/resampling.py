"""Operator 11, importance resampling towards a target distribution: two passes over Arrow batches.

The first pass makes of every partition one vector of phrase counts by hash bucket (np.bincount), merged by treeReduce.
The second pass has the gains of all buckets broadcast (a vector as long as there are buckets, whatever the input), gathers one
for each phrase and sums them by document with weighted bincounts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_names, scratch, stored
from .texts import parts, raw, runs

#: Phrases longer than this many bytes are hashed one by one, the others a byte of all of them at a time.
SHORT = 48


def crc_table() -> np.ndarray:
    """The 256 steps of CRC-32 (reflected polynomial 0xEDB88320)."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(0xEDB88320), x >> 1).astype(np.uint32)
    return x


class PhraseBuckets:
    """Hash buckets of the phrases of texts.

    Words are runs of digits, letters a-z (A-Z count as these) and all characters beyond ASCII. Phrases are all runs of
    1 to most_words consecutive words joined by one space; a bucket is the CRC-32 of its UTF-8 bytes modulo n.
    """

    def __init__(self, n: int, most_words: int = 1):
        self.n, self.most_words, self.table = n, most_words, crc_table()
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[ord("A") : ord("Z") + 1] += 32
        self.word = np.zeros(256, bool)
        self.word[[*b"0123456789", *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True

    def crc(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.full(len(start), 0xFFFFFFFF, np.uint32)
        length = np.minimum(end - start, SHORT + 1).astype(np.uint8)
        order = np.argsort(length, kind="stable")[::-1]  # longest first, so that those still going on are a prefix
        state, first = out[order], start[order]
        going = np.searchsorted(np.sort(length), np.arange(SHORT + 2), "right")
        for j in range(SHORT):
            k = len(start) - going[j]
            if not k:
                break
            s = state[:k]
            state[:k] = self.table[(s ^ data[first[:k] + j]) & 255] ^ (s >> 8)
        out[order] = ~state
        for i in np.flatnonzero(length > SHORT):
            out[i] = zlib.crc32(data[start[i] : end[i]])
        return out

    def of(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, text) of every phrase in any order, and the words of each text."""
        data = self.lower[data]
        inside = self.word[data]
        start, end = runs(inside, at)
        texts = np.searchsorted(at, start, "right") - 1
        n_words = np.bincount(texts, minlength=len(at) - 1)
        if self.most_words > 1 and len(start):  # words apart by one space each
            room = np.cumsum(end - start + 1)
            here = np.full(room[-1], ord(" "), np.uint8)
            at_word = np.repeat(room - (end - start + 1) - start, end - start) + np.flatnonzero(inside)
            here[at_word] = data[inside]
            data, start, end = here, room - (end - start + 1), room - 1
        buckets, owners = [], []
        for k in range(1, self.most_words + 1):
            first = np.flatnonzero(texts[: len(texts) - k + 1] == texts[k - 1 :])
            buckets.append((self.crc(data, start[first], end[first + k - 1]) % np.uint32(self.n)).astype(np.int64))
            owners.append(texts[first])
        return np.concatenate(buckets), np.concatenate(owners), n_words


def bucket_counts(docs: DataFrame, text: str, hashing: PhraseBuckets) -> np.ndarray:
    """How often all texts together fall in each bucket: a vector of each partition, merged by treeReduce."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(hashing.n, np.int64)
        for batch in batches:
            for _, _, data, at in parts(*raw(batch.column(0))):
                total += np.bincount(hashing.of(data, at)[0], minlength=hashing.n)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    n = vectors.getNumPartitions()
    if not n:
        return np.zeros(hashing.n, np.int64)
    return vectors.treeReduce(np.add, depth=max(2, math.ceil(math.log(n, 100))))  # the driver adds up about a hundred vectors


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket floor(1000 * ln of the share in the target over the share in the source), both smoothed by one."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.float64)


def importance_scores(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = 10_000, most_words: int = 1, seed: int = 2024) -> DataFrame:
    """The input's columns with n_words, n_features, weight and score (long).

    weight sums the gains of the buckets of a document's phrases, n_features of them. score adds Gumbel noise from the first 32 bits of
    sha256(`seed:id`), so that the highest scores are a weighted draw without replacement. A null or empty text has no
    words and weighs 0, as does a text of marks alone; a null id has the noise of the empty id. Repeated rows count as often as they stand and score
    alike. An empty table gives none; an empty target has a count of 0 in each bucket. Input columns with the names of new ones are
    replaced, all others pass through. Weights and scores are whole numbers, exact below 2**53.
    """
    spark, hashing = docs.sparkSession, PhraseBuckets(buckets, most_words)
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs, text, hashing), bucket_counts(target, target_text, hashing)))

    @F.arrow_udf("struct<n_words:long,n_features:long,weight:long>")
    def weigh(texts: pa.Array) -> pa.Array:
        words, features, weights = (np.zeros(len(texts), np.int64) for _ in range(3))
        for i, j, data, at in parts(*raw(texts)):
            bucket, owner, words[i:j] = hashing.of(data, at)
            features[i:j] = np.bincount(owner, minlength=j - i)
            weights[i:j] = np.bincount(owner, weights=gain.value[bucket], minlength=j - i).astype(np.int64)
        return pa.StructArray.from_arrays([pa.array(x) for x in (words, features, weights)], ["n_words", "n_features", "weight"])

    (out,) = free_names(docs, "_weighed")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    new = {"n_words": F.col(f"{out}.n_words"), "n_features": F.col(f"{out}.n_features"), "weight": F.col(f"{out}.weight"), "score": F.col(f"{out}.weight") + noise}
    rows = docs.withColumn(out, weigh(F.col(f"`{text}`")))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new], *[c.alias(name) for name, c in new.items()])


def drawn(scored: DataFrame, *, doc_id: str = "doc_id", percent: int = 10, least_words: int = 20) -> DataFrame:
    """Rows of importance_scores() with rank (long): 1, 2, 3... for the highest scores among the rows of at least least_words
    words, as many as floor(percent of them); null for the others.

    Ties go to the smaller id, null ids last; rows that tie in both follow each other in any order. Rows are sorted in ranges;
    a range's ranks begin after the sum of the counts of the ranges before it (one number a range), so no range is more than its share.
    scored is read twice: hand in a stored table, without texts.
    """
    part, before = free_names(scored, "_part", "_before")
    fit = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    order = [F.desc("score"), F.col(f"`{doc_id}`").asc_nulls_last(), F.col("n_features")]
    with scratch(scored.sparkSession) as keep:
        ranges = scored.where(fit).repartitionByRange(*order).withColumn(part, F.spark_partition_id())
        ranges = stored(ranges, "score-ranges")
        sizes = ranges.groupBy(part).agg(F.count("*").alias("n"))
        until = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
        sizes = stored(sizes.withColumn(before, F.coalesce(F.sum("n").over(until), F.lit(0))), "score-offsets")
        keep(ranges, sizes)
    wanted = percent * (sizes.agg(F.sum("n")).first()[0] or 0) // 100
    placed = ranges.join(F.broadcast(sizes.select(part, before)), part)
    rank = (F.row_number().over(Window.partitionBy(part).orderBy(*order)) + F.col(before)).cast("long")
    top = placed.where(F.col(before) < wanted).withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    rest = [scored.where(~fit), placed.where(F.col(before) >= wanted)]
    for other in rest:
        top = top.unionByName(other.withColumn("rank", F.lit(None).cast("long")), allowMissingColumns=True)
    return top.select(*[F.col(f"`{c}`") for c in scored.columns if c.lower() != "rank"], "rank")


def importance_resample(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", percent: int = 10, least_words: int = 20, **options) -> DataFrame:
    """The id with n_words, n_features, weight, score and rank (long), a row for each of the input.

    See importance_scores() for odd rows and options, and drawn() for ranks. An empty table gives none.
    """
    with scratch(docs.sparkSession) as keep:
        scored = importance_scores(docs, target, doc_id=doc_id, **options).select(F.col(f"`{doc_id}`"), "n_words", "n_features", "weight", "score")
        scored = stored(scored, "scored")
        out = drawn(scored, doc_id=doc_id, percent=percent, least_words=least_words)
        keep(scored, out)
    return out


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return importance_resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
