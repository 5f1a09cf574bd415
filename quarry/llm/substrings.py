"""Operator 3, substring dedup by level-wise doubling.

Level 1 looks at windows of a quarter of the length, and of those only at the ones that a full window cannot do
without: of the quarter windows in its middle the one with the least hash is its anchor, and equal windows have equal
anchors at equal places. Anchors found in one document only end there. Those repeated are extended to twice that
length, around the anchor and inside every full window that it stands for, and so on to the full length, until none
survive. If all occurrences of the longest extension have the same surroundings (all words of all full windows
that it stands for), those windows are decided together by the least document; else each is looked up by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, dropped, free_names, mixed, scratch, small_batches, stored, window_ids

C1, C2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
SEED, OTHER_SEED = 0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D


def doubled(ids: np.ndarray, n: int, to: int) -> np.ndarray:
    """Ids of windows of `to` words, at most 2n, as two windows of n words that may overlap."""
    return mixed(ids[: n - to] * C1 + ids[to - n :]) if len(ids) > to - n else ids[:0]


def anchors(quarter: np.ndarray, full: np.ndarray, margin: int, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every quarter window that is an anchor: its position, and the first and last full window it stands for.

    A full window's anchor is the first least of those that start margin words after it or later, of as many as places.
    """
    middle = np.lib.stride_tricks.sliding_window_view(quarter[margin:], places)[: len(full)]
    at = middle.argmin(axis=1) + np.arange(margin, margin + len(full))
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[first], first, np.r_[first[1:], len(at)] - 1


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys stand in two documents or more. Both sides of the join are plain scans: a frequent key is split."""
    ends = rows.groupBy(keys).agg(F.min("_doc").alias("least"), F.max("_doc").alias("most")).where("least < most")
    return stored(rows.join(stored(ends.select(*keys), "repeated"), keys, "left_semi"), "level")


def substring_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 50) -> DataFrame:
    """The input's columns with n_words, n_removed (long) and kept_text.

    Removes each word covered by a window (of `window` consecutive words, at least 2) whose words also start
    a window in a document with a smaller id. kept_text joins the other words by one space. All judged on the
    input. Null text has no words; a null id is larger than every id, and rows with one id do not remove each
    other's words; repeated rows give repeated results. Ids are whole numbers. Input columns with the names of new ones are
    replaced, all others pass through. An empty table gives none. Hashes of 64 bits choose candidates; windows are equal if 128 bits are.
    """
    if window < 2:
        raise ValueError("a window has two words or more")
    spark = docs.sparkSession
    with scratch(spark) as keep, small_batches(spark):
        doc, text_hash, ranges_, cut_ = free_names(docs, "_doc", "_hash", "_ranges", "_cut")
        rows = docs.withColumns({doc: F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)), text_hash: F.xxhash64(F.col(text))})
        ranges = covered(rows.select(F.col(doc).alias("_doc"), F.col(text_hash).alias("_hash"), F.col(text).alias("_text")).where(F.length("_text") >= 2 * window - 1), window)
        keep(ranges)
    ranges = ranges.toDF(doc, text_hash, ranges_)

    @F.pandas_udf("n_words long, n_removed long, kept_text string")
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        out = []
        for s, at in zip(texts, ranges, strict=True):
            words = s.encode().split() if s else []
            if at is None or not len(at):
                out.append((len(words), 0, b" ".join(words).decode()))
                continue
            edge = np.zeros(len(words) + 1, np.int64)
            for x in at:
                edge[x["lo"]] += 1
                edge[x["hi"] + window] -= 1
            stay = np.cumsum(edge[:-1]) == 0
            out.append((len(words), int(len(words) - stay.sum()), b" ".join(w for w, k in zip(words, stay, strict=True) if k).decode()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text"])

    out = rows.join(ranges, [doc, text_hash], "left").withColumn(cut_, cut(F.col(text), F.col(ranges_)))
    return out.withColumns({c: F.col(f"{cut_}.{c}") for c in ("n_words", "n_removed", "kept_text")}).drop(cut_, doc, text_hash, ranges_)


def covered(slim: DataFrame, window: int) -> DataFrame:
    """(_doc, _hash, at): the ranges (lo, hi) of starts of repeated windows in each (_doc, _hash, _text)."""
    quarter_n = (window + 3) // 4
    half_n = min(2 * quarter_n, window)
    before = (half_n - quarter_n) // 2  # words by which the extension begins before the anchor

    def hashes(ids: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        quarter = window_ids(ids, quarter_n, seed)
        half = doubled(quarter, quarter_n, half_n)
        return quarter, half, doubled(half, half_n, window)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(lower=False)
        for batch in batches:
            out = []
            for d, h, ids in zip(batch["_doc"], batch["_hash"], words.each(batch["_text"]), strict=True):
                quarter, half, full = hashes(ids, SEED)
                if not len(full):
                    continue
                at, lo, hi = anchors(quarter, full, before, window - half_n + 1)
                around = mixed(full[lo] * C1 + full[hi] * C2 + (hi - lo).astype(np.uint64) * np.uint64(256) + (at - lo).astype(np.uint64))
                out.append(pd.DataFrame({"quarter": quarter[at].view(np.int64), "half": half[at - before].astype(np.uint32).view(np.int32), "around": around.view(np.int64), "_doc": d, "_hash": h, "lo": lo.astype(np.int32), "hi": hi.astype(np.int32)}))
            if out:
                yield pd.concat(out)

    spark = slim.sparkSession
    found = stored(slim.mapInPandas(find, "quarter long, half int, around long, _doc long, _hash long, lo int, hi int"), "anchors")
    level = repeated(found, ["quarter"])
    dropped(spark, found)
    keys = ["quarter", "half"]
    ends = level.groupBy(keys).agg(F.min("_doc").alias("least"), F.max("_doc").alias("most"), (F.min("around") == F.max("around")).alias("alike")).where("least < most")
    again = level.join(stored(ends.select(*keys, "least", "alike"), "repeated"), keys).where("not alike or least < _doc")
    again = stored(again.select("_doc", "_hash", "lo", "hi", "alike"), "level")
    dropped(spark, level)

    # The last level, for occurrences whose surroundings differ: full windows one by one.
    check = again.where("not alike").groupBy("_doc", "_hash").agg(F.collect_list(F.struct("lo", "hi")).alias("_at"))
    check = slim.join(check, ["_doc", "_hash"])

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(lower=False)
        for batch in batches:
            out = []
            for d, h, ids, at in zip(batch["_doc"], batch["_hash"], words.each(batch["_text"]), batch["_at"], strict=True):
                full, other = hashes(ids, SEED)[2], hashes(mixed(ids), OTHER_SEED)[2]
                w = np.unique(np.concatenate([np.arange(x["lo"], x["hi"] + 1) for x in at]))
                out.append(pd.DataFrame({"h1": full[w].view(np.int64), "h2": other[w].view(np.int64), "_doc": d, "_hash": h, "at": w.astype(np.int32)}))
            if out:
                yield pd.concat(out)

    windows = stored(check.mapInPandas(extend, "h1 long, h2 long, _doc long, _hash long, at int"), "windows")
    least = windows.groupBy("h1", "h2").agg(F.min("_doc").alias("least"), F.max("_doc").alias("most")).where("least < most")
    single = windows.join(stored(least.select("h1", "h2", "least"), "repeated"), ["h1", "h2"]).where("least < _doc").select("_doc", "_hash", F.col("at").alias("lo"), F.col("at").alias("hi"))
    ranges = again.where("alike").select("_doc", "_hash", "lo", "hi").unionByName(single)
    return stored(ranges.groupBy("_doc", "_hash").agg(F.collect_set(F.struct("lo", "hi")).alias("at")), "ranges")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
