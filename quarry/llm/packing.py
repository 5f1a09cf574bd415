"""Operator 10, packing: best-fit decreasing into fixed windows, a shard at a time."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import scratch, stored

#: Tokens that a shard packs: memory of a packing task is one entry a window that is still open.
SHARD_TOKENS = 1 << 24
#: Words whose ids a generation of a worker's memory holds if nothing else is said, and text that is tokenised at a time.
MOST_WORDS, BATCH_CHARS = 800_000, 2_000_000


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree of counts; finds the tightest that fits."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.at[capacity].append(window)
        i = self.leaves + capacity
        while i:
            self.count[i] += 1
            i >>= 1

    def tightest(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of an open window with the least capacity of at least need, taken out; None if none fits."""
        i, count = self.leaves + need, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i ^ 1]):  # up to the first ancestor with something to the right
                i >>= 1
            if i <= 1:
                return None
            i ^= 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.at[capacity].pop()


def of_worker(make, *key):
    """make(*key), kept by the worker's process from task to task, for the last few keys.

    It hangs on a module that is made here, since this one is shipped to workers by value and is new in each task.
    """
    import sys
    import types

    kept = vars(sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker"))).setdefault("values", {})
    if key not in kept:
        if len(kept) > 1:
            kept.clear()
        kept[key] = make(*key)
    return kept[key]


def forget() -> None:
    """Lets go of what of_worker() keeps."""
    import sys

    vars(sys.modules.get("_kept_by_worker", object)).get("values", {}).clear()


def encoder(path: str, separator: int, most_words: int = MOST_WORDS):
    """texts -> ids of each as bytes (<u4), closed by separator, equal to the tokenizer file's own encoding.

    Byte-level BPE splits text into words before merging; a run of non-blanks with the one space before it is
    encoded alike wherever it stands, so its ids are remembered: in two generations of at most most_words, of which
    the older goes when the younger is full. A worker keeps them from task to task. Texts are cut at single spaces,
    or by the pattern where a space stands between blanks. Texts with the special token's string, or with
    the control characters on whose being blank libraries differ, go through the tokenizer whole.
    New words are cut once more, into runs of letters, digits or signs that the tokenizer's pattern cuts alike, and only new runs are
    merged, by the tokenizer's model itself. Words that hold anything else, as apostrophes or other scripts, go through the whole tokenizer.
    """
    import re
    import struct

    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer.from_file(path)
    pieces, odd = re.compile(r" ?[^\s]+|\s+(?!\S)|\s+").findall, ("<|endoftext|>", "\0", "\x1c", "\x1d", "\x1e", "\x1f", "\x85")
    among_blanks = re.compile(r" (?<=\s )(?:\s|\Z)").search
    young: dict[str, bytes] = {}
    old: dict[str, bytes] = {}
    close = np.array([separator], "<u4").tobytes()
    merge, byte_level = t.model.tokenize, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    split = t.pre_tokenizer
    known = isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space and isinstance(t.model, models.BPE) and t.model.dropout is None and t.normalizer is None and t.post_processor is None
    runs = re.compile(r" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)|\n").findall
    spelt = {i: byte_level.pre_tokenize_str(chr(i))[0][0] for i in [10, *range(32, 127), *range(0xC0, 0x250)]}

    def raw(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch_fast(texts, add_special_tokens=False)]

    def run_ids(r: str) -> bytes:
        if r not in young:
            ids = None if r in old else [x.id for x in merge(r.translate(spelt))]
            young[r] = old[r] if ids is None else struct.pack(f"<{len(ids)}I", *ids)
        return young[r]

    def learn(words: list[str]) -> None:
        rest = []
        for w in words:
            own = runs(w) if known else []
            if len(own) == 1 and own[0] == w:
                run_ids(w)
            elif "".join(own) == w and "\n\n" not in w:
                young[w] = b"".join(map(run_ids, own))
            else:
                rest.append(w)
        young.update(zip(rest, raw(rest), strict=True))

    def cut(text: str | None) -> list[str] | None:
        if not text:
            return []
        if any(c in text for c in odd):
            return None
        return pieces(text) if among_blanks(text) else text.replace(" ", "\0 ").split("\0")

    def encode(texts: list[str | None]) -> list[bytes]:
        found = [cut(s) for s in texts]
        new = set().union(*[f for f in found if f]).difference(young)
        if len(young) + len(new) > most_words:
            old.clear()
            old.update(young)
            young.clear()
            new = set().union(*[f for f in found if f])
        again = new.intersection(old)
        young.update((w, old[w]) for w in again)
        learn(list(new.difference(again)))
        return [(raw([s])[0] if f is None else b"".join(map(young.__getitem__, f))) + close for s, f in zip(texts, found, strict=True)]

    return encode


def narrow(ids: bytes) -> bytes:
    """Ids given as 32-bit numbers as 16-bit ones, if all fit."""
    x = np.frombuffer(ids, "<u4")
    return x.astype("<u2").tobytes() if x.max() < 1 << 16 else ids


def wide(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<i4")


def pieces_of(docs: DataFrame, *, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = 1024, separator: int = 0, keep_ids: bool = True, most_words: int = MOST_WORDS) -> DataFrame:
    """Tokenises and cuts: one row per piece (doc_id, doc_tokens, start, length, ids_crc32 and, if kept, ids as little-endian numbers of 16 bits, or 32 where one is larger).

    A document is its ids and the separator. Overlong documents are cut into full windows and a rest.
    Null text counts as empty: one piece, the separator alone.
    """
    schema = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, doc_tokens long, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encode = of_worker(encoder, tokenizer, separator, most_words)
        for batch in batches:
            for part in parts(batch):
                rows = []
                for d, ids in zip(part[doc_id].array, encode([None if s is pd.NA else s for s in part[text].array]), strict=True):
                    n = len(ids) // 4
                    for i in range(0, n, window):
                        p = ids[4 * i : 4 * (i + window)]
                        rows.append((None if pd.isna(d) else d, n, i, len(p) // 4, zlib.crc32(p), *([narrow(p)] if keep_ids else [])))
                yield frame(rows)

    def parts(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Rows of a batch, about BATCH_CHARS of text at a time."""
        if len(batch):
            number = batch[text].str.len().fillna(0).cumsum() // BATCH_CHARS
            for _, part in batch.groupby(number, sort=False):
                yield part

    columns = [doc_id, "doc_tokens", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=columns)
        out[doc_id] = out[doc_id].astype(object)
        return out

    return docs.select(doc_id, text).mapInPandas(cut, schema)


def packed(pieces: DataFrame, *, doc_id: str = "doc_id", window: int = 1024) -> DataFrame:
    """Adds sequence_id and offset (long): best-fit decreasing over the pieces of each shard.

    Pieces go to shards by hash; shards hold about SHARD_TOKENS tokens, so padding stays that of a large packing
    and no task grows with the input. A shard's pieces come longest first; each goes into the tightest window
    with room, or opens one. Order and so result hang on (length, id, start, crc) only; sequence ids carry their
    shard in the high bits. Ids, if there, come out as an array of numbers. Repeated rows are packed as often as they stand.
    """
    tokens = pieces.agg(F.sum("length")).first()[0] or 0
    shards = max(1, round(tokens / SHARD_TOKENS))
    rows = pieces.withColumn("_shard", F.pmod(F.xxhash64(doc_id, "start", "ids_crc32"), F.lit(shards)))
    rows = rows.repartition(shards, "_shard").sortWithinPartitions("_shard", F.desc("length"), doc_id, "start", "ids_crc32")
    schema = rows.drop("_shard").schema.add("sequence_id", "long").add("offset", "long")
    if "ids" in schema.names:
        schema["ids"].dataType = ArrayType(IntegerType())

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()  # the worker may still hold the words of tokenising
        shard, windows, n = None, None, 0
        for batch in batches:
            ids, offsets = [], []
            for s, length in zip(batch["_shard"].array, batch["length"].array, strict=True):
                s, length = int(s), int(length)
                if s != shard:
                    shard, windows, n = s, OpenWindows(window), 0
                found = windows.tightest(length)
                if found is None:
                    capacity, w, n = window, n, n + 1
                else:
                    capacity, w = found
                ids.append((shard << 32) + w)
                offsets.append(window - capacity)
                if capacity > length:
                    windows.put(capacity - length, w)
            batch = batch.drop(columns="_shard")
            batch["sequence_id"], batch["offset"] = ids, offsets
            if "ids" in batch:  # handed on some at a time: as numbers they take several times the memory
                for k in range(0, len(batch), 256):
                    part = batch.iloc[k : k + 256]
                    yield part.assign(ids=[wide(x, n) for x, n in zip(part["ids"], part["length"], strict=True)])
            else:
                yield batch

    return rows.mapInPandas(fit, schema)


def pack(docs: DataFrame, *, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = 1024, separator: int = 0, keep_ids: bool = True, most_words: int = MOST_WORDS) -> DataFrame:
    """Packs documents into sequences of at most window tokens: one row per piece.

    Columns: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids). Tokens are made once and
    the pieces stored in the shared folder; packing moves ids only if they are kept. A worker remembers the ids of up to
    twice most_words words: more are faster, fewer take less memory. An empty table gives none.
    """
    with scratch(docs.sparkSession) as keep:
        pieces = stored(pieces_of(docs, tokenizer=tokenizer, doc_id=doc_id, text=text, window=window, separator=separator, keep_ids=keep_ids, most_words=most_words), "pieces")
        keep(pieces)
    return packed(pieces, doc_id=doc_id, window=window)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, tokenizer=tokenizer_path(), keep_ids=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
