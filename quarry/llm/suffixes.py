"""Operator 12, suffix-array dedup: maximal repeats from common-prefix intervals of sorted suffixes.

The suffixes of a sparse suffix array start at anchors: of the half-length strings in a window, the first with the least hash. Equal
windows have equal anchors at equal places, so every repeat of a window or more has the same anchor in all its occurrences,
and only suffixes with the same anchor string (a prefix range of the array) need to meet. An anchor's context is all bytes of the windows that it stands for.
Contexts with several occurrences are repeats as a whole and enter the array once. Spark sorts the rest by anchor and the bytes that follow; a task scans the
common-prefix lengths of neighbours with a stack, which yields the interval tree, and holds the bytes before the
anchors of each interval against each other: where they go on alike far enough, the interval and that extension are a repeat, with all
the interval's suffixes that share it as its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, dropped, free_names, mixed, scratch, small_batches, stored
from .texts import parts, raw

#: Different contexts of one anchor string that a task scans as one tree; more are looked up window by window, each on its own.
CROWD = 4096
#: Contexts that are scanned at once.
SOME = 8192
C1, C2, C3 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive numbers, by doubling."""
    n, span = len(x) - width + 1, 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n])


class Rolling:
    """Polynomial hashes of byte strings of two lengths, from one running sum, and anchors of windows."""

    def __init__(self, window: int, base: int = Words.BASE, seed: int = 0x9E3779B97F4A7C15, size: int = 1 << 18):
        self.window, self.half, self.size = window, (window + 1) // 2, size
        self.bits = np.uint64((1 << (size + window).bit_length()) - 1)
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed))
        power = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(size + window, b, np.uint64)])
        self.powers, self.inverse = power(base), power(pow(base, -1, 1 << 64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        return np.r_[np.uint64(0), np.cumsum(self.values[data] * self.powers[: len(data)])]

    def hashes(self, sums: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
        """Of the strings of n bytes at the given places, or all."""
        if at is None:
            return (sums[n:] - sums[:-n]) * self.inverse[: len(sums) - n]
        return (sums[at + n] - sums[at]) * self.inverse[at]

    def anchors(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of all anchors in texts that begin at `at`: key, context, first window, place, last window."""
        window, edge = self.window, np.zeros(len(data) + 1, np.int64)
        np.add.at(edge, np.maximum(at[1:] - window + 1, 0), 1)
        np.add.at(edge, at[1:], -1)
        whole = np.cumsum(edge)[:-1] == 0  # the window that starts here ends in the same text
        found = []
        for c in range(0, len(data) - window + 1, self.size):
            part = data[c : c + self.size + window - 1]
            fine = whole[c : c + len(part) - window + 1]
            if not fine.any():
                continue
            sums = self.sums(part)
            half = self.hashes(sums, self.half)
            order = (half & ~self.bits) | np.arange(len(half), dtype=np.uint64)
            least = (sliding_min(order, window - self.half + 1) & self.bits).astype(np.int64)
            new = np.r_[True, (least[1:] != least[:-1]) | ~fine[:-1]]
            lo = np.flatnonzero(new & fine)
            hi = np.flatnonzero(np.r_[new[1:] | ~fine[1:], True] & fine)
            found.append((mixed(half[least[lo]]), self.hashes(sums, window, lo), self.hashes(sums, window, hi), lo + c, least[lo] + c, hi + c))
        if not found:
            return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
        key, first, last, lo, place, hi = map(np.concatenate, zip(*found, strict=True))
        new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (lo[1:] != hi[:-1] + 1)])  # a part may have cut an anchor's windows in two
        end = np.r_[new[1:], len(lo)] - 1
        key, first, last, lo, place, hi = key[new], first[new], last[end], lo[new], place[new], hi[end]
        context = mixed(first * C1 + last * C2 + (hi - lo).astype(np.uint64) * C3 + (place - lo).astype(np.uint64))
        return key, context, lo, place, hi


def prefix_lengths(keys: np.ndarray, strings: list[bytes]) -> np.ndarray:
    """How many leading bytes each string shares with the one before it; -1 where the key differs, at the start and at the end."""
    length = np.array([len(s) for s in strings])
    width = int(length.max(initial=0)) + 1
    m = np.frombuffer(b"".join([s.ljust(width, b"\0") for s in strings]), np.uint8).reshape(-1, width)
    same = m[1:] == m[:-1]
    same[:, -1] = False
    out = np.minimum(same.argmin(axis=1), np.minimum(length[1:], length[:-1]))
    return np.r_[-1, np.where(keys[1:] == keys[:-1], out, -1), -1]


def intervals(shared: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The common-prefix intervals (length, first, last) of a sorted array, children before parents: the stack scan.

    shared: common prefix with the one before, with -1 before the first and after the last.
    """
    stack = [(-1, 0)]
    for i, n in enumerate(shared[1:].tolist(), 1):
        first = i - 1
        while n < stack[-1][0]:
            depth, first = stack.pop()
            yield depth, first, i - 1
        if n > stack[-1][0]:
            stack.append((n, first))


class Trees:
    """The interval trees of some anchor strings: keys, and the bytes before (backwards) and from each anchor on, sorted by key and the latter."""

    def __init__(self, keys: np.ndarray, before: list[bytes], after: list[bytes], window: int):
        self.window = window
        nodes = [x for x in intervals(prefix_lengths(keys, after)) if x[0] >= 1]
        self.depth, self.first, self.last = np.array(nodes, np.int64).reshape(-1, 3).T
        order = sorted(range(len(before)), key=lambda i: (keys[i], before[i]))
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        shared = prefix_lengths(keys[order], [before[i] for i in order])[:-1]
        self.table = [shared]  # least of 1, 2, 4... neighbours
        while len(self.table[-1]) > (1 << len(self.table)) // 2:
            x, span = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(x[:-span], x[span:]))

    def members(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, suffix) of all suffixes of all nodes, those of a node by what is before the anchor."""
        size = self.last - self.first + 1
        node = np.repeat(np.arange(len(size)), size)
        suffix = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first, size)
        order = np.lexsort((self.rank[suffix], node))
        return node, suffix[order]

    def shared_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes before the anchor that suffixes of ranks a < b share."""
        level = np.frexp(b - a)[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.table[k][a[at] + 1], self.table[k][b[at] - (1 << int(k)) + 1])
        return out

    def covered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes within a repeat of a window or more, and how far such repeats reach before and after the anchor.

        In each node a suffix has its widest repeat with a neighbour in the order of what is before the anchor. All contain the anchor, so their union has no gap.
        """
        node, suffix = self.members()
        wide = np.full(len(suffix) + 1, -1, np.int64)
        near = np.flatnonzero(node[1:] == node[:-1])
        wide[near + 1] = self.shared_before(self.rank[suffix[near]], self.rank[suffix[near + 1]])
        wide = np.maximum(wide[:-1], wide[1:])  # with the one before or after
        after = self.depth[node]
        far = wide + after >= self.window
        found, inverse = np.unique(suffix[far], return_inverse=True)
        reach = np.zeros((2, len(found)), np.int64)
        np.maximum.at(reach[0], inverse, wide[far])
        np.maximum.at(reach[1], inverse, after[far])
        return found, *reach

    def groups(self) -> Iterator[tuple[int, int, list[int]]]:
        """Maximal repeats of a window or more: bytes before and after the anchor, and all suffixes that have them.

        The stack scan again, inside each interval, over what is before the anchors. Both ways of going on are diverse: the bytes before
        differ by the choice of interval, and the suffixes come from more than one child of the node, so what follows differs.
        """
        node, suffix = self.members()
        start = np.searchsorted(node, np.arange(len(self.depth) + 1))
        child = np.full(len(self.rank), -1)
        for v in range(len(self.depth)):  # children come before parents
            own = suffix[start[v] : start[v + 1]]
            shared = self.shared_before(self.rank[own[:-1]], self.rank[own[1:]])
            kids = child[own]
            kids = np.where(kids < 0, -2 - own, kids)  # a suffix that is in no child is one by itself
            for length, i, j in intervals(np.r_[-1, shared, -1]):
                if length + self.depth[v] >= self.window and len(np.unique(kids[i : j + 1])) > 1:
                    yield length, int(self.depth[v]), own[i : j + 1].tolist()
            child[own] = v


def more_than_twice(x: np.ndarray) -> np.ndarray:
    """Marks the third and later occurrence of each number."""
    order = np.argsort(x, kind="stable")
    out = np.zeros(len(x), bool)
    if len(x) > 2:
        out[order[2:]] = x[order[2:]] == x[order[:-2]]
    return out


def row_ids(doc_id: str, text: str) -> list[Column]:
    """128 bits that name a row by its id and text."""
    d, t = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("\0null")), F.col(f"`{text}`")
    return [F.xxhash64(d, t), F.xxhash64(F.lit("second"), t, d)]


class Repeats:
    """The stored tables between the steps: all anchors whose string stands at two places or more, and what is asked of texts."""

    def __init__(self, slim: DataFrame, window: int, crowd: int, fold: bool = False):
        """fold: of a context that a text holds more than twice, as texts with a period do, only two go on; the others are repeats for certain (known)."""
        self.slim, self.window, self.spark, self.fold = slim, window, slim.sparkSession, fold
        keys = ["key", "context"]
        found = stored(slim.mapInArrow(self._anchors(), "key long, context long, d1 long, d2 long, lo int, at int, hi int"), "anchors")
        self.known = stored(found.where("key is null").select("d1", "d2", "lo", (F.col("hi") + window).alias("end")), "known") if fold else None
        twice = stored(found.where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated")
        self.level = stored(found.join(twice, "key", "left_semi"), "level")
        dropped(self.spark, found, twice)
        kinds = self.level.groupBy(keys).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("d1", "d2", "lo", "at", "hi")])
        self.kinds = stored(kinds, "contexts")
        some = self.kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.count(F.when(F.col("n") == 1, 1)).alias("single")).where("kinds > 1")
        self.some = stored(some, "kinds")
        ask = self.kinds.join(self.some, "key").withColumn("crowded", F.col("kinds") > crowd)
        self.ask = stored(ask.select("d1", "d2", "crowded", F.struct("key", "context", "lo", "at", "hi", (F.col("n") == 1).alias("alone")).alias("a"), "single"), "asked")

    def _anchors(self):
        window, fold = self.window, self.fold

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rolling = Rolling(window)
            for batch in batches:
                ids = [np.asarray(batch.column(k)) for k in (0, 1)]
                for i, _, data, at in parts(*raw(batch.column(2))):
                    key, context, *where = rolling.anchors(data, at)
                    text = np.searchsorted(at, where[0], "right") - 1
                    known = np.zeros(len(key), bool)
                    if fold:
                        lo, hi, known = where[0], where[2], more_than_twice(mixed(key * C1 + context * C2 + text.astype(np.uint64) * C3))
                        own = np.flatnonzero(known)
                        first = own[np.r_[True, (text[own[1:]] != text[own[:-1]]) | (lo[own[1:]] > hi[own[:-1]] + window)]] if len(own) else own
                        last = own[np.r_[np.searchsorted(own, first[1:]) - 1, len(own) - 1]] if len(own) else own
                        hi[first] = hi[last]  # one row for what they cover together
                        rest = known.copy()
                        rest[first] = False
                        key, context, text, known, where = key[~rest], context[~rest], text[~rest], known[~rest], [x[~rest] for x in where]
                    out = [ids[0][i + text], ids[1][i + text], *[(x - at[text]).astype(np.int32) for x in where]]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64), mask=known), pa.array(context.view(np.int64)), *map(pa.array, out)], ["key", "context", "d1", "d2", "lo", "at", "hi"])

        return find

    def whole(self) -> DataFrame:
        """Anchors whose whole context has several occurrences: (key, context, d1, d2, lo, at, hi)."""
        return self.level.join(self.kinds.where("n > 1").select("key", "context"), ["key", "context"], "left_semi")

    def contexts(self, groups: bool) -> DataFrame:
        """The contexts of anchor strings with several: their bytes, those before the anchor backwards.

        A row each, and only of strings that have a context with one occurrence; for groups all, and two rows for those with several occurrences.
        """
        ask = self.ask.where(~F.col("crowded") & ((F.col("single") > 0) | F.lit(groups)))
        window = self.window

        def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["key", "context", "alone", "d1", "d2", "at", "before", "after"]
            for batch in batches:
                texts, asked, d1, d2 = (batch.column(k) for k in ("text", "asked", "d1", "d2"))
                for k in range(len(batch)):
                    data = texts[k].as_py().encode()
                    rows = [(a["key"], a["context"], a["alone"], d1[k].as_py(), d2[k].as_py(), a["at"], data[a["lo"] : a["at"]][::-1], data[a["at"] : a["hi"] + window]) for a in asked[k].as_py() for _ in range(1 if a["alone"] or not groups else 2)]
                    yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)), schema=SCHEMA)

        SCHEMA = pa.schema([("key", pa.int64()), ("context", pa.int64()), ("alone", pa.bool_()), ("d1", pa.int64()), ("d2", pa.int64()), ("at", pa.int32()), ("before", pa.binary()), ("after", pa.binary())])
        ask = ask.groupBy("d1", "d2").agg(F.collect_list("a").alias("asked"))
        rows = self.slim.join(ask, ["d1", "d2"]).select("d1", "d2", "text", "asked")
        return stored(rows.mapInArrow(bytes_of, "key long, context long, alone boolean, d1 long, d2 long, at int, before binary, after binary"), "suffixes")

    def scanned(self, suffixes: DataFrame, groups: bool) -> DataFrame:
        """The trees of sorted suffixes: ranges (d1, d2, lo, end) in repeats, of contexts with one occurrence; or groups (group, key, context, before, after)."""
        window = self.window

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
            """All suffixes of some keys at a time."""
            held, n = [], 0
            for batch in batches:
                if not len(batch):
                    continue
                key = np.asarray(batch.column(0))
                new = np.flatnonzero(key[1:] != key[:-1]) + 1
                if held and key[0] != held[-1].column(0)[-1].as_py():
                    new = np.r_[0, new]
                cut = int(new[-1]) if len(new) and n + len(batch) >= SOME else 0
                if len(new) and n + len(batch) >= SOME:
                    if held or cut:
                        yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                    held, n = [batch.slice(cut)], len(batch) - cut
                else:
                    held, n = [*held, batch], n + len(batch)
            if held:
                yield pa.Table.from_batches(held)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in blocks(batches):
                keys = np.asarray(t["key"])
                trees = Trees(keys, t["before"].to_pylist(), t["after"].to_pylist(), window)
                if groups:
                    contexts, rows = np.asarray(t["context"]), []
                    for before, after, members in trees.groups():
                        key, own = int(keys[members[0]]), np.unique(contexts[members]).tolist()
                        rows += [(hash((key, before, after, own[0])), key, c, before, after) for c in own]
                    out = [np.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [[]] * 5, (np.int64, np.int64, np.int64, np.int32, np.int32), strict=True)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, out)), ["group", "key", "context", "before", "after"])
                else:
                    found, before, after = trees.covered()
                    alone = np.asarray(t["alone"])[found]
                    found, before, after = found[alone], before[alone], after[alone]
                    d1, d2, at = (np.asarray(t[c])[found] for c in ("d1", "d2", "at"))
                    yield pa.RecordBatch.from_arrays([pa.array(d1), pa.array(d2), pa.array((at - before).astype(np.int32)), pa.array((at + after).astype(np.int32))], ["d1", "d2", "lo", "end"])

        ordered = suffixes.repartition("key").sortWithinPartitions("key", "after")
        return ordered.mapInArrow(scan, "group long, key long, context long, before int, after int" if groups else "d1 long, d2 long, lo int, end int")

    def crowds(self) -> DataFrame:
        """Windows of anchor strings with more than CROWD contexts that stand at two places or more, a row for each context: (h1, h2, d1, d2, at, alone, key, context, before the anchor)."""
        ask = self.ask.where("crowded").groupBy("d1", "d2").agg(F.collect_list("a").alias("asked"))
        window = self.window

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one, two = (Rolling(window, base, seed, size=4 * window) for base, seed in ((Words.BASE, 0x9E3779B97F4A7C15), (0xD1342543DE82EF95, 0x2545F4914F6CDD1D)))
            for batch in batches:
                texts, asked, d1, d2 = (batch.column(k) for k in ("text", "asked", "d1", "d2"))
                for k in range(len(batch)):
                    data, h1, h2, at, size, own = np.frombuffer(texts[k].as_py().encode(), np.uint8), [], [], [], [], asked[k].as_py()
                    for a in own:
                        part = data[a["lo"] : a["hi"] + window]
                        h1.append(mixed(one.hashes(one.sums(part), window)).view(np.int64))
                        h2.append(mixed(two.hashes(two.sums(part), window)).view(np.int64))
                        at.append(np.arange(a["lo"], a["hi"] + 1, dtype=np.int32))
                        size.append(len(at[-1]))
                    at = np.concatenate(at)
                    key, context, alone, place = (np.repeat(np.array([a[c] for a in own]), size) for c in ("key", "context", "alone", "at"))
                    ids = [np.full(len(at), x[k].as_py(), np.int64) for x in (d1, d2)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, (np.concatenate(h1), np.concatenate(h2), *ids, at, alone, key, context, (place - at).astype(np.int32)))), ["h1", "h2", "d1", "d2", "at", "alone", "key", "context", "before"])

        rows = self.slim.join(ask, ["d1", "d2"]).select("d1", "d2", "text", "asked")
        rows = stored(rows.mapInArrow(windows, "h1 long, h2 long, d1 long, d2 long, at int, alone boolean, key long, context long, before int"), "windows")
        place = F.xxhash64("d1", "d2", "at")
        often = rows.groupBy("h1", "h2").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.every("alone").alias("alone")).where("a != b or not alone").select("h1", "h2")
        return rows.join(stored(often, "repeated"), ["h1", "h2"], "left_semi")


def slim_rows(docs: DataFrame, doc_id: str, text: str, window: int) -> DataFrame:
    d1, d2 = row_ids(doc_id, text)
    return docs.select(d1.alias("d1"), d2.alias("d2"), F.col(f"`{text}`").alias("text")).where(F.octet_length("text") >= window)


def suffix_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 400, crowd: int = CROWD) -> DataFrame:
    """The input's columns with n_bytes, n_removed, n_spans (long), spans (array of start, end) and kept_bytes (binary).

    Removes each byte of a text's UTF-8 form that is covered by a string of `window` bytes (at least 2) which also starts anywhere else,
    in any text. Spans are the longest removed runs; what is left may begin or end inside a character, so it is binary. All judged on the
    input. A null text is empty; ids play no part but to name rows, and may be null or repeated. Repeated rows are copies of each other, so
    they lose all that is a window long or longer. Input columns with the names of new ones are replaced, all others
    pass through. An empty table gives none. Strings are equal if their bytes are, or if 128 bits of hashes are (for whole contexts and crowds).
    """
    if window < 2:
        raise ValueError("a window has two bytes or more")
    spark = docs.sparkSession
    with scratch(spark) as keep, small_batches(spark):
        found = Repeats(slim_rows(docs, doc_id, text, window), window, crowd, fold=True)
        whole = found.whole().select("d1", "d2", "lo", (F.col("hi") + window).alias("end"))
        trees = found.scanned(found.contexts(False), groups=False)
        crowds = found.crowds().where("alone").select("d1", "d2", F.col("at").alias("lo"), (F.col("at") + window).alias("end"))
        ranges = whole.unionByName(trees).unionByName(crowds).unionByName(found.known).groupBy("d1", "d2").agg(F.collect_set(F.struct("lo", "end")).alias("ranges"))
        ranges = stored(ranges, "ranges")
        keep(ranges)
    d1, d2, at, cut_ = free_names(docs, "_d1", "_d2", "_ranges", "_cut")

    @F.arrow_udf("struct<spans:array<struct<start:int,end:int>>,kept:binary>")
    def cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        data, start = raw(texts)
        out = []
        for k, own in enumerate(ranges):
            if not own.is_valid:
                out.append(None)
                continue
            pairs = own.values
            lo, end = (np.asarray(pairs.field(i)).astype(np.int64) for i in (0, 1))
            order = np.argsort(lo)
            lo, end = lo[order], np.maximum.accumulate(end[order])
            new = np.flatnonzero(np.r_[True, lo[1:] > end[:-1]])
            lo, end = lo[new], end[np.r_[new[1:], len(end)] - 1]
            own = data[start[k] : start[k + 1]].tobytes()
            kept = b"".join([own[a:b] for a, b in zip([0, *end.tolist()], [*lo.tolist(), len(own)], strict=True)])
            out.append({"spans": [{"start": a, "end": b} for a, b in zip(lo.tolist(), end.tolist(), strict=True)], "kept": kept})
        return pa.array(out, pa.struct([("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.binary())]))

    rows = docs.withColumns(dict(zip((d1, d2), row_ids(doc_id, text), strict=True))).join(ranges.toDF(d1, d2, at), [d1, d2], "left").withColumn(cut_, cut(F.col(f"`{text}`"), F.col(at)))
    whole_text = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    spans = F.coalesce(F.col(f"{cut_}.spans"), F.expr("cast(array() as array<struct<start:int,end:int>>)"))
    new = {
        "n_bytes": F.octet_length(whole_text).cast("long"), "n_removed": F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]),
        "n_spans": F.size(spans).cast("long"), "spans": spans, "kept_bytes": F.when(F.col(at).isNull(), F.encode(whole_text, "utf-8")).otherwise(F.col(f"{cut_}.kept")),
    }
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new], *[c.alias(name) for name, c in new.items()])


def repeat_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 400, crowd: int = CROWD) -> DataFrame:
    """Groups of repeats, a row for each occurrence: repeat (long), n_bytes (int), row ids d1 and d2 (see row_ids), start and end (int).

    Repeats are of `window` bytes or more, with all their occurrences, and maximal within the windows of one anchor: longer ones come in pieces
    that overlap. Texts as for suffix_dedup(). Of a crowd, repeats are single windows.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep, small_batches(spark):
        found = Repeats(slim_rows(docs, doc_id, text, window), window, crowd)
        trees = stored(found.scanned(found.contexts(True), groups=True), "groups")
        crowds = found.crowds().select(F.xxhash64("h1", "h2").alias("group"), "key", "context", "before", (window - F.col("before")).alias("after"))
        whole = found.whole().join(found.some, "key", "left_anti")  # strings with one context: nothing to scan
        whole = whole.select(F.xxhash64("key", "context").alias("repeat"), "d1", "d2", F.col("lo").alias("start"), (F.col("hi") + window).alias("end"))
        rest = found.level.join(trees.unionByName(crowds), ["key", "context"])
        rest = rest.select(F.col("group").alias("repeat"), "d1", "d2", (F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.col("after")).alias("end"))
        out = stored(rest.unionByName(whole), "repeats")
        keep(out)
    return out.select("repeat", (F.col("end") - F.col("start")).alias("n_bytes"), "d1", "d2", "start", "end")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))
