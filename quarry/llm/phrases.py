"""Operator 13, phrase collocation mining: depth-limited count tries of shards, merged by prefix range.

A first pass serialises of every shard the hashes of its words and word pairs, sorted, with counts, in blocks of hash ranges; a range's blocks
are merged and the hashes that reach the least count go into a bit filter of fixed size. A second pass does the same for triples whose pairs pass.
The third pass builds a count trie of each shard, of words and phrases all of whose words, pairs and triples pass the filter (others can't reach the
least count); a task merges its shards' tries and stores them serialised in trie order. A sample of their nodes gives prefix ranges of about equal size, at which
all tries are cut; a range's pieces are merged, and a walk down the merged trie gives the left parts of each phrase. Right parts come by suffix links, from
a phrase to the one without its first word, a depth at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, dropped, mixed, scratch, small_batches, stored
from .texts import parts, raw

#: Words of a shard, whose trie a task holds in memory. Below 2**21, so that three of a shard's word numbers fit into 63 bits.
SHARD_WORDS = 700_000
#: Bits of the filter that is broadcast: 8 MB, however many pairs there are. When it fills, more phrases are counted in vain.
FILTER_BITS = 1 << 26
#: Bytes of text for which one hash range is made.
RANGE_BYTES = 1 << 24
#: Marks of a text at which pieces end; no phrase goes on over them.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Nodes that a task holds while it merges the tries of its shards; of a serialised piece; and of a prefix range over all tries, about.
MERGED_NODES, PIECE_NODES, RANGE_NODES = 1_500_000, 200_000, 500_000
#: Nodes that are sampled to find the ranges, at most; there are at most a twentieth as many ranges.
MOST_SAMPLED = 1_000_000
PIECE = "nodes int, w1 binary, w2 binary, w3 binary, w4 binary, n binary"
C1, C2, C3 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
W = ["w1", "w2", "w3", "w4"]
NONE = np.iinfo(np.int64).min


class PieceWords(Words):
    """Words between spaces, tabs and ends of pieces, with the number of the piece that each stands in."""

    def __init__(self):
        super().__init__(lower=True)
        self.ends = np.zeros(256, bool)
        self.ends[list(PIECE_ENDS)] = True
        self.blank |= self.ends
        self.values[self.blank] = 0

    def spans(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """Start, end, id and piece of all words in bytes that close with a blank."""
        found, at, before = [], 0, 0
        while at < len(data):
            stop, more = min(len(data), at + self.size), self.size
            while stop < len(data) and not self.blank[data[stop - 1]]:
                blanks = np.flatnonzero(self.blank[data[stop : stop + more]])
                stop = stop + int(blanks[0]) + 1 if len(blanks) else min(len(data), stop + more)
            part = data[at:stop]
            start, ids = self._part(part)
            end = np.flatnonzero(self.blank[part] & ~np.r_[True, self.blank[part[:-1]]])
            piece = np.cumsum(self.ends[part]) + before
            found.append(((start + at).astype(np.int32), (end + at).astype(np.int32), ids, piece[start].astype(np.int32)))
            at, before = stop, int(piece[-1])
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else tuple(np.empty(0, t) for t in (np.int32, np.int32, np.uint64, np.int32))


class Shard:
    """Some words of a task's texts, up to 2 GB: ids that hang on word and language, pieces, and where each word's bytes are."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray, piece: np.ndarray, text: np.ndarray, langs: list[str]):
        self.data, self.start, self.end, self.ids, self.text, self.langs = data, start, end, ids, text, langs
        self.together = piece[1:] == piece[:-1]  # the next word stands in the same piece

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and of each word with the next."""
        return mixed(self.ids * C1), mixed(self.ids[:-1] * C1 + self.ids[1:] * C2)

    def triples(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the words at some places with the two after them."""
        return mixed(self.ids[at] * C1 + self.ids[at + 1] * C2 + self.ids[at + 2] * C3)

    def frequent_pairs(self, bits: np.ndarray, cut: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Words that pass the filter, and words that pass it with the next one of their piece."""
        one, two = self.keys()
        fit = passing(bits, one >> cut)
        pairs = self.together & fit[1:] & fit[:-1]
        pairs[pairs] = passing(bits, two[pairs] >> cut)
        return fit, pairs


def shards(batches: Iterator[pa.RecordBatch], words: PieceWords) -> Iterator[Shard]:
    """The texts of a task's batches of (text, lang, lang's hash), SHARD_WORDS or a long text at a time."""
    held, n, texts, langs = [], 0, 0, []

    def made() -> Shard:
        offset = np.cumsum([0, *[len(h[0]) for h in held]])
        data, start, end, ids, piece, text = zip(*held, strict=True)
        held.clear()
        pieces = np.cumsum([0, *[int(p[-1]) + 1 if len(p) else 0 for p in piece]])
        moved = lambda arrays, by: np.concatenate([a + np.int32(b) for a, b in zip(arrays, by[:-1], strict=True)])
        return Shard(np.concatenate(data), moved(start, offset), moved(end, offset), np.concatenate(ids), moved(piece, pieces), np.concatenate(text), langs)

    for batch in batches:
        hashes = np.asarray(batch.column(2)).view(np.uint64)
        names = batch.column(1).to_pylist()
        for i, j, data, at in parts(*raw(batch.column(0)), most=1 << 20):
            room = np.full(len(data) + j - i, ord("\n"), np.uint8)  # a text ends its last piece
            room[np.arange(len(data)) + np.repeat(np.arange(j - i), np.diff(at))] = data
            start, end, ids, piece = words.spans(room)
            text = (np.searchsorted(at + np.arange(j - i + 1), start, "right") - 1).astype(np.int32)
            ids = mixed(ids ^ hashes[i:j][text])
            ids[ids == np.uint64(1 << 63)] += np.uint64(1)  # stands for no word
            held.append((room, start, end, ids, piece, text + texts))
            n, texts = n + len(start), texts + j - i
            langs += names[i:j]
            if n >= SHARD_WORDS:
                yield made()
                n, texts, langs = 0, 0, []
    if n:
        yield made()


def bit_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = mixed(keys)
    return x & np.uint64(FILTER_BITS - 1), (x >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)


def passing(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    for place in bit_places(keys):
        out &= (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) > 0
    return out


def frequent_filter(texts: DataFrame, least: int, range_bits: int, known=None) -> np.ndarray:
    """Bits that are set for all words and pairs that stand `least` times or more in a language; few others pass. known: a broadcast filter of
    these; then the same for triples whose pairs pass it.

    Hashes are cut to 32 bits beyond the range; those that fall together only let more pass.
    """
    kind = np.uint8 if least <= 255 else np.uint32
    cut = np.uint64(32 - range_bits)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = PieceWords()
        for shard in shards(batches, words):
            if known is None:
                one, two = shard.keys()
                keys = np.concatenate([one, two[shard.together]])
            else:
                _, pairs = shard.frequent_pairs(known.value, cut)
                keys = shard.triples(np.flatnonzero(pairs[:-1] & pairs[1:]))
            keys, n = np.unique(keys >> cut, return_counts=True)
            n = np.minimum(n, least).astype(kind)  # a shard's count that is enough by itself stays enough
            edge = np.searchsorted(keys >> np.uint64(32), np.arange((1 << range_bits) + 1, dtype=np.uint64))
            rest = keys.astype(np.uint32)
            rows = [(r, rest[a:b].tobytes(), n[a:b].tobytes()) for r, (a, b) in enumerate(zip(edge, edge[1:], strict=False)) if a < b]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["range", "keys", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, int] = {}

        def close(r: int, held: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            keys = np.concatenate([np.frombuffer(k, np.uint32) for k, _ in held])
            n = np.concatenate([np.frombuffer(x, kind) for _, x in held]).astype(np.int64)
            order = np.argsort(keys, kind="stable")  # runs that are sorted already
            keys, n = keys[order], n[order]
            new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            keys = keys[new][np.add.reduceat(n, new) >= least].astype(np.uint64) | (np.uint64(r) << np.uint64(32))
            place = np.unique(np.concatenate(bit_places(keys)))
            word, first = np.unique(place >> np.uint64(6), return_index=True)
            own = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first) if len(first) else place
            return pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(own.view(np.int64))], ["word", "bits"])

        r, held = None, []
        for batch in batches:
            for x, k, n in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                if held and x != r:
                    yield close(r, held)
                    held = []
                r = x
                held.append((k, n))
        if held:
            yield close(r, held)

    made = texts.mapInArrow(blocks, "range int, keys binary, n binary")
    merged = made.repartition("range").sortWithinPartitions("range").mapInArrow(merge, "word int, bits long")
    found = merged.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    out = np.zeros(FILTER_BITS >> 6, np.uint64) if known is None else known.value.copy()
    out[np.asarray(found["word"])] |= np.asarray(found["bits"]).view(np.uint64)
    return out


def trie(shard: Shard, pairs: np.ndarray, triples: np.ndarray, most_words: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's phrases of two words or more as (path of four ids, count), in trie order.

    pairs: words with the next, and triples: words with the next two, that may be part of a phrase.
    """
    at = np.flatnonzero(pairs)
    ids = shard.ids.view(np.int64)
    known, number = np.unique(ids, return_inverse=True)
    number = np.r_[number + 1, 0, 0, 0]
    goes = np.r_[triples, False, False, False, False]
    codes = [number[at], number[at + 1]]
    more = np.ones(len(at), bool)
    for k in (2, 3):
        more = more & goes[at + k - 2] & (k < most_words)
        codes.append(np.where(more, number[at + k], 0))
    order = np.lexsort(codes[::-1]) if len(known) >= 1 << 21 else np.lexsort((codes[3], (codes[0] << 42) | (codes[1] << 21) | codes[2]))
    codes = [c[order] for c in codes]
    new, rows = np.r_[True, codes[0][1:] != codes[0][:-1]], []
    for k in range(1, 4):
        new = new | np.r_[True, codes[k][1:] != codes[k][:-1]]
        first = np.flatnonzero(new) if len(at) else np.empty(0, np.int64)
        n = np.diff(np.r_[first, len(at)])
        here = codes[k][first] > 0
        rows.append((first[here], np.full(here.sum(), k), n[here]))
    first, depth, n = map(np.concatenate, zip(*rows, strict=True))
    order = np.lexsort((depth, first))
    first, depth, n = first[order], depth[order], n[order]
    known = np.r_[NONE, known]
    path = np.stack([np.where(depth >= k, known[codes[k][first]], NONE) for k in range(4)])
    return path, n


def merged(tries: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Several tries as one, in trie order."""
    path, n = (np.concatenate(x, axis=-1) for x in zip(*tries, strict=True))
    order = np.lexsort(path[::-1])
    path, n = path[:, order], n[order]
    new = np.flatnonzero(np.r_[True, (path[:, 1:] != path[:, :-1]).any(axis=0)]) if len(n) else np.empty(0, np.int64)
    return path[:, new], np.add.reduceat(n, new) if len(n) else n


class Vocabulary:
    """Counts of words with the words themselves and their languages, added up over a task's shards."""

    def __init__(self):
        self.ids, self.n, self.lang, self.word = np.empty(0, np.int64), np.empty(0, np.int64), pa.array([], pa.string()), pa.array([], pa.string())

    def add(self, shard: Shard, fit: np.ndarray, lower: np.ndarray) -> None:
        at = np.flatnonzero(fit)
        ids, first, n = np.unique(shard.ids[at].view(np.int64), return_index=True, return_counts=True)
        new = ~np.isin(ids, self.ids)
        data, where = lower[shard.data], at[first[new]]
        word = pa.array([data[a:b].tobytes() for a, b in zip(shard.start[where], shard.end[where], strict=True)], pa.binary()).cast(pa.string())
        lang = pa.array([shard.langs[t] for t in shard.text[where]], pa.string())
        every = np.concatenate([self.ids, ids[new]])
        order = np.argsort(every)
        counts = np.concatenate([self.n, np.zeros(new.sum(), np.int64)])[order]
        self.ids, self.lang, self.word = every[order], pa.concat_arrays([self.lang, lang]).take(pa.array(order)), pa.concat_arrays([self.word, word]).take(pa.array(order))
        counts[np.searchsorted(self.ids, ids)] += n
        self.n = counts


def serialised(path: np.ndarray, n: np.ndarray) -> list:
    """The columns of PIECE for a trie or a piece of one."""
    return [len(n), *[w.tobytes() for w in path], n.astype(np.int64).tobytes()]


def parsed(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.stack([np.frombuffer(row[w], np.int64) for w in W]), np.frombuffer(row["n"], np.int64)


def places_of(edges: np.ndarray, path: np.ndarray) -> np.ndarray:
    """How many of the sorted nodes stand before each of the sorted edges."""
    both = np.concatenate([edges, path], axis=1)
    node = np.r_[np.zeros(edges.shape[1], np.int64), np.ones(path.shape[1], np.int64)]
    order = np.lexsort((node, *both[::-1]))
    return np.cumsum(node[order])[node[order] == 0]


def range_edges(tries: DataFrame) -> np.ndarray:
    """Paths (four rows) at which all prefix ranges but the first begin, from a sample of all nodes."""
    nodes = tries.agg(F.sum("nodes")).first()[0] or 0
    ranges = min(MOST_SAMPLED // 20, max(nodes // RANGE_NODES, min(nodes, int(tries.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    step = max(1, nodes // max(1, 20 * ranges))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(w) for w in parsed(row)[0][:, step // 2 :: step]], W)

    found = tries.mapInArrow(sample, ", ".join(f"{w} long" for w in W)).toArrow()  # about 20 rows a range
    path = np.stack([np.asarray(found[w]) for w in W])
    path = path[:, np.lexsort(path[::-1])]
    path = path[:, np.unique(np.arange(1, ranges) * path.shape[1] // max(1, ranges))] if path.shape[1] and ranges > 1 else path[:, :0]
    new = np.r_[True, (path[:, 1:] != path[:, :-1]).any(axis=0)] if path.shape[1] else np.empty(0, bool)
    return path[:, new]


def cut_at(edges):
    """Cuts serialised tries at the edges of ranges: (range, PIECE)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                path, n = parsed(row)
                at = np.r_[0, places_of(edges.value, path), len(n)]
                rows += [(r, *serialised(path[:, a:b], n[a:b])) for r, (a, b) in enumerate(zip(at, at[1:], strict=False)) if a < b]
            if rows:
                kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["range", "nodes", *W, "n"])

    return cut


def walked(least: int):
    """Merges the pieces of each range and walks down: (part, head, w1..w4, a, l1, l2, l3) of nodes with least or more, l1..l3 the counts of the nodes
    above, null where those stand in an earlier range; and the first node of the range once more as head."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(part: int, pieces: list) -> pa.RecordBatch:
            path, n = merged(pieces)
            depth, i = (path != NONE).sum(axis=0), np.arange(len(n))
            left = []
            for k in (1, 2, 3):
                at = np.maximum.accumulate(np.where(depth == k, i, -1))
                same = (at >= 0) & (depth > k)
                for j in range(k):
                    same &= path[j, at] == path[j]
                left.append(np.where(same, n[at], -1))
            keep = np.r_[0, np.flatnonzero(n >= least)]
            head = np.arange(len(keep)) == 0
            of = lambda x, none: pa.array(x[keep], mask=x[keep] == none)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), part, np.int32)), pa.array(head), *[of(path[k], NONE) for k in range(4)], pa.array(n[keep]), *[of(x, -1) for x in left]], ["part", "head", *W, "a", "l1", "l2", "l3"])

        part, pieces = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if pieces and row["range"] != part:
                    yield close(part, pieces)
                    pieces = []
                part = row["range"]
                pieces.append(parsed(row))
        if pieces:
            yield close(part, pieces)

    return walk


def counted(docs: DataFrame, text: str, lang: str, least: int, most_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables: nodes (w1..w4, a, l1..l3) that stand `least` times or more, names (id, lang, word), totals (lang, n)."""
    texts = docs.select(F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang")).withColumn("h", F.xxhash64("lang")).where("text is not null")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    range_bits = min(24, max(6, (size // RANGE_BYTES).bit_length()))
    context = docs.sparkSession.sparkContext
    bits = context.broadcast(frequent_filter(texts, least, range_bits))
    if most_words > 2:
        bits = context.broadcast(frequent_filter(texts, least, range_bits, bits))
    cut = np.uint64(32 - range_bits)
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, vocabulary, tries, totals = PieceWords(), Vocabulary(), [], Counter()
        for shard in shards(batches, words):
            fit, pairs = shard.frequent_pairs(bits.value, cut)
            at = np.flatnonzero(pairs[:-1] & pairs[1:]) if most_words > 2 else np.empty(0, np.int64)
            triples = np.zeros(len(pairs), bool)
            triples[at] = passing(bits.value, shard.triples(at) >> cut)
            tries.append(trie(shard, pairs, triples, most_words))
            vocabulary.add(shard, fit, lower)
            if sum(len(n) for _, n in tries) + len(vocabulary.ids) > MERGED_NODES:
                tries = [merged(tries)]
                if len(tries[0][1]) + len(vocabulary.ids) > MERGED_NODES // 2:
                    yield from written(tries, vocabulary)
                    vocabulary, tries = Vocabulary(), []
            langs, code = np.unique(np.array(shard.langs, object), return_inverse=True)
            totals.update(dict(zip(langs.tolist(), np.bincount(code[shard.text], minlength=len(langs)).tolist(), strict=True)))
        yield from written(tries, vocabulary)
        yield table(lang=pa.array(list(totals), pa.string()), total=pa.array(list(totals.values()), pa.int64()))

    def written(tries: list, v: Vocabulary) -> Iterator[pa.RecordBatch]:
        """Names of words, and the trie with all words as its first level, in pieces."""
        absent = np.full(len(v.ids), NONE)
        path, n = merged([*tries, (np.stack([v.ids, absent, absent, absent]), v.n)])
        for k in range(0, len(n), PIECE_NODES):
            piece = serialised(path[:, k : k + PIECE_NODES], n[k : k + PIECE_NODES])
            yield table(nodes=pa.array([piece[0]], pa.int32()), **{c: pa.array([x], pa.binary()) for c, x in zip([*W, "n"], piece[1:], strict=True)})
        yield table(id=pa.array(v.ids), lang=v.lang, word=v.word)

    def table(**columns: pa.Array) -> pa.RecordBatch:
        rows = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in SCHEMA], schema=SCHEMA)

    SCHEMA = pa.schema([("nodes", pa.int32()), *[(c, pa.binary()) for c in [*W, "n"]], ("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("total", pa.int64())])
    made = stored(texts.mapInArrow(build, f"{PIECE}, id long, lang string, word string, total long"), "tries")
    totals = stored(made.where("total is not null").groupBy("lang").agg(F.sum("total").alias("n")), "totals")
    words = made.where("word is not null").groupBy("id").agg(F.min("lang").alias("lang"), F.min("word").alias("word"))
    words = stored(words, "words")
    tries = made.where("nodes is not null").select("nodes", *W, "n")
    edges = context.broadcast(range_edges(tries))
    cuts = tries.mapInArrow(cut_at(edges), f"range int, {PIECE}").repartition("range").sortWithinPartitions("range")
    nodes = stored(cuts.mapInArrow(walked(least), "part int, head boolean, w1 long, w2 long, w3 long, w4 long, a long, l1 long, l2 long, l3 long"), "nodes")
    dropped(docs.sparkSession, made)
    # Nodes above the first of a range stand in an earlier one: one row a range.
    heads = F.broadcast(nodes.where("head").select("part", *W[:3]))
    found = None
    for k in (1, 2, 3):
        upper = nodes.where(~F.col("head") & F.col(W[k - 1]).isNotNull() & F.col(W[k]).isNull()).select(*W[:k], "a")
        here = upper.join(heads, W[:k]).select("part", F.lit(k).alias("k"), "a")
        found = here if found is None else found.unionByName(here)
    heads = stored(found.groupBy("part").agg(*[F.max(F.when(F.col("k") == k, F.col("a"))).alias(f"h{k}") for k in (1, 2, 3)]), "heads")
    above = [F.when(F.col(W[k]).isNotNull(), F.coalesce(f"l{k}", f"h{k}")).alias(f"l{k}") for k in (1, 2, 3)]
    nodes = nodes.where(~F.col("head")).join(F.broadcast(heads), "part", "left").select(*W, "a", *above)
    return stored(nodes, "nodes"), words, totals


def right_parts(nodes: DataFrame) -> DataFrame:
    """The phrases of two words or more, with the counts r1..r3 of what is left when that many first words are cut off.

    A suffix link leads from a phrase to the one without its first word, whose own links lead on.
    """
    found = nodes.where("w2 is null").select("w1", "a")
    out = None
    for depth in (2, 3, 4):
        to = found.select(*[F.col(W[k]).alias(W[k + 1]) for k in range(depth - 1)], F.col("a").alias("r1"), *[F.col(f"r{k}").alias(f"r{k + 1}") for k in range(1, depth - 1)])
        here = nodes.where(F.col(W[depth - 1]).isNotNull() & (F.col(W[depth]).isNull() if depth < 4 else F.lit(True)))
        found = stored(here.join(to, W[1:depth]).select(*W, "a", "l1", "l2", "l3", *[f"r{k}" for k in range(1, depth)]), "linked")
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out


def exact(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", most_words: int = 4, least: int = 30, keep_share: int = 80, scale: int = 1_000_000) -> DataFrame:
    """Phrases of 2 to most_words (at most 4) words that stand at least `least` times, a row each: lang, phrase, a, l, r, n, score (long).

    A-Z count as a-z. Pieces of a text end at PIECE_ENDS, and words are what stands between spaces and tabs in a piece.
    a counts a phrase in all texts of its language (null: und), n all words of that language. A phrase is cut in two after each of its words; the cut with the
    least score floor(2 * scale * a / (l + r)) counts, ties go to the first, with the counts l and r of its two parts. A phrase that stands inside a longer one with
    100 * a(longer) >= keep_share * a is dropped, whether the longer one is or not. Null and empty texts have no words; repeated rows count as often as they
    stand; other columns play no part; an empty table gives none. Words are told apart by 64 bits of a hash.
    """
    if not 2 <= most_words <= 4:
        raise ValueError("most_words must be 2, 3 or 4")
    with scratch(docs.sparkSession) as keep, small_batches(docs.sparkSession):
        nodes, names, totals = counted(docs, text, lang, least, most_words)
        phrases = right_parts(nodes)
        score = lambda k: F.expr(f"cast(cast(a as decimal(19,0)) * {2 * scale} div (cast(l{k} as decimal(19,0)) + cast(r{k} as decimal(19,0))) as bigint)")
        cuts = [F.when(F.col(f"r{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in (1, 2, 3)]
        none = F.lit(None).cast("long")
        part = lambda *at: F.struct(*[(F.col(W[at[i]]) if i < len(at) else none).alias(W[i]) for i in range(3)])
        inside = F.when(F.col("w4").isNull(), F.array(part(0, 1), part(1, 2))).otherwise(F.array(part(0, 1, 2), part(1, 2, 3), part(0, 1), part(1, 2), part(2, 3)))
        longer = phrases.where("w3 is not null").select("a", F.explode(inside).alias("p")).groupBy("p.w1", "p.w2", "p.w3").agg(F.max("a").alias("longer")).toDF("x1", "x2", "x3", "longer")
        same = (F.col("w1") == F.col("x1")) & (F.col("w2") == F.col("x2")) & F.col("w3").eqNullSafe(F.col("x3")) & F.col("w4").isNull()
        kept = phrases.join(longer, same, "left").where(F.col("longer").isNull() | (100 * exact("longer") < keep_share * exact("a")))
        kept = kept.select(*W, "a", F.array_min(F.array_compact(F.array(*cuts))).alias("cut"))
        for w in W:
            word = names.select(F.col("id").alias(w), F.col("word").alias(f"_{w}"), *(["lang"] if w == "w1" else []))
            kept = kept.join(word, w, "inner" if w == "w1" else "left")
        out = kept.select("lang", F.concat_ws(" ", *[f"_{w}" for w in W]).alias("phrase"), "a", "cut.l", "cut.r", "cut.score").join(totals, "lang")
        out = stored(out.select("lang", "phrase", "a", "l", "r", "n", "score"), "phrases")
        keep(out)
    return out


def top_phrases(found: DataFrame, most: int = 2000, salts: int = 8) -> DataFrame:
    """The first `most` of each language by score, count (both falling) and phrase, with rank (long, from 1).

    Each of `salts` parts of a language is cut to its own first rows before they meet, so a window sorts at most salts * most rows.
    """
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = found.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return first(first(rows, "lang", "_salt").drop("rank"), "lang").drop("_salt")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    return top_phrases(collocations(docs)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
