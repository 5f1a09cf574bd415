"""Operator 1, MinHash near-dedup over an LSH forest.

Every distinct shingle set has labels of DEPTH minhashes, one in each of trees_for(percent) trees. In each tree the sets stand sorted by label, so
sets with a long common prefix are neighbours. First every set is held against its nearest neighbour over all
trees, which joins most groups of near copies by one link a document. Then each region (sets that share a
prefix) yields the pairs that are still in different groups; a region's depth adapts: where they are many for its
sets, it is split by the next minhash until it fits a tile, and its tiles are held against each other inside tasks,
which return only links that join groups. All candidates are confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, components, dropped, scratch, small_batches, stored, window_ids

DEPTH, LEAST_DEPTH, REGION_DEPTH = 8, 4, 5
#: The chance to miss a pair at the least similarity: where regions are LEAST_DEPTH deep, and at any depth.
MISS, DEEP_MISS = 1e-5, 1e-4
#: Minhashes that give a sketch its 256 bits.
SKETCH_HASHES = 128
#: Pairs between groups that a region may yield for each set in it before it is a crowd.
PAIRS_PER_SET = 2
#: Sets and bytes of shingle ids that a tile of a crowd holds on average.
TILE_SETS, TILE_BYTES = 2048, 1 << 24


def missed(percent: int, trees: int, depth: int) -> float:
    """The chance that a pair at the least similarity shares no label prefix of that depth in any tree."""
    return (1 - (percent / 100) ** depth) ** trees


def trees_for(percent: int) -> int:
    """The fewest trees (never fewer than a sketch needs) that keep both bounds on misses, also in the deepest regions."""
    trees = SKETCH_HASHES // DEPTH
    while missed(percent, trees, LEAST_DEPTH) > MISS or missed(percent, trees, REGION_DEPTH) > DEEP_MISS:
        trees += 1
    return trees


def most_bits(percent: int) -> int:
    """Bits that the sketches of two sets may differ in, of 256: 5.5 deviations above the mean at the least similarity."""
    far = 1 - percent / 100
    return round(128 * far + 5.5 * (128 * far * (0.5 + 1 - far)) ** 0.5)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct ids of the n-word shingles of a text's words; the whole as one if it is shorter."""
    return np.unique(window_ids(words, n if len(words) >= n else max(1, len(words))))


def signature(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for i in range(0, len(ids), 4096):
        out = np.minimum(out, ((ids[i : i + 4096, None] * a + b) >> np.uint64(32)).min(axis=0))
    return out


def sketched(docs: DataFrame, n: int, trees: int) -> DataFrame:
    """(_doc, n_shingles, s1, s2, labels, bits) of each (_doc, _text): set hash, labels of trees, one-bit sketch."""
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, trees * DEPTH * k, np.uint64) for k in (1, 1))
    a = a * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        words = Words()
        for batch in batches:
            rows = []
            for d, ids in zip(batch["_doc"], words.each(batch["_text"]), strict=True):
                ids = shingles(ids, n)
                if not len(ids):
                    rows.append((d, 0, None, None, None, None))
                    continue
                sig, raw = signature(ids, a, b), ids.tobytes()
                low = np.packbits(((sig[:SKETCH_HASHES, None] >> np.array([0, 16], np.uint64)) & np.uint64(1)).astype(np.uint8).ravel())
                label = sig.astype(">u4").tobytes()
                rows.append((d, len(ids), xxhash.xxh3_64_intdigest(raw, 1) - (1 << 63), xxhash.xxh3_64_intdigest(raw, 2) - (1 << 63), label, low.view(np.int64)))
            yield pd.DataFrame(rows, columns=["_doc", "n_shingles", "s1", "s2", "label", "bits"]).astype({"s1": "Int64", "s2": "Int64"})

    return docs.mapInPandas(run, "_doc long, n_shingles long, s1 long, s2 long, label binary, bits array<long>")


def apart(x: str, y: str) -> Column:
    """In how many bits two sketches differ."""
    return sum(F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(4))


def sizes_fit(x: str, y: str, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def confirmed(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of ids those whose full shingle sets have 100 |intersection| >= percent |union|."""
    pairs = stored(pairs, "pairs")
    used = pairs.select(F.explode(F.array("a", "b")).alias("_doc")).distinct()
    texts = docs.join(used, "_doc", "left_semi")
    left = pairs.join(texts.select(F.col("_doc").alias("a"), F.col("_text").alias("x")), "a")
    both = left.join(texts.select(F.col("_doc").alias("b"), F.col("_text").alias("y")), "b")

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            keep = []
            for x, y in zip(words.each(batch["x"]), words.each(batch["y"]), strict=True):
                own, ids = shingles(x, n), shingles(y, n)
                common = shared(own, ids)
                keep.append(100 * common >= percent * (len(own) + len(ids) - common))
            yield batch.loc[keep, ["a", "b"]]

    links = stored(both.select("a", "b", "x", "y").mapInPandas(hold, "a long, b long"), "links")
    dropped(pairs.sparkSession, pairs)
    return links


def nearest(sets: DataFrame, percent: int) -> DataFrame:
    """For each set its closest neighbour in the sorted orders of all trees, as pairs (a, b).

    Each tree is range-partitioned by label and sorted. A set's neighbours there have the longest common prefixes.
    The last row of a partition is not held against the first of the next; another tree, or the regions, will.
    """
    tree = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(trees_for(percent) - 1)), lambda t: F.substring("label", t * (4 * DEPTH) + 1, F.lit(4 * DEPTH)))).alias("tree", "order")
    rows = sets.select("_doc", "n_shingles", "bits", tree).repartitionByRange("tree", "order").sortWithinPartitions("tree", "order", "_doc")

    bound = most_bits(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            if last is not None:
                batch = pd.concat([last, batch], ignore_index=True)
            last = batch.tail(1)
            if len(batch) < 2:
                continue
            doc, size, tree = (batch[c].to_numpy() for c in ("_doc", "n_shingles", "tree"))
            order = batch["order"].tolist()
            bits = np.array(batch["bits"].tolist(), np.int64).view(np.uint8)
            far = np.unpackbits(bits[1:] ^ bits[:-1], axis=1).sum(axis=1)
            near = np.array([x[:4] == y[:4] for x, y in zip(order[1:], order[:-1], strict=True)])
            ok = near & (tree[1:] == tree[:-1]) & (far <= bound) & (100 * np.minimum(size[1:], size[:-1]) >= percent * np.maximum(size[1:], size[:-1]))
            yield pd.DataFrame({"a": np.minimum(doc[1:], doc[:-1])[ok], "b": np.maximum(doc[1:], doc[:-1])[ok], "far": far[ok].astype(np.int32)})

    found = rows.mapInPandas(run, "a long, b long, far int")
    best = found.groupBy("b").agg(F.min(F.struct("far", "a")).alias("m")).select("m.a", "b")
    other = found.groupBy("a").agg(F.min(F.struct("far", "b")).alias("m")).select("a", "m.b")
    return best.unionByName(other).distinct()


def regions(sets: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between groups: sets that share a region, at the depth that adapts to the region."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees_for(percent) - 1))).alias("tree")
    rows = sets.select("_doc", "n_shingles", "bits", "root", "label", tree)
    depths = range(LEAST_DEPTH, REGION_DEPTH + 1)
    prefix = lambda d: F.xxhash64("tree", F.lit(d), F.expr(f"substring(label, tree * {4 * DEPTH} + 1, {4 * d})"))
    rest = rows.select("tree", "_doc", "n_shingles", "bits", "root", *[prefix(d).alias(f"p{d}") for d in depths])
    pairs, crowds = [], []
    for d in depths:
        p = f"p{d}"
        groups = rest.groupBy(p, "root").agg(F.count("*").alias("n"))
        size = groups.groupBy(p).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count("*").alias("groups")).where("groups > 1")
        few, fits = F.col("n") * F.col("n") - F.col("n2") <= 2 * PAIRS_PER_SET * F.col("n"), (F.col("n") <= TILE_SETS) | F.lit(d == REGION_DEPTH)
        size = stored(size.select(p, F.when(few, "few").when(fits, "crowd").otherwise("deeper").alias("way")), "regions")
        way = lambda x: rest.join(size.where(F.col("way") == x).select(p), p)  # noqa: B023, E731
        pairs.append(between(way("few"), p, percent))
        crowds.append(way("crowd").select("tree", "_doc", F.col(p).alias("p")))
        deeper = size.where("way = 'deeper'")
        if deeper.isEmpty():
            break
        rest = stored(way("deeper"), "deeper")
    crowd = stored(reduce(DataFrame.unionByName, crowds), "crowd")
    links = confirmed(reduce(DataFrame.unionByName, pairs).distinct(), docs, n, percent)
    return links.unionByName(crowd_links(crowd, sets, docs, n, percent))


def between(rows: DataFrame, p: str, percent: int) -> DataFrame:
    """Pairs with the same p, of different groups, that sizes and sketches leave possible."""
    x, y = (rows.select(p, *[F.col(c).alias(f"{c}_{s}") for c in ("_doc", "n_shingles", "bits", "root")]) for s in "ab")
    possible = (F.col("_doc_a") < F.col("_doc_b")) & (F.col("root_a") != F.col("root_b")) & sizes_fit("n_shingles_a", "n_shingles_b", percent) & (apart("bits_a", "bits_b") <= most_bits(percent))
    return x.join(y, (x[p] == y[p]) & possible).select(F.col("_doc_a").alias("a"), F.col("_doc_b").alias("b"))


def crowd_links(crowd: DataFrame, sets: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) that join the groups of crowded regions, from rows (p, tree, _doc).

    A region is cut into tiles of bounded sets and bytes, and every two tiles meet in a task of their own, which holds
    full sets against each other and returns a spanning forest: pairs of a crowd never leave a task. A pair that also
    shares a region in an earlier tree is left to that one.
    """
    texts = docs.join(crowd.select("_doc").distinct(), "_doc", "left_semi")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            yield pd.DataFrame({"_doc": batch["_doc"], "ids": [shingles(x, n).tobytes() for x in words.each(batch["_text"])]})

    full = texts.select("_doc", "_text").mapInPandas(each, "_doc long, ids binary").dropDuplicates(["_doc"])
    full = stored(full.join(sets.select("_doc", "n_shingles", "root", "bits", "label"), "_doc"), "crowd-sets")
    rows = crowd.join(full.select("_doc", "n_shingles"), "_doc")
    size = rows.groupBy("p").agg(F.count("*").alias("_sets"), F.sum("n_shingles").alias("_ids"))
    tiles = F.greatest(F.lit(1), F.ceil(F.col("_sets") / TILE_SETS), F.ceil(F.col("_ids") * 8 / TILE_BYTES)).cast("long")
    rows = rows.join(size.select("p", tiles.alias("_tiles")), "p").withColumn("_tile", F.pmod(F.xxhash64("_doc"), "_tiles"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1)).alias("_other")
    rows = rows.select("p", "tree", "_doc", "_tile", other)
    met = rows.select("p", "tree", "_doc", F.least("_tile", "_other").alias("i"), F.greatest("_tile", "_other").alias("j"), (F.col("_tile") <= F.col("_other")).alias("left"))
    met = met.join(full, "_doc")
    most, trees = most_bits(percent), trees_for(percent)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_doc", ignore_index=True)
        tree, same = int(group["tree"].iloc[0]), group["i"].iloc[0] == group["j"].iloc[0]
        doc, size = group["_doc"].to_numpy(), group["n_shingles"].to_numpy()
        bits = np.array(group["bits"].tolist(), np.int64).view(np.uint64)
        labels = np.array([np.frombuffer(x, ">u4") for x in group["label"]]).reshape(-1, trees, DEPTH)[:, :tree, :REGION_DEPTH]
        ids = [np.frombuffer(x, np.uint64) for x in group["ids"]]
        _, root = np.unique(group["root"].to_numpy(), return_inverse=True)
        here = np.arange(len(doc))
        a, b = (here, here) if same else (here[group["left"]], here[~group["left"]])
        up, links = list(range(len(doc))), []

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for k in range(0, len(a), 128):
            u = a[k : k + 128]
            ok = (root[u][:, None] != root[b]) & (100 * np.minimum(size[u][:, None], size[b]) >= percent * np.maximum(size[u][:, None], size[b]))
            if same:
                ok &= u[:, None] < b
            x, y = np.nonzero(ok)
            x, y = u[x], b[y]
            near = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1) <= most
            x, y = x[near], y[near]
            new = ~(labels[x] == labels[y]).all(axis=2).any(axis=1)
            for v, w in zip(x[new].tolist(), y[new].tolist(), strict=True):
                s, t = top(root[v]), top(root[w])
                if s != t:
                    common = shared(ids[v], ids[w])
                    if 100 * common >= percent * (len(ids[v]) + len(ids[w]) - common):
                        up[s] = t
                        links.append((doc[v], doc[w]))
        return pd.DataFrame(np.array(links, np.int64).reshape(-1, 2), columns=["a", "b"])

    return stored(met.groupBy("p", "i", "j").applyInPandas(meet, "a long, b long"), "crowd-links")


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many ids two sorted arrays of distinct ids have in common."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 85) -> DataFrame:
    """Per input row: the id, n_shingles (long), component_id, kept (component_id is the row's own id).

    Documents are linked if 100 times the intersection of their shingle sets is at least percent times the union.
    Equal sets are one set from the start, whatever their number. Without words a document is empty and linked with
    nothing. Ids are whole numbers; a row without id takes no part: component_id null, kept true. Rows with one id
    are one document: they share a component. A pair at the least similarity shares a region in at least one tree with
    probability 0.9999 or more, 0.99999 where regions are LEAST_DEPTH deep; trees_for(percent) has as many as it takes.
    """
    with scratch(docs.sparkSession) as keep, small_batches(docs.sparkSession):
        out = grouped(docs.select(F.col(doc_id).cast("long").alias("_doc"), F.col(text).alias("_text")), words, percent)
        keep(out)
    component = F.coalesce("root", "_doc")
    return out.select(F.col("_doc").alias(doc_id), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("_doc"), F.lit(True)).alias("kept"))


def grouped(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(_doc, n_shingles, root) of rows (_doc, _text), stored."""
    spark = rows.sparkSession
    facts = stored(sketched(rows, words, trees_for(percent)), "sketches")
    named = facts.where("_doc is not null and n_shingles > 0")
    sets = stored(named.groupBy("s1", "s2").agg(F.min_by(F.struct("_doc", "n_shingles", "label", "bits"), "_doc").alias("m")).select("s1", "s2", "m.*"), "sets")
    same = named.join(sets.select("s1", "s2", F.col("_doc").alias("a")), ["s1", "s2"]).select("a", F.col("_doc").alias("b")).where("a < b")
    same, sizes = stored(same, "copies"), stored(facts.select("_doc", "n_shingles"), "sizes")
    dropped(spark, facts)
    texts = rows.where("_doc is not null")
    links = confirmed(nearest(sets, percent), texts, words, percent)
    groups = components(links)
    rooted = sets.drop("s1", "s2").join(groups.withColumnRenamed("id", "_doc"), "_doc", "left").withColumn("root", F.coalesce("root", "_doc"))
    rooted = stored(rooted, "rooted")
    dropped(spark, sets)
    more = regions(rooted, texts, words, percent)
    dropped(spark, rooted)
    final = components(links.unionByName(more).unionByName(same))
    return stored(sizes.join(final.withColumnRenamed("id", "_doc"), "_doc", "left"), "groups")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs)
