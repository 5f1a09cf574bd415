"""Operator 7, embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine of at least t lie within squared distance 2 - 2t. Rotated and cut into BLOCKS blocks,
such a pair spends at most a block's share of that budget in at least one block. Distinct vectors are dealt to tiles,
one row each, and a Cartesian product of that stored table brings every two tiles to a task: it reads tiles again, so
nothing is copied to disk for the pairs. There each block is range-joined by itself: one tile is halved at medians of
the block's coordinates again and again, and a part meets only the vectors of the other tile within the block's radius of its box.
A pair is verified exactly, on the stored vectors in double precision, in the first block whose budget it keeps, so the
union of candidates needs no distinct and no pair leaves a task: tasks return sums of links and a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, scratch, small_batches, stored

BLOCKS = 4
#: Vectors and numbers that a tile holds: a task compares two tiles at a time. Fewer vectors make LEAST_TILES tiles, unless these had under 512.
TILE, VALUES, LEAST_TILES = 1 << 15, 1 << 21, 8
#: Vectors of a part that is not halved any more, and candidates that are verified at once.
LEAF, PIECE = 512, 50_000


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int = 5) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]


def rotated(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision, rotated by a fixed random rotation of their dimension; zeros where the size leaves double precision."""
    with np.errstate(all="ignore"):
        y = ((x / size[:, None]) @ rotation(x.shape[1])).astype(np.float32)
    y[~np.isfinite(y).all(axis=1)] = 0
    return y


def cuts(dim: int) -> list[slice]:
    """The blocks of a dimension."""
    edge = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def slack(dim: int) -> float:
    """More than single precision can err in a squared distance of two vectors of at most unit size."""
    return (dim + 16) * 4.8e-7


def budgets(dim: int, cosine: float) -> np.ndarray:
    """The squared distance that each block may spend."""
    sizes = [s.stop - s.start for s in cuts(dim)]
    return np.array([(2 - 2 * cosine) * n / dim + slack(n) for n in sizes])


def close(a: np.ndarray, b: np.ndarray, most: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a and of b within a squared distance of `most`, and few others, in pieces."""
    square = lambda x: (x * x).sum(axis=1, keepdims=True)
    one = lambda x: np.ones((len(x), 1), x.dtype)
    left, right = np.hstack([-2 * a, square(a), one(a)]), np.hstack([b, one(b), square(b)])  # their product is the squared distance
    todo = [(np.arange(len(a)), np.arange(len(b)))]
    while todo:
        p, q = todo.pop()
        box, y = b[q], a[p]
        y -= np.clip(y, box.min(axis=0), box.max(axis=0))
        p = p[np.einsum("ij,ij->i", y, y) <= most]
        if len(p) and len(q) > LEAF:
            half = len(q) // 2
            order = q[np.argpartition(box[:, box.var(axis=0).argmax()], half)]
            todo += [(p, order[:half]), (p, order[half:])]
            continue
        for lo in range(0, len(p), 1024):
            part = p[lo : lo + 1024]
            near = np.flatnonzero(left[part] @ right[q].T <= most)
            if len(near):
                i, j = np.divmod(near, len(q))
                yield part[i], q[j]


def pieces(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs, PIECE at once."""
    held, n = [], 0
    for pair in pairs:
        held.append(pair)
        n += len(pair[0])
        if n >= PIECE:
            u, w = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from ((u[k : k + PIECE], w[k : k + PIECE]) for k in range(0, n, PIECE))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def linked(xa: np.ndarray, xb: np.ndarray, cosine: float, once: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of xa and of xb with a cosine of at least `cosine`, each pair in one piece. once: the two are one, and a pair comes one way."""
    dim = xa.shape[1]
    size_a, size_b = (np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)) for x in (xa, xb))
    ya, yb = rotated(xa, size_a), rotated(xb, size_b)
    parts, most = cuts(dim), budgets(dim, cosine)
    starts, whole = [s.start for s in parts], 2 - 2 * cosine + slack(dim)
    for block, s in enumerate(parts):
        found = close(np.ascontiguousarray(ya[:, s]), np.ascontiguousarray(yb[:, s]), most[block] + slack(s.stop - s.start))
        for u, w in pieces((p[p < q], q[p < q]) if once else (p, q) for p, q in found):
            d = np.add.reduceat((ya[u] - yb[w]) ** 2, starts, axis=1)
            ok = (d[:, block] <= most[block]) & (d[:, :block] > most[:block]).all(axis=1) & (d.sum(axis=1) <= whole)
            u, w = u[ok], w[ok]
            with np.errstate(all="ignore"):
                ok = (xa[u].astype(np.float64) * xb[w]).sum(axis=1) / (size_a[u] * size_b[w]) >= cosine
            yield u[ok], w[ok]


def joining(roots: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which of the links (u, w) join trees of the forest; roots holds each point's root, before and after."""

    def root(x):
        while roots[x] != x:
            roots[x] = roots[roots[x]]
            x = roots[x]
        return x

    x, z, out = roots[u], roots[w], []
    apart = np.flatnonzero(x != z)
    for k in apart[np.unique(x[apart] * len(roots) + z[apart], return_index=True)[1]]:
        i, j = root(u[k]), root(w[k])
        if i != j:
            roots[i] = j
            out.append(k)
    while out and (roots[roots] != roots).any():
        roots[:] = roots[roots]
    return np.array(out, np.int64)


class Tile(NamedTuple):
    key: np.ndarray
    id: np.ndarray
    named: np.ndarray
    n: np.ndarray
    length: np.ndarray
    values: np.ndarray

    @staticmethod
    def packed(group: pa.Table) -> pa.Table:
        """One row (tile, head, v) of rows (tile, key, id, n, v), ordered by length."""
        group = group.take(pa.array(np.argsort(pc.list_value_length(group["v"]).to_numpy(), kind="stable"))).combine_chunks()
        head = np.stack([x.to_numpy().astype(np.int64) for x in (group["key"], pc.fill_null(group["id"], 0), pc.is_valid(group["id"]), group["n"], pc.list_value_length(group["v"]))])
        values = pc.list_flatten(group["v"]).to_numpy()
        return pa.table({"tile": group["tile"][:1], "head": pa.array([head.tobytes()], pa.binary()), "v": pa.array([values.tobytes()], pa.binary())})

    @staticmethod
    def opened(head: pa.Buffer, v: pa.Buffer, kind: str) -> Tile:
        key, id_, named, n, length = np.frombuffer(head, np.int64).reshape(5, -1)
        return Tile(key, id_, named.astype(bool), n, length, np.frombuffer(v, kind))

    def of(self, dim: int) -> tuple[int, np.ndarray]:
        """Where the vectors of a length begin, and these."""
        lo, hi = np.searchsorted(self.length, [dim, dim + 1])
        start = int(self.length[:lo].sum())
        return int(lo), self.values[start : start + dim * int(hi - lo)].reshape(-1, dim)


def embedding_links(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """Per input row: the id, n_links, component_id (long), kept.

    Links vectors of equal length with a cosine of at least `cosine`, in double precision. A null or zero vector, or
    one with null or non-finite components, links with nothing. Equal vectors are one point with a count, so a
    group of copies is compared once; ids are whole numbers, and rows with one id count as rows in n_links and as
    one id in components. A row without id counts as a row, joins no others and has no component: component_id null, kept true.
    Points are dealt to tiles by hash, so those near each other are spread over all; an empty table gives none.
    """
    with scratch(vectors.sparkSession) as keep:
        out = _linked(vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("v")), cosine)
        keep(out)
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _linked(rows: DataFrame, cosine: float) -> DataFrame:
    """(id, n_links, root) of rows (id, v): n_links is null for none, root for a component of its own."""
    real = "float" if dict(rows.dtypes)["v"] == "array<float>" else "double"
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.col("v").cast(f"array<{real}>"))
    rows = rows.withColumn("point", F.when(F.coalesce(fine, F.lit(False)), F.xxhash64(F.transform("v", lambda x: x + F.lit(0.0)))))
    rows = stored(rows.withColumn("point2", F.when(F.col("point").isNotNull(), F.xxhash64(F.lit(1), F.transform("v", lambda x: x + F.lit(0.0))))), "vectors")
    groups = rows.where("point is not null").groupBy(F.col("point").alias("key"), "point2")
    points = stored(groups.agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first(F.size("v")).alias("length")).drop("point2"), "points")
    n, values = points.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    tiles = max(1, -(-n // TILE), -(-values // VALUES), min(LEAST_TILES, -(-n // 512)))
    dealt = groups.agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v")).select(F.pmod("key", F.lit(tiles)).alias("tile"), "key", "id", "n", "v")
    dealt = stored(dealt.groupBy("tile").applyInArrow(Tile.packed, "tile long, head binary, v binary"), "tiles", rows=1)

    def meet(batches):
        kind = {"float": "<f4", "double": "<f8"}[real]
        names = ["key", "links", "a", "b"]
        for batch in batches:
            for tile, head, v, other, other_head, other_v in zip(*batch.columns, strict=True):
                same = tile.as_py() == other.as_py()
                a = Tile.opened(head.as_buffer(), v.as_buffer(), kind)
                b = a if same else Tile.opened(other_head.as_buffer(), other_v.as_buffer(), kind)
                shift = 0 if same else len(a.key)
                roots, la, lb, forest = np.arange(shift + len(b.key)), np.zeros(len(a.key), np.int64), np.zeros(len(b.key), np.int64), []
                for dim in np.intersect1d(a.length, b.length):
                    (at, xa), (bt, xb) = a.of(dim), b.of(dim)
                    for u, w in linked(xa, xb, cosine, same):
                        u, w = u + at, w + bt
                        np.add.at(la, u, b.n[w])
                        np.add.at(lb, w, a.n[u])
                        ok = a.named[u] & b.named[w]  # a point without id joins nothing
                        u, w = u[ok], w[ok]
                        k = joining(roots, u, w + shift)
                        forest.append(np.stack([a.id[u[k]], b.id[w[k]]]))
                key, links = np.r_[a.key[la > 0], b.key[lb > 0]], np.r_[la[la > 0], lb[lb > 0]]
                if len(key):
                    none = pa.nulls(len(key), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(links), none, none], names)
                ends = np.hstack([np.empty((2, 0), np.int64), *forest])
                if ends.size:
                    none = pa.nulls(ends.shape[1], pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, pa.array(ends[0]), pa.array(ends[1])], names)

    others = dealt.toDF("other", "other_head", "other_v").hint("shuffle_replicate_nl")  # a Cartesian product: nothing is shuffled
    met = dealt.join(others, F.col("tile") <= F.col("other"))
    with small_batches(rows.sparkSession, 1):
        found = stored(met.mapInArrow(meet, "key long, links long, a long, b long"), "vector-links")
    links = found.where("key is not null").groupBy("key").agg(F.sum("links").alias("links"))
    same = rows.join(points.select(F.col("key").alias("point"), F.col("id").alias("a")), "point").select("a", F.col("id").alias("b")).where("a < b")
    roots = components(found.where("a is not null").select("a", "b").unionByName(same))
    own = points.select("key", F.col("n") - 1).toDF("key", "copies").join(links, "key", "left").select(F.col("key").alias("point"), (F.col("copies") + F.coalesce("links", F.lit(0))).alias("n_links"))
    return rows.select("id", "point").join(own, "point", "left").join(roots, "id", "left").select("id", "n_links", "root")


def op7_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
