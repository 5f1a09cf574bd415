"""Pieces that several operators share: words, row keys, tables in the shared folder, components."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, newline, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def row_key(doc_id: str, text: str) -> list[Column]:
    """Two columns that name a row by its id and text, never null. Rows equal in both are one key."""
    return [F.coalesce(F.col(doc_id).cast("string"), F.lit("\0null")).alias("_key"), F.xxhash64(F.col(text)).alias("_hash")]


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of docs has (case aside), for columns that an operator adds on its way."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(shared_folder, "own", None)
        if not folder:
            folder = shared_folder.own = tempfile.mkdtemp(prefix="quarry-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder.rstrip("/")


#: Folders of tables written by the scopes that are open now, the innermost last.
_scopes: list[set[str]] = []


def stored(df: DataFrame, tag: str, by: str | None = None, rows: int = 0) -> DataFrame:
    """Writes a DataFrame to the shared folder and reads it again, which cuts its lineage and outlives executors.

    by: a column of few values that parts the table's files. rows: as many at most in a file, 0 for any number. The table goes when the scope it was made in ends (scratch), or with dropped(), and at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    write = df.write.partitionBy(by) if by else df.write
    (write.option("maxRecordsPerFile", rows) if rows else write).parquet(path)
    files, jvm_path = _files(spark, path)
    files.deleteOnExit(jvm_path)
    if _scopes:
        _scopes[-1].add(path.rpartition("/")[2])
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def delete(spark: SparkSession, tables: set[str]) -> None:
    """Deletes stored tables by name."""
    for name in tables:
        files, path = _files(spark, f"{shared_folder(spark)}/{name}")
        files.delete(path, True)
    for scope in _scopes:
        scope -= tables


def names(*frames: DataFrame) -> set[str]:
    """Folders of the stored tables that frames read."""
    folders = {f.rpartition("/")[0] for frame in frames for f in frame.inputFiles()}
    return {x for f in folders for x in f.rsplit("/", 2)[1:] if "=" not in x}


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes tables made by stored() that nothing reads any more."""
    delete(spark, names(*frames))


@contextmanager
def scratch(spark: SparkSession, left: set[str] | None = None):
    """A scope for stored tables: at its end all go but those read by frames handed to the yielded function.

    Those are left to the scope around it, if there is one, and noted in left, if given: a lazy result reads them until it is written.
    """
    mine, keep = set(), set()
    _scopes.append(mine)
    try:
        yield lambda *frames: keep.update(names(*frames))
    finally:
        _scopes.pop()
        if _scopes:
            _scopes[-1] |= mine & keep
        if left is not None:
            left |= mine & keep
        delete(spark, mine - keep)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """While jobs run inside, tasks hand that many rows at once to Python: long texts then need little memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the output (the public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """64-bit ids of words: a polynomial of their bytes, from running sums over all bytes of some texts.

    No word becomes an object. Bytes are hashed size at a time, cut at blanks, so memory is bounded by that and the
    longest word. lower: A-Z count as a-z.
    """

    BASE = 0x9FB21C651E98DF25  # odd, so it has an inverse

    def __init__(self, lower: bool = True, size: int = 1 << 19):
        self.size = size
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        if lower:
            self.values[ord("A") : ord("Z") + 1] = self.values[ord("a") : ord("z") + 1]
        self.blank = np.zeros(256, bool)
        self.blank[list(BLANKS.encode())] = True
        self.values[self.blank] = 0
        self._powers(size)

    def _powers(self, n: int) -> None:
        power = lambda base: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])
        self.powers, self.inverse = power(self.BASE), power(pow(self.BASE, -1, 1 << 64))

    def _part(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start in bytes that close with a blank, and their ids."""
        if len(data) > len(self.powers):
            self._powers(len(data))
        out = self.blank[data]
        edge = np.flatnonzero(out[1:] != out[:-1]) + 1
        edge = edge if out[0] else np.r_[0, edge]
        start, end = edge[::2], edge[1::2]
        sums = np.cumsum(self.values[data] * self.powers[: len(data)])
        own = (sums[end - 1] - np.where(start, sums[start - 1], np.uint64(0))) * self.inverse[start]
        return start, mixed(own + (end - start).astype(np.uint64) * np.uint64(self.BASE))

    def of(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words of texts, in order, and how many each text has."""
        raw = [s.encode() if s else b"" for s in texts]
        data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        stops = np.cumsum([len(x) + 1 for x in raw])
        starts, ids, at = [], [], 0
        while at < len(data):
            stop, more = min(len(data), at + self.size), self.size
            while stop < len(data) and not self.blank[data[stop - 1]]:  # on to the next blank
                found = np.flatnonzero(self.blank[data[stop : stop + more]])
                stop = stop + int(found[0]) + 1 if len(found) else min(len(data), stop + more)
            start, own = self._part(data[at:stop])
            starts.append(start + at), ids.append(own)
            at = stop
        if not starts:
            return np.empty(0, np.uint64), np.zeros(len(raw), np.int64)
        return np.concatenate(ids), np.diff(np.searchsorted(np.concatenate(starts), stops), prepend=0)

    def each(self, texts: Iterable[str | None], some: int = 200) -> Iterator[np.ndarray]:
        """The ids of each text's words."""
        texts = list(texts)
        for k in range(0, len(texts), some):
            ids, n = self.of(texts[k : k + some])
            yield from np.split(ids, np.cumsum(n)[:-1])


def window_ids(ids: np.ndarray, n: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64-bit ids of all windows of n consecutive word ids (empty if there are fewer)."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    out, factor = np.zeros(len(ids) - n + 1, np.uint64), 1
    for i in range(n):
        factor = factor * (seed | 1) % (1 << 64)
        out += ids[i : i + len(out)] * np.uint64(factor)
    return mixed(out)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) pairs of long ids: one row (id, root) per id that occurs, root the smallest id reachable.

    Contraction: every root that has a smaller neighbour hangs itself below the smallest one, chains are
    shortened by pointer jumping, and edges are rewritten to roots until none is left. Each round is a
    grouped minimum and two joins on ids, and is stored in the shared folder. No group is collected anywhere.
    """
    spark = edges.sparkSession
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = stored(edges, "edges")
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    labels = stored(ids.select("id", F.col("id").alias("root")), "labels")
    for _ in range(most_rounds):
        if edges.isEmpty():
            break
        parent = edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        parent = stored(parent, "parent")
        while True:  # pointer jumping: parents of parents until every chain has one link
            up = parent.select(F.col("id").alias("parent"), F.col("parent").alias("_up"))
            jumped = parent.join(up, "parent", "left").select("id", F.coalesce("_up", "parent").alias("parent"), F.col("_up").isNotNull().alias("_moved"))
            jumped = stored(jumped, "jump")
            dropped(spark, parent)
            parent = jumped
            if parent.where("_moved").isEmpty():
                break
            parent = parent.select("id", "parent")
        parent = parent.select("id", "parent")
        new = labels.join(parent.withColumnRenamed("id", "root"), "root", "left").select("id", F.coalesce("parent", "root").alias("root"))
        new = stored(new, "labels")
        of = lambda c: parent.select(F.col("id").alias(c), F.col("parent").alias(f"_{c}"))
        left = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"))
        left = left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()
        left = stored(left, "edges")
        dropped(spark, labels, edges, parent)
        labels, edges = new, left
    else:
        raise RuntimeError("components: too many rounds")
    dropped(spark, edges)
    return labels
