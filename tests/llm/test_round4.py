"""Embedding links: what is shuffled follows the table, and tiles lose no pair."""

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import vectors


def shuffled(spark, run):
    """Rows that run() writes to shuffles."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def total():
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    def settled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return total()

    before = settled()
    run()
    return settled() - before


def test_vectors_shuffle_grows_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 8)
    x = np.random.default_rng(21).standard_normal((512, 16)).tolist()
    small, large = (shuffled(spark, lambda n=n: vectors.embedding_links(spark.createDataFrame(list(enumerate(x[:n])), "vec_id long, embedding array<double>")).collect()) for n in (128, 512))
    assert small > 0 and large <= 5 * small


def near_threshold(n, dim, seed):
    """Vectors in single precision, half of them at a cosine of about 0.95 with the other half."""
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    e = r.standard_normal((n, dim))
    e -= x * ((x * e).sum(1) / (x * x).sum(1))[:, None]
    e *= np.sqrt((x * x).sum(1) / (e * e).sum(1))[:, None]
    cos = 0.95 + r.choice([-1e-3, -1e-6, -1e-7, 1e-7, 1e-6, 1e-3], (n, 1))
    return np.concatenate([x, 3 * (cos * x + np.sqrt(1 - cos**2) * e)]).astype(np.float32)


def linked(x):
    x = x.astype(np.float64)
    size = np.sqrt((x * x).sum(axis=1))
    return np.array([(x[i] * x).sum(axis=1) / (size[i] * size) >= 0.95 for i in range(len(x))]) & ~np.eye(len(x), dtype=bool)


def test_linked_pairs_come_once(monkeypatch):
    monkeypatch.setattr(vectors, "LEAF", 4)
    monkeypatch.setattr(vectors, "PIECE", 7)
    for dim in (1, 3, 16, 67):
        x = near_threshold(60, dim, dim) if dim > 1 else np.arange(-30, 31, dtype=np.float32)[:, None][np.arange(61) != 30]
        want = linked(x)
        assert want.sum() > 40
        for a, b, once in ((x, x, True), (x[:50], x[50:], False)):
            got = [(int(u), int(w)) for p, q in vectors.linked(a, b, 0.95, once) for u, w in zip(p, q, strict=True)]
            assert len(got) == len(set(got))
            pairs = np.argwhere(np.triu(want)) if once else np.argwhere(want[:50, 50:])
            assert sorted(got) == [tuple(map(int, p)) for p in pairs]


def test_vectors_of_single_precision_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", 16)
    x = near_threshold(60, 16, 5)
    want = linked(x)
    y = near_threshold(10, 5, 6)  # another length
    rows = [(i, v.tolist()) for i, v in enumerate([*x, *y])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    more = linked(y)
    want = np.concatenate([want.sum(1), more.sum(1)])
    got = vectors.embedding_links(df.union(df.where("vec_id < 3").withColumn("vec_id", F.col("vec_id") + 1000))).collect()
    links = {r.vec_id: r.n_links for r in got}
    whole = linked(np.concatenate([x, x[:3]]))
    assert [links[i] for i in range(120)] == whole.sum(1)[:120].tolist()
    assert [links[i] for i in range(120, 140)] == want[120:].tolist()
    assert {r.component_id for r in got if r.vec_id >= 1000} == {0, 1, 2}
