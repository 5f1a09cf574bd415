"""Ranks, percentiles and windows over whole tables, and tests of distributions, against plain Python."""

import hashlib
import math
import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import pvalues
from quarry.operators import features, normality, quantiles, ranked, series, significance

R = random.Random(3)
ROWS = [(i, R.choice("abc") if i % 11 else None, None if i % 7 == 0 else round(R.expovariate(0.01), 2), float(R.randint(0, 3)), 5.0, None, f"name#{i:06d}") for i in range(3000)]
SCHEMA = "id long, g string, x double, few double, same double, none double, name string"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


def cut(values, p):
    return float(np.quantile([v for v in values if v is not None], p))


@pytest.mark.parametrize(("accuracy", "few"), [(10_000, 20_000), (100, 5), (20, 2), (10, 1)])
def test_percentiles_by_narrowing(table, accuracy, few):
    places = [0.0, 0.001, 0.25, 0.5, 0.77, 0.999, 1.0]
    columns = ["x", "few", "same", "none"]
    got = quantiles.percentiles(table, columns, places, accuracy, few)
    for i, c in enumerate(["x", "few", "same"]):
        want = [cut([r[2 + i] for r in ROWS], p) for p in places]
        assert got[c] == pytest.approx(want, abs=1e-9), c
    assert got["none"] == [None] * len(places)


def test_percentiles_of_few_values_and_nan(spark):
    two = spark.createDataFrame([(1.0, float("nan")), (2.0, 3.0), (None, float("inf"))], "x double, y double")
    assert quantiles.percentiles(two, ["x"], [0.5, 1.0])["x"] == [1.5, 2.0]
    y = quantiles.percentiles(two, ["y"], [0.0, 1.0])["y"]
    assert y[0] == 3.0 and math.isnan(y[1])
    many = spark.range(100).select(F.when(F.col("id") < 60, F.lit(float("nan"))).otherwise(F.col("id").cast("double")).alias("x"))
    got = quantiles.percentiles(many, ["x"], [0.1, 0.9], accuracy=10, few=3)["x"]
    assert got[0] == pytest.approx(69.9) and math.isnan(got[1])
    assert quantiles.percentile_table(two.limit(0), ["x"], {"q": 0.5}).first()["q"] is None


def test_group_medians_of_hot_groups(table):
    got = {r["g"]: r["m"] for r in quantiles.group_medians(table, ["g"], "x", "m").collect()}
    assert got == {g: pytest.approx(statistics.median(r[2] for r in ROWS if r[1] == g and r[2] is not None)) for g in "abc"}
    plan = quantiles.group_medians(table, ["g"], "x", "m")._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect" not in plan


def test_buckets_are_even_for_text_with_a_common_prefix_and_for_ties(table):
    for keys in ([ranked.comparable(table, "name")], [ranked.comparable(table, "same"), ranked.comparable(table, "id")]):
        sizes = [r["count"] for r in table.groupBy(ranked.bucket(table, keys, 10).alias("b")).count().collect()]
        assert len(sizes) == 10 and max(sizes) < 1.6 * 300
    got = {r["id"]: r["n"] for r in ranked.before(table, ["same"], F.lit(1), "n", ties=["id"]).collect()}
    assert got == {i: i for i in range(3000)}
    codes = {r["name"]: r["name_encoded"] for r in features.label_encode(table, "name").collect()}
    assert codes == {f"name#{i:06d}": i for i in range(3000)}


def test_reaching_back():
    assert series.reaching_back({0: 5, 1: 5}, 3) == [(0, 1, 3)]
    assert series.reaching_back({0: 1, 2: 1, 3: 4, 5: 1}, 3) == [(0, 2, 1), (2, 3, 1), (0, 3, 1), (3, 5, 3)]
    assert series.reaching_back({}, 3) == [] and series.reaching_back({4: 9}, 3) == []


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("buckets", [1, 7, 2000])
def test_trends_of_whole_table(spark, table, buckets, monkeypatch):
    """As in one window, also where buckets are smaller than frames, values are null for longer than a bucket, and times are null or tie."""
    part = table.where("id < 300").select("id", F.when(F.col("id") % 9 > 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 3).cast("int"))).alias("t"), F.when(~F.col("id").between(40, 120), F.col("few")).alias("few"), F.lit("one").alias("p"))
    monkeypatch.setattr(ranked, "edges", lambda df, keys, _, own=ranked.edges: own(df, keys, buckets))
    got = features.trends(part, ["few"], "t", "id")
    want = features.trends(part, ["few"], "t", "id", ["p"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_trends_of_whole_table_need_no_single_task(table):
    plan = features.trends(table, ["x"], "id", "id")._jdf.queryExecution().executedPlan().toString()
    for line in [x for x in plan.splitlines() if "SinglePartition" in x]:
        below = plan[plan.index(line) :].splitlines()[1:4]
        assert any("Aggregate" in x or "Project" in x for x in below)  # one row a bucket: the values carried along


# Published values: (W, p) of the test of Shapiro and Wilk.
def test_shapiro_wilk():
    weights = pvalues.shapiro_weights(10)
    assert weights[::-1][:5] == pytest.approx([0.5739, 0.3291, 0.2141, 0.1224, 0.0399], abs=1e-3)  # table of Shapiro and Wilk, 1965
    assert weights @ weights == pytest.approx(1, abs=1e-6)
    w, p = pvalues.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert (w, p) == pytest.approx((0.78881, 0.006704), abs=1e-5)
    assert pvalues.shapiro_wilk([1.0, 2.0]) is None and pvalues.shapiro_wilk([3.0] * 9) is None and pvalues.shapiro_wilk([1, 2, math.inf]) is None
    assert pvalues.shapiro_wilk([1.0, 2.0, 3.0])[0] == pytest.approx(1) and pvalues.shapiro_wilk([0.0, 0.0, 1.0])[0] == pytest.approx(0.75)
    r = np.random.default_rng(1)
    rejected = [sum(pvalues.shapiro_wilk(r.normal(size=n))[1] < 0.05 for _ in range(400)) / 400 for n in (8, 30, 500)]
    assert all(0.02 < x < 0.09 for x in rejected)  # its level
    assert all(pvalues.shapiro_wilk(r.exponential(size=200))[1] < 1e-6 for _ in range(5))


def test_normal_distribution_function():
    z = np.r_[np.linspace(-39, 39, 4001), -4, 4, 0, np.nan]
    want = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in z])
    got = pvalues.normal_cdf(z)
    assert np.allclose(got[:-1], want[:-1], rtol=1e-7, atol=1e-15) and math.isnan(got[-1])
    assert pvalues.kolmogorov_tail(1.3581 / 1000, 10**6) == pytest.approx(0.05, abs=1e-4) and pvalues.kolmogorov_tail(0.001, 100) == 1


@pytest.fixture(scope="module")
def samples(spark):
    r = np.random.default_rng(5)
    rows = [(i, "ab"[i % 2], "abc"[i % 3], float(r.normal(i % 2, 1)), float(r.exponential()), 1.0, -1.0 if i == 3 else float(r.exponential())) for i in range(600)]
    rows += [(1000 + i, "tiny", None, 1.0, 1.0, 1.0, 1.0) for i in range(2)]
    return spark.createDataFrame(rows, "id long, two string, three string, bell double, tail double, same double, signed double").repartition(3).cache()


def test_shapiro_by_group(samples):
    got = {r["group"]: r for r in normality.shapiro(samples, "bell", ["id"], "two").collect()}
    rows = samples.collect()
    for g in "ab":
        w, p = pvalues.shapiro_wilk([r.bell for r in rows if r.two == g])
        assert (got[g].n, got[g].w, got[g].p_value) == (300, pytest.approx(w), pytest.approx(p)) and got[g].normal == (p > 0.05)
    assert got["tiny"].n == 2 and got["tiny"].w is None and got["tiny"].normal is None
    sampled = normality.shapiro(samples, "bell", ["id"], "two", most=50).where("group = 'a'").first()
    assert sampled.n == 300 and sampled.w not in (None, got["a"].w)


def test_hash_sample_is_a_fixed_draw(samples):
    one = normality.hash_sample(samples, ["two"], ["id"], 40)
    ids = sorted(r.id for r in one.collect())
    assert ids == sorted(r.id for r in normality.hash_sample(samples.repartition(7), ["two"], ["id"], 40, salts=5).collect())
    assert {r["two"]: r["count"] for r in one.groupBy("two").count().collect()} == {"a": 40, "b": 40, "tiny": 2}


@pytest.mark.parametrize(("value", "group", "test", "normal"), [("bell", "two", "Independent t-test", True), ("tail", "two", "Mann-Whitney U test", False), ("bell", "three", None, None), ("tail", "three", "Kruskal-Wallis test", False)])
def test_compare_groups(samples, value, group, test, normal):
    (r,) = normality.compare_groups(samples, value, group, ["id"]).collect()
    assert r.groups == len(group) - 1 + (group == "three") * -1 or r.groups in (2, 3)
    if test:
        assert (r.test, r.normal) == (test, normal)
    assert 0 <= r.p_value <= 1 and (r.effect_size is not None) == (group == "two")
    if value == "bell" and group == "two":
        assert r.significant and r.p_value == significance.t_test(samples.where("two != 'tiny'"), "bell", "two").first().p_value
    assert normality.compare_groups(samples.where("two = 'a'"), value, "two", ["id"]).count() == 0


def test_normality_and_distribution_tests(samples):
    got = {r["column"]: r for r in normality.normality_tests(samples, ["bell", "tail", "same"], ["id"]).collect()}
    assert {c: r.test for c, r in got.items()} == dict.fromkeys(["bell", "tail", "same"], "Shapiro-Wilk") and not got["tail"].normal and got["same"].normal is None
    large = {r["column"]: r for r in normality.normality_tests(samples, ["bell", "tail"], ["id"], most=100).collect()}
    assert {r.test for r in large.values()} == {"Kolmogorov-Smirnov"} and large["bell"].normal and not large["tail"].normal
    values = sorted(r.bell for r in samples.collect())
    cdf = pvalues.normal_cdf((np.array(values) - np.mean(values)) / np.std(values, ddof=1))
    i = np.arange(len(values))
    assert large["bell"].statistic == pytest.approx(max(np.maximum((i + 1) / len(i) - cdf, cdf - i / len(i))))
    tail = normality.distribution_tests(samples, "tail", ["id"]).first()
    assert tail.is_exponential and not tail.is_normal
    assert normality.distribution_tests(samples, "signed", ["id"]).first().p_exponential is None
    assert normality.distribution_tests(samples, "tail", ["id"], most=100).first().p_normal < 0.05
    assert normality.normality_tests(samples.limit(2), ["bell"], ["id"]).count() == 0


def shuffled(df):
    """Rows written by each exchange of the whole-stage plan that ran."""
    assert df.collect()
    found, rest = [], [df._jdf.queryExecution().executedPlan()]
    while rest:
        p = rest.pop()
        name = p.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            found.append(p.metrics().apply("shuffleRecordsWritten").value())
        rest += [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_hash_sample_of_a_large_group_sorts_few_rows(spark):
    """The least MD5s as in plain Python, also where rows share a key or groups are null, and only about twice the sample is shuffled."""
    rows = spark.range(0, 20000, 1, 4).select("id", F.when(F.col("id") >= 50, F.lit("g")).alias("g"), F.lit("one").alias("one"))
    first = sorted(range(50, 20000), key=lambda i: hashlib.md5(rf"42\0{i}".encode()).hexdigest())[:100]
    sample = normality.hash_sample(rows, ["g"], ["id"], 100)
    assert sorted(r.id for r in sample.collect()) == sorted([*range(50), *first])
    assert max(shuffled(sample)) < 1000
    assert sorted(r.id for r in normality.hash_sample(rows, ["g"], ["one"], 100).collect()) == [*range(150)]
    assert sorted(r.id for r in normality.hash_sample(rows.where("id < 300"), [], ["one"], 100).collect()) == [*range(100)]


def test_compare_groups_shuffles_no_rows_by_group(spark, table):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for a table that is not small
    try:
        assert max(shuffled(normality.compare_groups(table, "few", "g", ["id"]))) < 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_in_large_groups(spark):
    rows = [(i, "hot" if i < 2000 else None if i < 2010 else f"{(i - 2010) % 7 % 4}-{(i - 2010) // 7}") for i in range(3000)]
    sizes = Counter(g for _, g in rows)
    got = normality.in_large_groups(spark.createDataFrame(rows, "id long, g string").repartition(3), "g", 2).collect()
    assert sorted(map(tuple, got)) == [r for r in rows if r[1] and sizes[r[1]] >= 2] and 1 in sizes.values()
