"""Helpers, sources and the table pipeline."""

import json
import math
import zipfile

from quarry.functions import pvalues as p
from quarry.operators import detect, features, memory, quality
from quarry.plans import pipeline
from quarry.sources import load, sinks


def test_p_values():
    assert abs(p.t_two_sided(2.228139, 10) - 0.05) < 1e-6
    assert abs(p.f_tail(4.964603, 1, 10) - 0.05) < 1e-6
    assert abs(p.chi2_tail(5.991465, 2) - 0.05) < 1e-6 and abs(p.chi2_tail(18.307038, 10) - 0.05) < 1e-6
    assert abs(p.normal_two_sided(1.959964) - 0.05) < 1e-6
    assert p.kolmogorov_tail(0.5, 100) < 1e-10 < p.kolmogorov_tail(0.05, 100)


def test_names(spark):
    assert detect.canonical_name("Total Price ($)") == "total_price" and detect.canonical_name("2020") == "col_2020" and detect.canonical_name("zipCode") == "zip_code"
    df = spark.createDataFrame([(1, 2)], ["A b", "a_b"])
    assert detect.rename_canonical(df).columns == ["a_b", "a_b_1"]


def test_scores():
    assert quality.route([{"passed": True, "severity": "critical"}]) == "continue"
    assert quality.route([{"passed": False, "severity": "critical"}], 2) == "fail" and quality.route([{"passed": False, "severity": "warning"}]) == "continue"
    assert quality.confidence(100, 100, 100, 100, 100, False) == (100, "HIGH") and quality.confidence(100, 100, 100, 100, 100, True)[1] == "LOW"
    assert quality.cleaning_score(0.5, 0.1) == 83


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;é\n2;b\n", encoding="utf-8")
    assert load.load(spark, str(tmp_path / "a.csv")).columns == ["x", "y"]
    (tmp_path / "b.csv").write_bytes("x,y\n1,é\n".encode("latin-1"))
    assert load.load(spark, str(tmp_path / "b.csv")).first()["y"] == "é"
    (tmp_path / "c.json").write_text(json.dumps({"rows": [{"a": 1, "b": {"c": 2}}, {"a": 3, "b": {"c": 4}}]}))
    j = load.load(spark, str(tmp_path / "c.json"))
    assert j.columns == ["a", "b.c"] and j.count() == 2
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("t.csv", "p,q\n1,2\n3,4\n")
    assert [tuple(r) for r in load.load(spark, str(tmp_path / "d.zip")).collect()] == [(1, 2), (3, 4)]
    sinks.write_table(j.toDF("a", "c"), str(tmp_path / "out"), "csv", single=True)
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2
    sinks.append_log(spark, [{"a": 1}], str(tmp_path / "log"))
    sinks.append_log(spark, [{"a": 2}], str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert load.sniff_separator("a|b\n1|2\n") == "|" and load.sniff_encoding(b"\xff\xfea\0") == "UTF-16"


def test_features(spark):
    df = spark.createDataFrame([(1, 1.0, "b"), (2, 0.0, "a"), (3, None, None), (4, 2.0, "b")], "t int, x double, c string")
    got = {r.t: r.x_pct_change for r in features.trends(df, ["x"], "t", "t").collect()}
    assert got[1] is None and got[2] == -100 and got[3] is None and got[4] == math.inf
    assert {r.t: r.c_encoded for r in features.binary_encode(df, "c", "t").collect()} == {1: 0, 2: 1, 3: None, 4: 0}
    assert {r.t: (r.c_a, r.c_b, r.c_nan) for r in features.one_hot(df, "c").collect()}[3] == (0, 0, 1)


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, memory.upsert(old, new, "k").collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_pipeline(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    out = pipeline.run(df)
    assert out["validate"].report[-1]["route"] == "continue"
    assert "o_orderdate_year" in out["transform"].df.columns and out["transform"].df.count() > 0
    assert out["analyze"].df.count() >= 1


def test_p_values_of_tables():
    from quarry.functions import pvalues as p

    for got in (p.t_two_sided(2.2281, 10), p.f_tail(4.1028, 2, 10), p.chi2_tail(5.9915, 2), p.normal_two_sided(1.95996), p.kolmogorov_tail(1.3581 / (100 + 0.12 + 0.0011), 10**4)):
        assert abs(got - 0.05) < 2e-4


def test_significance_has_verdicts_and_survives_constants(spark):
    from quarry.operators import profile, significance, stats

    x = spark.createDataFrame([(float(v), 3.0 if i % 2 else 9.0, "ab"[i % 2], 0.0) for i, v in enumerate([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])], "x double, y double, g string, zero double")
    d = significance.dagostino(x, "x", least=8).first()
    assert abs(d.k2 - 13.034263121192582) < 1e-9 and abs(d.p_value - 0.00147) < 1e-5
    assert significance.dagostino(x, "x").first().k2 is None and significance.dagostino(x, "zero", least=8).first().k2 is None
    r = significance.correlations(x.withColumn("z", x.x * 2), ["x", "z", "y"]).collect()
    assert [(c.strength, c.significant) for c in r if {c.a, c.b} == {"x", "z"}] == [("strong", True)]
    assert all(c.p_value > 0.05 and not c.significant for c in r if "y" in (c.a, c.b))
    for f in (significance.t_test, significance.anova, significance.kruskal, significance.mann_whitney):
        assert 0 <= f(x, "x", "g").first().p_value <= 1
        assert f(x, "zero", "g").first().p_value in (None, 1.0)
    assert significance.linear_trend(x, "x", "y").first().p_value > 0.05
    assert stats.kruskal(x, "zero", "g").first().h is None
    assert [tuple(b) for b in profile.histogram(x, "zero").collect()] == [(1, 11, None)]
    stats.ks_exponential(x, "zero").collect()


def test_summaries_of_empty_and_odd_tables(spark):
    from quarry.operators import summary

    none = spark.createDataFrame([], "k long, t string, v double, d date")
    assert summary.dataset_profile(none).first().missing_share is None
    assert summary.analysis_quality(none).first().completeness_score == 0.0
    assert summary.describe(none, ["v"]).first()["count"] == 0 and summary.top_values(none, ["t"]).count() == 0
    odd = spark.createDataFrame([(1, "7", None, None), (2, "x", 1.0, None), (3, "8.5", 2.0, None), (4, "9", 2.0, None), (5, None, 2.0, None)], none.schema)
    assert [r.t for r in summary.strings_to_numbers(odd, 0.5).orderBy("k").collect()] == [7.0, None, 8.5, 9.0, None]
    assert summary.strings_to_numbers(odd).schema == odd.schema
    got = summary.safe_cast(odd, {"t": "integer", "absent": "float"}).orderBy("k").collect()
    assert [r.t for r in got][:2] == [7, None]
    assert summary.text_preview(odd, ["k"]).first().v == "NULL"


def test_detectors(spark):
    """Each detector on a column that is its own case."""
    columns = {
        "whole": ["700", "812", "812", "900"], "part": ["1000.5", "2000.25", "900.75", "900.75"], "day": ["3-Mar-2020", "14-Jan-2021", "1-Dec-1999", None],
        "month": ["3/2020", "12/2021", "1/1999", "1/1999"], "flag": ["T", "f", " t ", "nan"], "place": ["Ward 3", "Block 4", "a village", "city"],
        "code": ["AB1", "C22", "D3", "E4"], "money": ["₹ 5 crore", "Rs. 3", "2 lakh", "INR 4"], "at": ["12.5", "77.1", "-3.25", "88.5"], "none": [None] * 4, "words": ["one thing", "two things", "a third", "x"],
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"`{c}` string" for c in columns))
    got = {r["column"]: r for r in detect.type_scores(df, list(columns)).collect()}
    kinds = {c: r["type"] for c, r in got.items()}
    assert kinds == {"whole": "numeric", "part": "numeric", "day": "datetime", "month": "datetime", "flag": "boolean", "place": "geographic", "code": "id", "money": "text", "at": "numeric", "none": "unknown", "words": "text"}
    assert got["whole"]["integer"] == 1 and got["part"]["float"] == 1 and got["at"]["geographic"] == 0.9 and got["place"]["geographic"] == 0.8 and got["money"]["currency"] == 0.25
    assert got["none"]["confidence"] == 0 and got["words"]["confidence"] == 0.3


def test_numbers_by_bucket(spark):
    """Row numbers and running sums over many buckets, with ties, nulls, text and times."""
    from pyspark.sql import functions as F

    from quarry.operators import ranked, stats

    df = spark.range(2000).select(F.col("id"), (F.col("id") * 7919 % 13).alias("k"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("w"), (F.col("id") * 31 % 400).cast("string"))).alias("s"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("d"))
    for c in ("k", "s", "d"):
        rows = [(r[c], r["id"]) for r in detect.numbered(df, c, "id").orderBy("_row_id").collect()]
        assert rows == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]) if c != "s" else (r[0] is not None, r[0] or "", r[1]))
    assert sorted(r["_row_id"] for r in detect.numbered(df, "k").collect()) == list(range(2000))
    rank = {r["value"]: r["rank"] for r in stats.average_ranks(df, "k").collect()}
    ordered = sorted(i * 7919 % 13 for i in range(2000))
    assert rank == {k: ordered.index(k) + (ordered.count(k) + 1) / 2 for k in range(13)}
    assert ranked.before(df.where("id < 0"), ["k"], F.lit(1), "n").collect() == []


def test_reports(spark):
    from quarry.operators import reports

    gates = spark.createDataFrame([("rows", False, "critical", 3.0), ("missing", False, "warning", 0.6), ("copies", True, "warning", 0.0)], "gate string, passed boolean, severity string, value double")
    scores = spark.createDataFrame([(75.0, 90.0, 55.0, 45.0)], "data_completeness double, data_consistency double, schema_quality double, overall_score double")
    advice = reports.remediation(gates, scores)
    got = [(r["type"], r["priority"], r["subject"]) for r in advice.collect()]
    assert got[0] == ("overall_quality", "critical", "overall_score") and [p for _, p, _ in got] == ["critical", "high", "high", "medium", "medium"]
    assert set(got) >= {("validation_failure", "high", "rows"), ("validation_failure", "medium", "missing"), ("data_quality", "high", "data_completeness"), ("schema_inference", "medium", "schema_quality")}
    assert tuple(reports.total_effort(advice).first()) == (17, "high") and reports.total_effort(advice.limit(0)).first()["effort"] == "low"
    assert reports.remediation(gates.where("passed"), scores.selectExpr("100d data_completeness", "100d data_consistency", "100d schema_quality", "95d overall_score")).collect() == []
    tests = spark.createDataFrame([(True,), (False,), (None,), (True,)], "significant boolean")
    assert tuple(reports.test_summary(tests).first()) == (4, 2, 0.5) and reports.test_summary(tests.limit(0)).first()["significant_share"] is None
    assert [reports.overall_confidence(*x) for x in ((0, 90), (0, 75), (0, 10), (1, 90), (4, 90))] == ["HIGH", "MEDIUM", "LOW", "MEDIUM", "LOW"]
    empty = spark.createDataFrame([], "id long, x double, c_encoded string, x_norm double")
    assert reports.fill_derived(empty).collect() == [] and reports.statistical_summary(empty).first()["completeness"] is None
    assert reports.findings_confidence(empty.selectExpr("c_encoded confidence")).first()["score"] == 75
    assert {r["column"]: r["transformation"] for r in reports.before_and_after(empty, empty.drop("x"), "id").collect()} == {"id": "preserved", "x": "dropped", "c_encoded": "preserved", "x_norm": "preserved"}
    assert detect.domain_hint("Total_amount", "numeric") == "metric" and detect.domain_hint("district", "text") == "geographic" and detect.domain_hint("district_code", "text") == "identifier" and detect.domain_hint("x", "text") is None
    assert detect.canonical_name("Qty", detect.ALIASES) == "total"


def test_memory(spark):
    known = spark.createDataFrame([("reg_date", "date", 0.9), ("created_date", "date", 0.7), ("date_x", "when", 0.6), ("user_id", "id", 0.5)], "original string, choice string, confidence double")
    got = {r["name"]: (r["choice"], round(r["confidence"], 6), r["pattern"]) for r in memory.suggest_by_pattern(known, ["Entry Date", "paid_date", "Name", "z"], "original", "choice", "confidence").collect()}
    assert got == {"Entry Date": ("date", 0.64, "date"), "paid_date": ("date", 0.64, "date")}
    assert memory.suggest_by_pattern(known, ["z"], "original", "choice", "confidence").collect() == []
    memory.register_views({"mappings_view": known})
    assert spark.sql("select count(*) from mappings_view").first()[0] == 4
