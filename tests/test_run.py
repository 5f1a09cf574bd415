"""Loading, names, casts, configuration, trace and the stored run memory."""

import bz2
import datetime as dt
import gzip
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry import config, stores
from quarry.operators import features, naming, summary
from quarry.plans import trace
from quarry.sources import load, run_memory


# Loading


def test_packed_files_are_sniffed(spark, tmp_path):
    for name, pack in (("a.csv.gz", gzip.compress), ("a.csv.bz2", bz2.compress)):
        (tmp_path / name).write_bytes(pack("x;y\n1;é\n2;b\n".encode()))
        df = load.load(spark, str(tmp_path / name))
        assert df.columns == ["x", "y"] and [tuple(r) for r in df.collect()] == [(1, "é"), (2, "b")]
    (tmp_path / "dir").mkdir()
    spark.range(3).write.mode("overwrite").parquet(str(tmp_path / "dir"))
    assert load.load(spark, str(tmp_path / "dir")).count() == 3


def test_zip_keeps_rows_like_the_header_and_infers_types(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("notes.txt", "none")
        z.writestr("t.csv", 'p;q;r\n1;"a;b";2020-01-02\np;q;r\n3;c;\n')
        z.writestr("u.csv", "other\n1\n")
    got = load.load(spark, str(tmp_path / "d.zip"))
    assert [tuple(r) for r in got.collect()] == [("1", "a;b", "2020-01-02"), ("p", "q", "r"), ("3", "c", "")]
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("t.csv", "﻿n,x,b,t\n" + "".join(f"{i},{i}.5,true,2020-01-0{i % 9 + 1}\n" for i in range(12000)))
    big = load.load(spark, str(tmp_path / "e.zip"))
    assert dict(big.dtypes) == {"n": "bigint", "x": "double", "b": "boolean", "t": "timestamp"} and big.count() == 12000 and big.agg(F.sum("n")).first()[0] == sum(range(12000))
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("a.txt", "x")
    with pytest.raises(Exception, match="no CSV"):
        load.load(spark, str(tmp_path / "f.zip")).collect()


def test_quarantine_counts_lines_that_do_not_fit(spark, tmp_path):
    (tmp_path / "a.csv").write_text("_line,y\n1,a\n2,b,c,d\n3\n4,d\n")
    got = load.load_tolerant(spark, str(tmp_path / "a.csv"))
    assert (got.accepted_rows, got.rejected_rows) == (2, 2) and got.df.count() == 2
    assert sorted(tuple(r) for r in got.df.collect()) == [(1, "a"), (4, "d")]
    assert sorted(r.line for r in got.rejected.collect()) == ["2,b,c,d", "3"] and got.rejected.first().file.endswith("a.csv")
    assert load.load(spark, str(tmp_path / "a.csv")).count() == 4
    with pytest.raises(ValueError, match="2 lines"):
        load.load_strict(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text("x|y\n1|a\n")
    df, info = load.load_strict(spark, str(tmp_path / "b.csv"))
    assert df.count() == info["rows"] == 1 and info["separator"] == "|" and info["column_names"] == ["x", "y"] and info["file_size"] == 8
    with pytest.raises(FileNotFoundError):
        load.load_strict(spark, str(tmp_path / "none.csv"))
    (tmp_path / "c.doc").write_text("x")
    with pytest.raises(ValueError, match="not read"):
        load.load_strict(spark, str(tmp_path / "c.doc"))


def test_estimated_rows(spark, tmp_path):
    r = random.Random(1)
    (tmp_path / "small.csv").write_text("x\n" + "1\n" * 999)
    assert load.estimated_rows(spark, str(tmp_path / "small.csv")) == 999
    (tmp_path / "empty.csv").write_text("")
    assert load.estimated_rows(spark, str(tmp_path / "empty.csv")) == 0
    with open(tmp_path / "big.csv", "w") as f:  # lines grow longer, so a head alone would mislead
        n = 0
        f.write("header\n")
        while f.tell() < 100_000_000:
            f.writelines("x" * (20 + n // 4000 + r.randrange(40)) + "\n" for _ in range(10_000))
            n += 10_000
    assert abs(load.estimated_rows(spark, str(tmp_path / "big.csv")) / n - 1) < 0.05


# Names and casts


def test_each_pattern_of_names():
    want = {
        "Dist Name": "district", "My District": "district", "mandal name": "mandal", "Sub-Dist": "mandal", "village name": "village", "Program": "village", "reg_dt_date": "registration_date", "Entry Date": "created_date",
        "Fin Year": "financial_year", "Total Count": "total_count", "Amount (Rs)": "amount_inr", "per capita income": "per_capita", "App Id": "application_id", "Ben_Id": "beneficiary_id",
    }
    assert {n: naming.suggested_name(n, aliases={})[0] for n in want} == want
    for domain, names in {"transport": {"Vehicle Reg": "vehicle_registration", "DL No": "license_number", "Category": "vehicle_category"}, "health": {"Patient No": "patient_id", "Facility": "facility_name", "Disease": "diagnosis"}, "education": {"Enrollment": "student_id", "Institution": "school_name", "Std": "class_grade"}}.items():
        assert {n: naming.suggested_name(n, domain) for n in names} == {n: (x, "pattern") for n, x in names.items()}
        assert all(naming.suggested_name(n, None)[1] == "cleaned" for n in names)
    assert naming.suggested_name("Qty") == ("total", "alias") and naming.suggested_name("district_name") == ("district", "alias")
    assert naming.suggested_name("Net  Price ($)") == ("net_price_", "cleaned") or naming.suggested_name("Net  Price ($)")[1] == "cleaned"
    assert naming.suggested_name("%%") == ("%%", "cleaned") and naming.suggested_name("vehicle district name", "transport")[0] == "district"  # the first pattern counts


def test_rename_and_cast_by_mapping(spark):
    df = spark.createDataFrame([("1", "x", "3.0", "true"), ("2", "y", "4.5", "0.0")], "`Dist Name` string, district string, Qty string, flag string")
    proposals = naming.mapping([("Dist Name", "text", 0.9), ("district", "text", 0.9), ("Qty", "integer", 0.5), ("flag", "boolean", 0.7)])
    out, log = naming.renamed(df, proposals)
    assert out.columns == ["district_1", "district", "Qty", "flag"] and [(x["original"], x["canonical"]) for x in log] == [("Dist Name", "district_1")]
    assert naming.renamed(df, proposals, least=0.4)[0].columns == ["district_1", "district", "total", "flag"]
    assert naming.proposal_for("total", proposals).original == "Qty" and naming.proposal_for("district", proposals).original == "Dist Name" and naming.proposal_for("z", proposals) is None
    cast, report = naming.converted(out.withColumnRenamed("Qty", "total"), proposals, least=0.4)
    assert [(r.total, r.flag) for r in cast.collect()] == [(3, True), (None, False)]
    assert {r["column"]: (r["status"], r["lost"]) for r in report.collect()} == {"total": ("cast", 1), "flag": ("cast", 0)}


def test_casts_by_rule(spark):
    df = spark.createDataFrame([("3.0", " YES ", "1,5", "2020-1-5"), ("9007199254740993", "1.0", "7", "5/1/2020"), ("x", "maybe", "1e3", None), (None, None, None, "no")], "i string, b string, n string, t string")
    kinds = {"i": "integer", "b": "boolean", "n": "numeric", "t": "datetime", "none": "float"}
    got = summary.safe_cast(df, kinds).collect()
    assert [r.i for r in got] == [3, 9007199254740993, None, None] and [r.b for r in got] == [True, True, None, None] and [r.n for r in got] == [None, 7.0, 1000.0, None]
    assert [r.t for r in got][:2] == [dt.datetime(2020, 1, 5)] * 2 and got[3].t is None
    assert {tuple(r) for r in summary.cast_report(df, kinds).collect()} == {("i", "integer", "cast", 1), ("b", "boolean", "cast", 1), ("n", "numeric", "cast", 1), ("t", "datetime", "cast", 1), ("none", "float", "missing", None)}
    assert dict(summary.safe_cast(df, {"i": "categorical", "b": "whatever"}).dtypes)["b"] == "string"
    rows = spark.createDataFrame([(str(i) if i % 4 else "n/a", "n/a" if i else "7", None if i % 4 == 0 else str(i), "w") for i in range(100)], "x string, week string, y string, z string")
    assert {c for c, k in summary.strings_to_numbers(rows).dtypes if k == "double"} == {"x", "week", "y"}
    assert {c for c, k in summary.strings_to_numbers(rows, 0.75).dtypes if k == "double"} == {"week"}  # more than the share, not as much


def test_columns_by_name(spark):
    df = spark.createDataFrame([("a", "same", 1, 0, "2020-01-01", "x"), ("b", "same", 2, 0, "2021-02-03", "y")], "district string, zone string, population long, families long, entry_date string, note_month string")
    assert naming.columns_for(df, "geographic") == ["district", "zone"] and naming.columns_for(df, "entity") == ["district"] and naming.columns_for(df, "denominator") == ["population"]
    assert naming.columns_for(df, "time") == ["entry_date", "note_month"] and naming.columns_for(df, "kpi_time") == ["entry_date"]
    parsed, times = features.parsed_dates(df)
    assert times == ["entry_date"] and dict(parsed.dtypes)["entry_date"].startswith("timestamp") and dict(parsed.dtypes)["note_month"] == "string"
    out = features.per_capita(df.withColumn("cases", F.lit(10)), ["population", "families"]).orderBy("district").first()
    assert (out.cases_per_population, out.cases_per_1000, out.cases_per_families) == (10.0, 10000.0, None)


# Configuration


def test_layers_of_configuration(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("""
data_quality: {drop_column_threshold: 0.8}
feature_engineering: {rolling_windows: [2, 4], transformation_controls: {auto_detect_requirements: true, numeric_scaling: {range_threshold: 5}}}
standardization: {column_aliases: [{aliases: [a, b], canonical: c}]}
validation_gates: {critical: [{name: sufficient_data, threshold: 3, description: x}], warning: [{name: high_missingness, threshold: 0.9}]}
groq: {model: m}
""")
    cfg = config.load_config(str(tmp_path / "c.yaml"), alpha=0.01)
    assert (cfg.drop_null_share, cfg.windows, cfg.scale_range, cfg.aliases, cfg.least_rows, cfg.most_missing, cfg.alpha, cfg.skew) == (0.8, (2, 4), 5, {"a": "c", "b": "c"}, 3, 0.9, 0.01, 2.0)
    assert config.load_config() == config.DEFAULTS
    from quarry.operators import quality

    few = spark.range(5)
    verdict = lambda cfg: {r.gate: r.passed for r in quality.gates(few, cfg).collect()}["sufficient_data"]
    assert verdict(cfg) and not verdict(config.DEFAULTS)
    for text in ("data_quality: {unknown: 1}", "what: 1", "validation_gates: {critical: [{name: x, threshold: 1}]}", "- 1"):
        (tmp_path / "d.yaml").write_text(text)
        with pytest.raises(ValueError, match="unknown|no keys"):
            config.load_config(str(tmp_path / "d.yaml"))
    with pytest.raises(ValueError, match="unknown"):
        config.load_config(alfa=1)
    (tmp_path / "e.yaml").write_text("domain: health\nkey_metrics: [cases]\nscope: all\n")
    assert config.load_context(str(tmp_path / "e.yaml"), scope="some") == config.Context(domain="health", key_metrics=("cases",), scope="some")
    with pytest.raises(ValueError, match="unknown"):
        config.load_context(None, field=1)


# Trace


def test_trace_counts_rows_without_jobs_of_its_own(spark, tmp_path):
    ticks = iter(range(100))
    t = trace.Trace(spark, "r1", clock=lambda: float(next(ticks)))
    with t.stage("load") as s:
        df = s.observed(spark.range(10))
        s.metrics["columns"] = 1
    with t.stage("filter") as s:
        df = s.observed(df.where("id > 3"))
    with pytest.raises(ZeroDivisionError), t.stage("bad"):
        1 / 0  # noqa: B018
    assert [s.rows for s in t.stages] == [None] * 3
    assert df.agg(F.sum("id")).first()[0] == sum(range(4, 10))
    got = [(r.position, r.stage, r.status, r.seconds, r.rows, r.metrics) for r in t.table().orderBy("position").collect()]
    assert got == [(0, "load", "completed", 1.0, 10, {"columns": 1.0}), (1, "filter", "completed", 1.0, 6, {}), (2, "bad", "failed", 1.0, None, {})]
    assert t.table().where("error is not null").first().error.startswith("ZeroDivisionError")
    t.write(str(tmp_path / "log"))
    trace.Trace(spark, "r2").write(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert tuple(trace.trace_summary(log).first()) == ("r1", 3, 1, 3.0, pytest.approx(66.6667, abs=1e-3), "completed_with_errors")
    assert {r.stage: r.rows_per_second for r in trace.stage_statistics(log).collect()} == {"load": 10.0, "filter": 6.0, "bad": None}


# Run memory


def runs(spark, *rows):
    return spark.createDataFrame([(k, "d", "health", "h", "s", dt.datetime.fromisoformat(day), q, q, 1, 1, 1) for k, day, q in rows], run_memory.TABLES["runs"][0])


def test_run_memory_survives_failed_writes(spark, tmp_path, monkeypatch):
    m = run_memory.RunMemory(spark, str(tmp_path / "memory"))
    assert m.read("runs").count() == 0
    m.upsert("runs", runs(spark, ("a", "2024-01-01", 1.0), ("b", "2024-03-01", 2.0)))
    m.upsert("runs", runs(spark, ("b", "2024-03-02", 3.0), ("c", "2024-03-03", 4.0)))
    state = lambda: sorted((r.run_id, r.quality_score) for r in m.read("runs").collect())
    assert state() == [("a", 1.0), ("b", 3.0), ("c", 4.0)]
    with pytest.raises(Exception, match="broken"):  # the write dies midway
        m.replace("runs", lambda old: old.withColumn("run_id", F.raise_error(F.lit("broken"))))
    assert state() == [("a", 1.0), ("b", 3.0), ("c", 4.0)]
    own = m.replace
    with pytest.raises(run_memory.Conflict):  # another writer is faster
        own("runs", lambda old: (own("runs", lambda o: o.where("run_id != 'c'")), old)[1])
    assert state() == [("a", 1.0), ("b", 3.0)]
    m.trim("2024-03-05", days=30)
    assert state() == [("b", 3.0)]
    assert len(stores.names_in(spark, str(tmp_path / "memory/runs/versions"))) == 2
    m.views()
    assert spark.sql("select count(*) from runs").first()[0] == 1


def test_run_memory_counts_up(spark, tmp_path):
    m, schema = run_memory.RunMemory(spark, str(tmp_path / "memory")), run_memory.TABLES["transform_rules"][0]
    at = lambda d: dt.datetime(2024, 1, d)
    rule = lambda k, n, d, action="x": (k, "t", "c", action, "{}", 0.5, n, at(d), at(d))
    m.count_up("transform_rules", spark.createDataFrame([rule("r", 1, 1), rule("s", 2, 1)], schema))
    m.count_up("transform_rules", spark.createDataFrame([rule("r", 1, 5, "old"), rule("r", 1, 7, "new"), rule("q", 1, 7)], schema))
    got = {r.rule_id: (r.usage_count, r.created_at.day, r.last_used.day, r.action) for r in m.read("transform_rules").collect()}
    assert got == {"r": (3, 1, 7, "new"), "s": (2, 1, 1, "x"), "q": (1, 7, 7, "x")}


# The table pipeline


def messy(spark, n=400):
    r = random.Random(2)
    rows = [
        (f" Dist {'ABC'[i % 3]} ", "yes" if i % 2 else "No", f"Rs. {100 + i % 50},000" if i % 30 else None, f"{i % 90}%", f"2021-{i % 12 + 1:02d}-{i % 28 + 1:02d}", str(i % 7) if i % 3 else "n/a", 1000 + i % 400, float(r.expovariate(1.0)) if i % 10 else None, float("nan") if i % 3 == 0 else 1.0, None, f"k{i % 15}" if i % 25 else None)
        for i in range(n)
    ]
    return spark.createDataFrame(rows + rows[:5], "`Dist Name` string, active string, fee_rs string, pct_done string, entry_date string, week string, population long, cases double, gaps double, nothing string, `Ward Code` string")


def test_pipeline_uses_the_whole_library(spark):
    t = trace.Trace(spark, "run")
    out = __import__("quarry.plans.pipeline", fromlist=["run"]).run(messy(spark), context=config.Context(domain="health"), trace=t)
    std, cln, new = out["standardize"], out["clean"], out["transform"]
    assert "district" in std.df.columns and std.df.first()["district"] in ("Dist A", "Dist B", "Dist C")
    kinds = dict(std.df.dtypes)
    assert kinds["fee_rs"] == "double" and kinds["pct_done"] == "double" and kinds["created_date"].startswith("timestamp")  # renamed by a pattern
    assert {r["active"] for r in std.df.select("active").distinct().collect()} <= {"True", "False", True, False}
    assert {r["action"] for r in std.report} >= {"rename", "unit", "truth words", "cast"}
    assert "nothing" not in cln.df.columns and cln.df.where("fee_rs is null or cases is null").count() == 0 and cln.df.count() < 405
    assert {r["action"] for r in cln.report} >= {"dropped", "flagged"} and any(r["action"] in ("median", "group median") for r in cln.report)
    columns = new.df.columns
    for c in ("created_date_year", "cases_per_population", "cases_per_1000", "population_rolling_3", "population_lag1", "population_by_district_mean", "population_by_district_rank", "district_Dist A"):
        assert c in columns, c
    assert new.df.count() == cln.df.count() and new.tables["transformation_check"].first()["new_columns"] > 40
    assert out["validate"].report[-1] == {"route": "continue"} and out["validate"].tables["scores"].first()["level"] in ("HIGH", "MEDIUM", "LOW")
    for name, table in out["analyze"].tables.items():
        assert table.collect() is not None, name
    assert set(out["analyze"].tables) >= {"numeric_kpis", "categorical_kpis", "correlations", "normality", "group_comparison", "seasonality", "inequality", "evidence"}
    steps = {r.stage: (r.status, r.rows) for r in t.table().collect()}
    assert steps["ingest"] == ("completed", 405) and steps["clean"] == ("completed", cln.df.count()) and list(steps) == ["ingest", "standardize", "clean", "transform", "validate", "analyze"]
    assert [r.run_id for r in __import__("quarry.plans.pipeline", fromlist=["run"]).run_record(out, "run", "messy", "health", "2024-01-01").collect()] == ["run"]


def test_pipeline_of_odd_tables(spark):
    from quarry.plans import pipeline

    for df in (spark.createDataFrame([], "a long, b string"), spark.createDataFrame([(1, "x")], "a long, b string"), spark.createDataFrame([(None, None)], "a double, b string"), spark.range(3).select(F.array("id").alias("x"))):
        out = pipeline.run(df)
        assert out["validate"].report[-1]["route"] == "fail"
        assert all(t.collect() is not None for t in out["analyze"].tables.values())
    with pytest.raises(Exception, match="broken"):
        pipeline.run(spark.range(3).withColumn("x", F.when(F.col("id") > 5, 1).otherwise(F.raise_error(F.lit("broken")).cast("int"))), retries=1)


def test_documents_of_a_run(spark, tmp_path):
    from quarry.plans import documents, pipeline
    from quarry.sources import sinks

    out = pipeline.run(messy(spark, 150), trace=trace.Trace(spark, "r"))
    documents.write_run(spark, out, str(tmp_path / "run"))
    found = {n: sinks.read_document(spark, str(tmp_path / f"run/documents/{n}")) for n in documents.DOCUMENTS}
    assert len(found) == 9 and found["validation_report"]["gates"][0]["gate"] and found["run_summary"]["summary"][0]["run_id"] == "r"
    assert found["insights"]["findings"][0]["id"] == 1 and found["schema_mapping"]["report"][0]["column"] == "Dist Name"
    assert spark.read.csv(str(tmp_path / "run/preview"), header=True).count() > 0 and spark.read.json(str(tmp_path / "run/quality_log")).count() == 4
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "run/report")).collect())
    assert "## Gates" in text and "| sufficient_data |" in text and "## Findings" in text
    assert spark.read.parquet(str(tmp_path / "run/cleaned")).count() == out["clean"].df.count()


def test_small_rules(spark):
    from quarry.operators import memory, quality, reports, stats

    gates = quality.named_gates(spark.range(5), ["sufficient_data", "what"])
    assert [(g["gate"], g["passed"]) for g in gates] == [("sufficient_data", False), ("what", True)] and gates[1]["details"] == "gate not implemented"
    broken = spark.range(5).withColumn("x", F.raise_error(F.lit("broken")).cast("int"))
    assert not quality.named_gates(broken, ["sufficient_data"])[0]["passed"]
    known = spark.createDataFrame([("Reg_Date", "date", 0.9), ("reg_date", "day", 0.5), ("reg_date", "day", 0.6), ("user_id", "id", 0.5)], "o string, c string, q double")
    got = {r["name"]: (r["choice"], r["rule"]) for r in memory.suggest(known, ["REG_DATE", "paid_date", "z"], "o", "c", "q").collect()}
    assert got == {"REG_DATE": ("day", "exact"), "paid_date": ("date", "pattern")}
    none = spark.createDataFrame([], "kind string, subject string, value double, label string")
    assert reports.fallback_findings(none).count() == 0 and reports.fallback_recommendations(reports.fallback_findings(none)).count() == 0
    some = reports.fallback_findings(spark.createDataFrame([("inequality", "x", 0.5, "high"), ("kpi", "y", 2.0, None)], none.schema))
    assert [r.confidence for r in some.orderBy("id").collect()] == ["MEDIUM", "HIGH"] and reports.fallback_recommendations(some).first().finding.startswith("Key metric y")
    assert stats.mode_of(none, "subject").first()["mode"] is None
    flags = {(r.flag, r.subject) for r in reports.profile_flags(spark.createDataFrame([(None, 1), (None, 1), (None, 1)], "a string, b int")).collect()}
    assert flags == {("much_missing", None), ("many_duplicates", None), ("constant", "a"), ("constant", "b")}
    assert {(r.item, r.value) for r in reports.data_summary(none).collect()} == {(i, None) for i in ("mean", "std", "min", "max")} | {("outliers", 0.0)}


def test_types_do_not_hang_on_the_size_of_a_table(spark):
    from quarry.operators import detect, stats

    prose = spark.range(520).select(F.when(F.col("id") % 26 == 0, F.concat(F.lit("the state of the city and its ward "), "id")).otherwise(F.concat(F.lit("some words "), "id")).alias("s"), F.lit(5.0).alias("same"), F.col("id").cast("double").alias("x"))
    kinds = [detect.type_scores(df, ["s"]).first() for df in (prose, prose.where("id < 52"))]
    assert [r.geographic for r in kinds] == [0.0, 0.0] and [r.type for r in kinds] == ["text", "text"]
    assert {(r.a, r.b): r.r for r in stats.pearson_pairs(prose, ["same", "x"]).collect()} == {("same", "x"): None}


def test_json_log_rotates(tmp_path):
    import json

    from quarry.sources import sinks

    log = sinks.json_log("quarry.test", str(tmp_path / "run.log"), most_bytes=400, kept=2)
    assert sinks.json_log("quarry.test", str(tmp_path / "run.log")) is log and len(log.handlers) == 1
    for i in range(12):
        log.info("line %d", i, extra={"stage": "clean"})
    lines = [json.loads(x) for x in (tmp_path / "run.log").read_text().splitlines()]
    assert lines[-1]["message"] == "line 11" and lines[-1]["stage"] == "clean" and (tmp_path / "run.log.2").exists() and not (tmp_path / "run.log.3").exists()
