"""Registered queries of report tables, previews and the run memory, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect, memory, reports, significance, stats
from ..operators.profile import numeric_kpis
from .catalogue import LABELS, ORACLE_SQL, ORDERS_GAPS, gaps, query, rounded, rsql, union

_COUNTED = f"""SELECT '{{c}}' AS "column", 'categorical' AS kind, count({{c}}) AS count, 0::DOUBLE AS missing_percent, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max, count(DISTINCT {{c}}) AS distinct_values, (SELECT {{c}} FROM orders GROUP BY {{c}} ORDER BY count(*) DESC, {{c}} LIMIT 1) AS mode FROM {ORDERS_GAPS}"""
_NUMBER = f"""SELECT 'o_totalprice' AS "column", 'numeric' AS kind, count(o_totalprice) AS count, 100.0::DOUBLE * (count(*) - count(o_totalprice)) / count(*) AS missing_percent, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std, min(o_totalprice)::DOUBLE AS min, max(o_totalprice)::DOUBLE AS max, NULL::BIGINT AS distinct_values, NULL::VARCHAR AS mode FROM {ORDERS_GAPS}"""


@query("orders", sql=rsql("missing_percent mean std min max", f"{_NUMBER} UNION ALL {union(LABELS, _COUNTED)}", "column kind count distinct_values mode", 4))
def summary_table(t):
    return rounded(reports.summary_table(gaps(t, "o_totalprice", "o_orderkey"), ["o_totalprice", *LABELS]), 4)


_CVS = [f"stddev_samp({c}) / avg({c})" for c in ("o_orderkey", "o_custkey", "o_totalprice")]


@query("orders", sql=rsql("completeness average_cv", f"SELECT 100 * (5 * count(*) + count(o_totalprice)) / (6.0::DOUBLE * count(*)) AS completeness, 1::BIGINT AS columns_with_missing, count(o_totalprice) AS complete_rows, ({' + '.join(_CVS)}) / 3 AS average_cv, {' + '.join(f'({c} > 1)::BIGINT' for c in _CVS)} AS high_cv_columns, completeness < 90 AS much_missing, count(*) - count(DISTINCT o_orderkey) > 0.05 * count(*) AS many_duplicates FROM {ORDERS_GAPS}", "columns_with_missing complete_rows high_cv_columns much_missing many_duplicates"))
def statistical_summary(t):
    return rounded(reports.statistical_summary(gaps(t, "o_totalprice", "o_orderkey")))


@query("customer", sql=rsql("latitude_share longitude_share", union(["c_custkey", "c_acctbal"], """SELECT '{c}' AS "column", count(*) FILTER (abs({c}) <= 90) / count({c})::DOUBLE AS latitude_share, count(*) FILTER (abs({c}) <= 180) / count({c})::DOUBLE AS longitude_share FROM customer"""), "column"))
def coordinate_shares(t):
    return rounded(reports.coordinate_shares(t, ["c_custkey", "c_acctbal"]))


_HEAD = "(SELECT * FROM nation ORDER BY n_nationkey LIMIT 100)"


@query("nation", sql=f"""SELECT 'n_nationkey' AS "column", NULL::VARCHAR AS samples, min(n_nationkey)::DOUBLE AS min, max(n_nationkey)::DOUBLE AS max, avg(n_nationkey) AS mean FROM {_HEAD}
    UNION ALL SELECT 'n_name', (SELECT string_agg(n_name, ', ' ORDER BY n_name) FROM (SELECT DISTINCT n_name FROM {_HEAD} ORDER BY n_name LIMIT 5)), NULL, NULL, NULL
    UNION ALL SELECT 'n_regionkey', NULL, min(n_regionkey), max(n_regionkey), avg(n_regionkey) FROM {_HEAD}""")
def domain_scan(t):
    return reports.domain_scan(t.select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"])


@query("customer", sql="SELECT c_custkey FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 1000")
def detection_sample(t):
    return reports.detection_sample(t, "c_custkey").select("c_custkey")


_FIRST = "(SELECT * FROM orders ORDER BY o_orderkey LIMIT 5)"
_LIST = "(SELECT string_agg({x}::VARCHAR, ', ' ORDER BY o_orderkey) FROM " + _FIRST + ")"


@query("orders", sql=f"""SELECT 'o_orderkey' AS "column", 'preserved' AS transformation, {_LIST.format(x="o_orderkey")} AS "before", {_LIST.format(x="o_orderkey")} AS "after"
    UNION ALL SELECT 'o_orderstatus', 'preserved', {_LIST.format(x="o_orderstatus")}, {_LIST.format(x="CASE WHEN o_orderstatus = 'F' THEN 'NULL' ELSE o_orderstatus END")}
    UNION ALL SELECT 'o_custkey', 'dropped', {_LIST.format(x="o_custkey")}, 'COLUMN_DROPPED' UNION ALL SELECT 'odd', 'added', 'COLUMN_ADDED', {_LIST.format(x="(o_orderkey % 2 = 1)")}""")
def before_and_after(t):
    before = t.select("o_orderkey", "o_orderstatus", "o_custkey")
    after = before.select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("o_orderstatus"), (F.col("o_orderkey") % 2 == 1).alias("odd"))
    return reports.before_and_after(before, after, "o_orderkey")


@query("orders", sql=f"""SELECT 'o_totalprice' AS "column", 'MEDIAN_IMPUTE' AS operation, 2 * (count(*) - count(o_totalprice)) AS rows_affected FROM {ORDERS_GAPS} UNION ALL SELECT 'ALL_COLUMNS', 'REMOVE_DUPLICATES', count(*) FROM orders""")
def cleaning_preview(t):
    rows = gaps(t, "o_totalprice", "o_orderkey")
    return reports.cleaning_preview(rows.unionByName(rows))


@query("lineitem", sql="SELECT 2::BIGINT AS original_columns, 4::BIGINT AS transformed_columns, 2::BIGINT AS new_columns, false AS many_new_columns, (sum((l_discount = 0)::INT) > 0)::BIGINT AS infinite_columns, (sum((l_discount = 0)::INT) > 0)::BIGINT + (max(l_quantity) * 1e9 > 1e10)::BIGINT AS huge_columns, sum((l_discount = 0)::INT) = 0 AS valid FROM lineitem")
def transformation_check(t):
    before = t.select("l_quantity", "l_discount")
    x, d = F.col("l_quantity").cast("double"), F.col("l_discount").cast("double")
    return reports.transformation_check(before, before.select("*", F.when(d == 0, float("inf")).otherwise(x / F.when(d != 0, d)).alias("l_ratio"), (x * 1e9).alias("l_large")))


@query("lineitem", sql=rsql("importance completeness", "SELECT 'l_quantity' AS feature, var_samp(l_quantity) AS importance, 1::DOUBLE AS completeness FROM lineitem UNION ALL SELECT 'l_discount', var_samp(l_discount), 1 FROM lineitem UNION ALL SELECT 'odd_flag', count(*) FILTER (l_orderkey % 2 = 1) / count(*)::DOUBLE, count(*) FILTER (l_orderkey % 2 = 1) / count(*)::DOUBLE FROM lineitem", "feature"))
def feature_catalog(t):
    return rounded(reports.feature_importance(t.withColumn("odd_flag", F.when(F.col("l_orderkey") % 2 == 1, F.col("l_returnflag"))), ["l_quantity", "l_discount", "odd_flag"]))


@query("lineitem", sql="SELECT (abs(corr(l_quantity, l_extendedprice)) > 0.9)::BIGINT + (abs(corr(l_quantity, l_discount)) > 0.9)::BIGINT + (abs(corr(l_extendedprice, l_discount)) > 0.9)::BIGINT AS correlated_pairs, (stddev_samp(l_quantity) > 1000 OR max(l_quantity) - min(l_quantity) > 10000)::BIGINT + (stddev_samp(l_extendedprice) > 1000 OR max(l_extendedprice) - min(l_extendedprice) > 10000)::BIGINT + (stddev_samp(l_discount) > 1000)::BIGINT AS columns_to_scale, (count(DISTINCT l_returnflag) > 50)::BIGINT AS wide_categories FROM lineitem")
def feature_advice(t):
    return reports.feature_advice(t.select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag"))


@query("orders", sql=f"SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM {ORDERS_GAPS})), 4) AS price_norm, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus ELSE (SELECT o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) END AS status_encoded FROM {ORDERS_GAPS}")
def fill_derived(t):
    rows = gaps(gaps(t, "o_totalprice", "o_orderkey"), "o_orderstatus", "o_orderkey", 7)
    return rounded(reports.fill_derived(rows.select("o_orderkey", F.col("o_totalprice").alias("price_norm"), F.col("o_orderstatus").alias("status_encoded"))), 4)


_MONTHS = "(SELECT date_trunc('month', o_orderdate) AS month, avg(o_totalprice) AS x FROM orders GROUP BY 1)"
_LAGS = ", ".join(f"lag(x, {k}) OVER (ORDER BY month) AS l{k}" for k in range(1, 13))


@query("orders", sql=f"""SELECT n AS months, round(CASE WHEN n >= 24 THEN list_max(r) ELSE 0 END, 6) AS seasonality_score, CASE WHEN n >= 24 THEN len(list_filter(r, lambda v: v > 0.3)) ELSE 0 END::BIGINT AS significant_lags
    FROM (SELECT n, list_slice(r, 1, least(12, n // 4)) AS r FROM (SELECT count(*) AS n, [{', '.join(f'abs(corr(x, l{k}))' for k in range(1, 13))}] AS r FROM (SELECT x, {_LAGS} FROM {_MONTHS})))""")
def seasonality_score(t):
    return rounded(reports.seasonality(t, "o_orderdate", "o_totalprice"))


@query("documents", "orders", sql=f"""SELECT count(*) AS total_columns, count(*) FILTER (confidence > 0.8) AS high_confidence, count(*) FILTER (confidence BETWEEN 0.6 AND 0.8) AS to_review, count(*) FILTER (confidence < 0.6) AS low_confidence, round(count(*) FILTER (confidence > 0.8) / count(*)::DOUBLE, 6) AS confidence_rate, count(*) FILTER (id >= 0.6) AS likely_ids FROM ({ORACLE_SQL["type_detection_scores"]})""")
def schema_info(d, o):
    scores = detect.type_scores(d, ["doc_id", "lang", "source", "n_chars"]).unionByName(detect.type_scores(o, ["o_orderstatus", "o_orderdate", "o_totalprice"]))
    return rounded(reports.schema_info(scores))


_R = ["l_quantity", "l_extendedprice", "l_discount"]
_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) AS n FROM lineitem" for a, b in ((_R[0], _R[1]), (_R[0], _R[2]), (_R[1], _R[2])))


@query("lineitem", sql=rsql("value", f"""SELECT 'kpi' AS kind, subject, value, NULL AS label FROM ({union(_R, "SELECT '{c}' AS subject, avg({c}) AS value FROM lineitem")})
    UNION ALL SELECT 'correlation', a || ' ~ ' || b, r, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END FROM ({_PAIRS}) WHERE abs(r) * sqrt((n - 2) / (1 - r * r)) > 1.96""", "kind subject label", 4))
def evidence(t):
    return rounded(reports.evidence(numeric_kpis(t, _R), significance.correlations(t, _R)), 4)


_LEVEL = "CASE o_orderstatus WHEN 'F' THEN 'HIGH' WHEN 'O' THEN 'MEDIUM' ELSE 'LOW' END"


@query("orders", sql=f"""SELECT n AS findings, round(h, 6) AS high_percent, round(s, 6) AS score, CASE WHEN h >= 60 THEN 'HIGH' WHEN h >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS insight_level, CASE WHEN s >= 80 THEN 'HIGH' WHEN s >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS score_level
    FROM (SELECT count(*) AS n, 100::DOUBLE * count(*) FILTER (c = 'HIGH') / count(*) AS h, avg(CASE c WHEN 'HIGH' THEN 90 WHEN 'MEDIUM' THEN 70 ELSE 50 END) AS s FROM (SELECT {_LEVEL} AS c FROM orders))""")
def findings_confidence(t):
    return rounded(reports.findings_confidence(t.select(F.expr(_LEVEL).alias("confidence"))))


@query("part", sql="SELECT 'paid' AS name, p_brand AS choice, round(0.8 * avg(p_size), 6) AS confidence, 'id' AS pattern FROM part WHERE lower(p_name) LIKE '%id%' GROUP BY p_brand ORDER BY avg(p_size) DESC, p_brand LIMIT 1")
def mapping_by_pattern(t):
    return rounded(memory.suggest_by_pattern(t, ["paid", "no_such"], "p_name", "p_brand", "p_size"))


@query("nation", "orders", sql="SELECT 'nation' AS table_name, count(*) AS n FROM nation UNION ALL SELECT 'orders', count(*) FROM orders")
def table_counts(n, o):
    return memory.table_counts({"nation": n, "orders": o})


@query("orders", sql="""WITH me AS (SELECT 'F' AS status, '1-URGENT' AS domain, 100 AS width, 1 AS id), exact AS (SELECT o_orderkey, o_orderdate, 'exact_schema_match' AS similarity, 0 AS d, 0 AS o FROM orders, me WHERE o_orderstatus = status AND o_orderkey <> id ORDER BY o_orderdate DESC, o_orderkey LIMIT 3),
    near AS (SELECT o_orderkey, o_orderdate, 'domain_similarity' AS similarity, abs(o_custkey - width) AS d, 1 AS o FROM orders, me WHERE o_orderpriority = domain AND o_orderkey <> id ORDER BY d, o_orderdate DESC, o_orderkey LIMIT 5)
    SELECT o_orderkey, similarity FROM (SELECT * FROM exact UNION ALL SELECT * FROM near WHERE o_orderkey NOT IN (SELECT o_orderkey FROM exact)) ORDER BY o, d, o_orderdate DESC, o_orderkey LIMIT 5""")
def similar_runs(t):
    runs = memory.similar_runs(t, "o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey", "o_orderdate", run=1, fingerprint="F", of="1-URGENT", width=100, exact=3)
    return runs.select("o_orderkey", "similarity")


@query("orders", sql="""SELECT o_orderpriority, runs, round(q, 4) AS quality, q < 70 AS low_quality, runs > 5 AS experienced, top_issue FROM (SELECT o_orderpriority, count(*) AS runs, avg(o_totalprice) AS q FROM orders GROUP BY 1)
    LEFT JOIN (SELECT o_orderpriority, o_orderstatus AS top_issue, row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, o_orderstatus) AS r FROM orders GROUP BY 1, 2) USING (o_orderpriority) WHERE r = 1""")
def memory_insights(t):
    return rounded(memory.insights(t, t, "o_orderpriority", "o_totalprice", "o_orderstatus"), 4)


@query("orders", sql="SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def latest_runs(t):
    return memory.latest(t, "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("orders", sql=rsql("gini", "SELECT (2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*)::DOUBLE) AS gini FROM (SELECT o_custkey, sum(o_totalprice) AS x, row_number() OVER (ORDER BY sum(o_totalprice), o_custkey) AS i FROM orders GROUP BY 1)"))
def gini_of_many_groups(t):
    return rounded(stats.gini(t, "o_custkey", "o_totalprice").select("gini"))

