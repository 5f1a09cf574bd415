"""Registered queries of casts, names, flags, findings and traces, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, memory, naming, profile, reports, significance, stats, summary
from . import trace
from .catalogue import ORDERS_GAPS, gaps, query, rounded, rsql

_WORDS = "CASE o_orderkey % 6 WHEN 0 THEN o_custkey || '.0' WHEN 1 THEN o_custkey::VARCHAR WHEN 2 THEN 'x' || o_custkey WHEN 3 THEN '1.0' WHEN 4 THEN ' YES ' END"


def words():
    k, c = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    return F.when(k == 0, F.concat(c, F.lit(".0"))).when(k == 1, c).when(k == 2, F.concat(F.lit("x"), c)).when(k == 3, "1.0").when(k == 4, " YES ")


@query("orders", sql=f"""SELECT o_orderkey, try_cast(try_cast(w AS DOUBLE) AS BIGINT) AS i, CASE WHEN lower(trim(w)) IN ('true', '1', 'yes', 'y', 't', '1.0') THEN true WHEN lower(trim(w)) IN ('false', '0', 'no', 'n', 'f', '0.0') THEN false END AS b, try_cast(w AS DOUBLE) AS x, w AS s
    FROM (SELECT o_orderkey, {_WORDS} AS w FROM orders)""")
def cast_by_rule(t):
    x = t.select("o_orderkey", *[words().alias(c) for c in "ibxs"])
    return summary.safe_cast(x, {"i": "integer", "b": "boolean", "x": "numeric", "s": "whatever"})


@query("orders", sql=f"""SELECT 'i' AS "column", 'integer' AS kind, 'cast' AS status, count(*) FILTER (WHERE w IS NOT NULL AND try_cast(w AS DOUBLE) IS NULL)::BIGINT AS lost FROM (SELECT {_WORDS} AS w FROM orders) UNION ALL SELECT 'absent', 'float', 'missing', NULL""")
def cast_losses(t):
    return summary.cast_report(t.select(words().alias("i")), {"i": "integer", "absent": "float"})


@query("orders", sql="SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey::DOUBLE END AS part, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey::DOUBLE END AS week, CASE WHEN o_orderkey % 5 < 3 THEN o_custkey::VARCHAR ELSE 'n/a' END AS few FROM orders")
def numbers_by_rule(t):
    """About three in four values are numbers, one in four under a name of weeks, three in five."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    x = t.select("o_orderkey", F.when(k % 4 != 0, c).otherwise("n/a").alias("part"), F.when(k % 4 == 0, c).otherwise("n/a").alias("week"), F.when(k % 5 < 3, c).otherwise("n/a").alias("few"))
    return summary.strings_to_numbers(x)


@query("orders", sql="SELECT o_orderkey, year(d)::BIGINT AS order_date_year, month(d)::BIGINT AS order_date_month, CASE WHEN o_orderkey % 5 < 4 THEN 'no date' ELSE '2020-01-01' END AS note_time FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS d FROM orders)")
def text_dates(t):
    """Dates as text: two in three parse and become times, one in five do not."""
    k = F.col("o_orderkey")
    x = t.select("o_orderkey", F.when(k % 3 != 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("soon").alias("order_date"), F.when(k % 5 < 4, "no date").otherwise("2020-01-01").alias("note_time"))
    out, times = features.parsed_dates(x)
    for c in times:
        out = features.calendar(out, c)
    return out.select("o_orderkey", "order_date_year", "order_date_month", "note_time")


@query("customer", sql=rsql("acctbal_per_populationnow acctbal_per_1000 acctbal_per_families", "SELECT c_custkey, c_acctbal / nullif(c_nationkey % 5, 0) AS acctbal_per_populationnow, 1000 * c_acctbal / nullif(c_nationkey % 5, 0) AS acctbal_per_1000, c_acctbal / (c_nationkey + 1) AS acctbal_per_families FROM customer", "c_custkey"))
def per_capita(t):
    x = t.select("c_custkey", F.col("c_acctbal").alias("acctbal"), (F.col("c_nationkey") % 5).cast("long").alias("population_now"), (F.col("c_nationkey") + 1).cast("long").alias("families"), F.lit(0).alias("households"))
    out = features.per_capita(x, naming.columns_for(x, "denominator"))
    return rounded(out.select("c_custkey", "acctbal_per_populationnow", "acctbal_per_1000", "acctbal_per_families"))


_FLAGS = """WITH o AS (SELECT o_orderkey::VARCHAR AS code, 'one' AS same, value, CASE WHEN k % 4 <> 0 THEN value END AS holes FROM (SELECT event_id AS o_orderkey, event_id AS k, value FROM events)),
    q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, quantile_cont(holes, 0.25) AS c, quantile_cont(holes, 0.75) AS d FROM o)
    SELECT 'high_cardinality' AS flag, 'code' AS subject, count(DISTINCT code)::DOUBLE AS value FROM o UNION ALL SELECT 'constant', 'same', 1.0
    UNION ALL SELECT 'many_outliers', 'value', n FROM (SELECT count(*)::DOUBLE AS n FROM o, q WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) WHERE n > 0.01 * (SELECT count(*) FROM o)
    UNION ALL SELECT 'many_outliers', 'holes', n FROM (SELECT count(*)::DOUBLE AS n FROM o, q WHERE holes < c - 1.5 * (d - c) OR holes > d + 1.5 * (d - c)) WHERE n > 0.01 * (SELECT count(*) FROM o)
    UNION ALL SELECT 'much_missing', NULL, count(*) FILTER (WHERE holes IS NULL) / (4.0 * count(*)) FROM o HAVING count(*) FILTER (WHERE holes IS NULL) > 0.05 * 4 * count(*)"""


@query("events", sql=rsql("value", _FLAGS, "flag subject"))
def profile_flags(t):
    x = t.select(F.col("event_id").cast("string").alias("code"), F.lit("one").alias("same"), "value", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("holes"))
    return rounded(reports.profile_flags(x, most_missing=0.05, most_outliers=0.01))


@query("events", sql="SELECT event_type AS mode, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, mode LIMIT 1")
def mode_of_column(t):
    return stats.mode_of(t, "event_type")


@query("part", sql=rsql("confidence", """WITH m AS (SELECT lower(p_brand) AS low, p_type AS choice, avg(p_size) AS confidence, count(*) AS votes FROM part GROUP BY ALL)
    SELECT name, choice, confidence, 'exact' AS rule FROM (SELECT name, choice, confidence, row_number() OVER (PARTITION BY name ORDER BY votes DESC, confidence DESC, choice) AS r FROM m JOIN (SELECT DISTINCT upper(p_brand) AS name FROM part WHERE p_partkey <= 50) n ON lower(name) = low) WHERE r = 1""", "name choice rule"))
def mapping_suggestion(t):
    """Brands as column names that were mapped to types; the names asked for are known ones in capitals."""
    asked = [r[0] for r in t.where("p_partkey <= 50").select(F.upper("p_brand").alias("n")).distinct().collect()]
    return rounded(memory.suggest(t, asked, "p_brand", "p_type", "p_size"))


_TREND = "SELECT '{m}' AS metric, regr_slope({m}, d) AS slope, regr_intercept({m}, d) AS intercept, regr_r2({m}, d) AS r2, regr_count({m}, d)::BIGINT AS n FROM (SELECT *, epoch_us(o_orderdate) / 86400000000.0 AS d FROM {t})"


@query("orders", sql=rsql("slope intercept r2", f"SELECT *, CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'flat' END AS direction FROM ({_TREND.format(m='o_totalprice', t=ORDERS_GAPS)} UNION ALL {_TREND.format(m='o_custkey', t=ORDERS_GAPS)})", "metric n direction", 4))
def trends_over_time(t):
    out = significance.trends_over_time(gaps(t, "o_totalprice", "o_orderkey"), "o_orderdate", ["o_totalprice", "o_custkey"])
    return rounded(out.select("metric", "slope", "intercept", "r2", "n", "direction"), 4)


@query("orders", sql=f"""SELECT 1 AS id, 'kpi' AS kind, 'Key metric o_totalprice shows significant variation across the dataset' AS finding, format('Mean value: {{:.1f}}', avg(o_totalprice)) AS evidence, 'MEDIUM' AS confidence FROM {ORDERS_GAPS}""")
def findings_by_rule(t):
    x = gaps(t, "o_totalprice", "o_orderkey")
    kpis = profile.numeric_kpis(x, ["o_totalprice"])
    return reports.fallback_findings(reports.evidence(kpis, significance.correlations(x, ["o_totalprice", "o_custkey"])))


@query("lineitem", sql=rsql("value", """SELECT 'numeric' AS section, c AS subject, i AS item, v AS value FROM (SELECT 'l_quantity' AS c, unnest(['mean', 'std', 'min', 'max']) AS i, unnest([avg(l_quantity), stddev_samp(l_quantity), min(l_quantity), max(l_quantity)]) AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', unnest(['mean', 'std', 'min', 'max']), unnest([avg(l_extendedprice), stddev_samp(l_extendedprice), min(l_extendedprice), max(l_extendedprice)]) FROM lineitem)
    UNION ALL SELECT 'numeric', 'l_quantity', 'outliers', count(*)::DOUBLE FROM lineitem, (SELECT quantile_cont(l_quantity, 0.25) AS a, quantile_cont(l_quantity, 0.75) AS b FROM lineitem) WHERE l_quantity < a - 1.5 * (b - a) OR l_quantity > b + 1.5 * (b - a)
    UNION ALL SELECT 'numeric', 'l_extendedprice', 'outliers', count(*)::DOUBLE FROM lineitem, (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem) WHERE l_extendedprice < a - 1.5 * (b - a) OR l_extendedprice > b + 1.5 * (b - a)
    UNION ALL SELECT 'categorical', 'l_returnflag', l_returnflag, count(*)::DOUBLE FROM lineitem GROUP BY l_returnflag
    UNION ALL SELECT * FROM (SELECT 'pair', 'l_quantity', 'l_extendedprice', corr(l_quantity, l_extendedprice) AS r FROM lineitem) WHERE abs(r) > 0.5
    UNION ALL SELECT s, f, 'l_quantity', m FROM (SELECT l_returnflag AS f, avg(l_quantity) AS m, unnest(['top', 'bottom']) AS s FROM lineitem GROUP BY 1)""", "section subject item", 4))
def report_data_summary(t):
    return rounded(reports.data_summary(t.select("l_quantity", "l_extendedprice", "l_returnflag"), place="l_returnflag"), 4)


@query("events", sql=rsql("seconds success_rate", "SELECT user_id::VARCHAR AS run_id, count(*) AS stages, count(*) FILTER (WHERE event_id % 7 = 0) AS failed, sum(value) AS seconds, 100.0 * count(*) FILTER (WHERE event_id % 7 <> 0) / count(*) AS success_rate, CASE WHEN count(*) FILTER (WHERE event_id % 7 = 0) = 0 THEN 'completed' ELSE 'completed_with_errors' END AS status FROM events GROUP BY 1", "run_id stages failed status", 4))
def trace_summary(t):
    """Events as the log of stages of runs: a user is a run."""
    log = t.select(F.col("user_id").cast("string").alias("run_id"), F.when(F.col("event_id") % 7 == 0, "failed").otherwise("completed").alias("status"), F.col("value").alias("seconds"))
    return rounded(trace.trace_summary(log), 4)


@query("events", sql=rsql("mean_seconds longest_seconds rows_per_second", "SELECT event_type AS stage, count(*) AS runs, count(*) FILTER (WHERE event_id % 7 = 0) AS failed, avg(value) AS mean_seconds, max(value) AS longest_seconds, sum(user_id) FILTER (WHERE event_id % 7 <> 0) / sum(value) FILTER (WHERE event_id % 7 <> 0) AS rows_per_second FROM events GROUP BY 1", "stage runs failed", 4))
def stage_statistics(t):
    log = t.select(F.col("event_type").alias("stage"), F.when(F.col("event_id") % 7 == 0, "failed").otherwise("completed").alias("status"), F.col("value").alias("seconds"), F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("rows"))
    return rounded(trace.stage_statistics(log), 4)


@query("part", sql=rsql("highest lowest mean std", """WITH b AS (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part), e AS (SELECT p_brand, avg(p_size) AS s, avg(p_retailprice) AS r FROM part GROUP BY 1),
    s AS (SELECT ((s - a) / (b - a)::DOUBLE + (r - c) / (d - c)) / 2 AS score FROM e, b) SELECT count(*) AS entities, max(score) AS highest, min(score) AS lowest, avg(score) AS mean, stddev_samp(score) AS std FROM s""", "entities"))
def score_statistics(t):
    return rounded(stats.score_statistics(t, "p_brand", ["p_size", "p_retailprice"]))


@query("orders", sql=""" SELECT c AS "column", samples[1] AS first_sample, len(samples)::INT AS n FROM (SELECT 'o_orderstatus' AS c, list(v ORDER BY n DESC, v)[1:5] AS samples FROM (SELECT o_orderstatus AS v, count(*) AS n FROM orders GROUP BY 1) UNION ALL SELECT 'o_orderpriority', list(v ORDER BY n DESC, v)[1:5] FROM (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1))""")
def sample_values(t):
    out = summary.sample_values(t, ["o_orderstatus", "o_orderpriority"])
    return out.select("column", F.get("samples", F.lit(0)).alias("first_sample"), F.size("samples").alias("n"))
