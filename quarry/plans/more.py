"""Registered queries of summaries, significance and the run memory's statistics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import memory, significance, summary
from .catalogue import KPI_COLUMNS, ORDERS_GAPS, gaps, query, rounded, rsql, union

_DESCRIBE = """SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS median, quantile_cont({c}, 0.75) AS q75, max({c})::DOUBLE AS max FROM lineitem"""


@query("lineitem", sql=rsql("mean std min q25 median q75 max", union(KPI_COLUMNS, _DESCRIBE), "column count", 2))
def describe_table(t):
    return summary.describe(t, KPI_COLUMNS)


@query("orders", sql=rsql("missing_share", f"SELECT count(*) AS rows, count(*) - count(o_totalprice) AS missing_cells, count(o_totalprice) AS complete_rows, 6::BIGINT AS columns, 3::BIGINT AS numeric_columns, 1::BIGINT AS time_columns, 2::BIGINT AS other_columns, (count(*) - count(o_totalprice)) / (6.0 * count(*)) AS missing_share FROM {ORDERS_GAPS}", "rows missing_cells complete_rows columns numeric_columns time_columns other_columns"))
def dataset_profile(t):
    return rounded(summary.dataset_profile(gaps(t, "o_totalprice", "o_orderkey")))


@query("orders", sql=" UNION ALL ".join(f"""SELECT * FROM (SELECT '{c}' AS "column", row_number() OVER (ORDER BY count(*) DESC, {c}) AS place, {c} AS value, count(*) AS n FROM orders GROUP BY {c}) WHERE place <= 5""" for c in ("o_orderstatus", "o_orderpriority")))
def top_values_by_column(t):
    return summary.top_values(t, ["o_orderstatus", "o_orderpriority"])


@query("lineitem", sql=union(["l_shipdate"], """SELECT '{c}' AS "column", min({c})::DATE AS "first", max({c})::DATE AS "last", count(*) - count({c}) AS missing, date_diff('day', min({c})::DATE, max({c})::DATE) AS days FROM lineitem"""))
def date_ranges(t):
    return summary.date_ranges(t, ["l_shipdate"])


@query("orders", sql=rsql("completeness o_totalprice_total o_totalprice_mean o_totalprice_median", f"SELECT o_orderpriority, count(*) AS records, 100.0 * count(o_totalprice) / count(*) AS completeness, sum(o_totalprice) AS o_totalprice_total, avg(o_totalprice) AS o_totalprice_mean, median(o_totalprice) AS o_totalprice_median FROM {ORDERS_GAPS} GROUP BY 1", "o_orderpriority records", 4))
def region_completeness(t):
    return rounded(summary.region_completeness(gaps(t, "o_totalprice", "o_orderkey"), "o_orderpriority", ["o_totalprice"]), 4)


@query("orders", sql=f"""SELECT round(c, 6) AS completeness_score, s AS sample_size_score, v AS variability_score, 100.0::DOUBLE AS data_type_diversity_score, round((0.3 * c + 0.25 * s + 0.25 * v + 20) / 100, 3) AS overall_score
    FROM (SELECT 100.0 * (5 * count(*) + count(o_totalprice)) / (6 * count(*)) AS c, CASE WHEN count(*) >= 1000 THEN 100 WHEN count(*) >= 100 THEN 80 WHEN count(*) >= 30 THEN 60 ELSE 30 END::DOUBLE AS s,
    100.0 * ((count(DISTINCT o_orderkey) > 1)::INT + (count(DISTINCT o_custkey) > 1)::INT + (count(DISTINCT o_totalprice) > 1)::INT) / 3 AS v FROM {ORDERS_GAPS})""")
def analysis_quality(t):
    return rounded(summary.analysis_quality(gaps(t, "o_totalprice", "o_orderkey")))


@query("orders", sql="""SELECT 'o_totalprice' AS "column", avg((o_totalprice IS NULL)::INT) > 0.3 AS high_missing, min(o_totalprice) = max(o_totalprice) AS zero_variance, 1 - count(*) / (SELECT count(*) FROM orders)::DOUBLE > 0.1 AS row_loss FROM (SELECT CASE WHEN o_orderkey % 2 <> 0 THEN o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 5 <> 0)""")
def cleaning_flags(t):
    half = gaps(t.where("o_orderkey % 5 <> 0"), "o_totalprice", "o_orderkey", 2)
    return summary.cleaning_flags(t, half.select("o_totalprice"))


@query("orders", sql=rsql("total mean growth", "SELECT *, 100 * (total / lag(total) OVER (ORDER BY period) - 1) AS growth FROM (SELECT date_trunc('quarter', o_orderdate)::DATE AS period, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, count(o_totalprice) AS n FROM orders GROUP BY 1)", "period n", 4))
def quarterly_totals(t):
    return rounded(summary.by_grain(t, "o_orderdate", "o_totalprice", "quarter"), 4)


@query("nation", sql="SELECT md5(string_agg(n_nationkey || ',' || n_name || ',' || n_regionkey, chr(10) ORDER BY n_nationkey)) AS md5 FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 100)")
def head_fingerprint(t):
    return summary.head_fingerprint(t, ["n_nationkey"], ["n_nationkey", "n_name", "n_regionkey"])


@query("orders", sql=f"SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, CASE WHEN o_totalprice IS NULL THEN 'NULL' ELSE 'filled' END AS o_totalprice FROM {ORDERS_GAPS} WHERE o_orderkey >= 28 ORDER BY o_orderkey::BIGINT LIMIT 5")
def text_preview(t):
    rows = gaps(t, "o_totalprice", "o_orderkey").where("o_orderkey >= 28").select("o_orderkey", "o_orderstatus", F.when(F.col("o_totalprice").isNotNull(), "filled").alias("o_totalprice"))
    return summary.text_preview(rows, ["o_orderkey"])


_MIXED = "CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE o_custkey::VARCHAR END"


@query("orders", sql=f"SELECT o_orderkey, try_cast({_MIXED} AS DOUBLE) AS mixed, o_orderstatus FROM orders")
def strings_to_numbers(t):
    mixed = F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.col("o_custkey").cast("string"))
    return summary.strings_to_numbers(t.select("o_orderkey", mixed.alias("mixed"), "o_orderstatus"))


@query("orders", sql=f"SELECT o_orderkey, try_cast({_MIXED} AS BIGINT) AS mixed FROM orders")
def safe_cast(t):
    mixed = F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.col("o_custkey").cast("string"))
    return summary.safe_cast(t.select("o_orderkey", mixed.alias("mixed")), {"mixed": "integer"})


_MOMENTS = "SELECT {g} AS g, count({v})::DOUBLE AS n, avg({v}) AS m, var_samp({v}) AS v FROM lineitem GROUP BY 1"


@query("lineitem", sql=rsql("d", f"SELECT (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS d FROM (SELECT arg_min(x, x.g) AS a, arg_max(x, x.g) AS b FROM ({_MOMENTS.format(g='l_linestatus', v='l_quantity')}) x)"))
def cohens_d_pooled(t):
    return rounded(significance.cohens_d(t, "l_quantity", "l_linestatus"))


# Of three groups the tail of F has a closed form, as that of chi-square has for an even number of degrees of freedom.
@query("lineitem", sql=f"SELECT round(power(1 + 2 * f / dw, -dw / 2), 5) AS p_value, power(1 + 2 * f / dw, -dw / 2) < 0.05 AS significant FROM (SELECT (sum(n * m * m) - sum(n) * power(sum(n * m) / sum(n), 2)) / (count(*) - 1) / (sum((n - 1) * v) / (sum(n) - count(*))) AS f, sum(n) - count(*) AS dw FROM ({_MOMENTS.format(g='l_returnflag', v='l_quantity')}))")
def anova_significance(t):
    return rounded(significance.anova(t, "l_quantity", "l_returnflag").select("p_value", "significant"), 5)


@query("orders", sql="""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT a, sum(n) AS ra FROM c GROUP BY a), k AS (SELECT b, sum(n) AS rb FROM c GROUP BY b), t AS (SELECT sum(n) AS t FROM c),
    x AS (SELECT sum(power(coalesce(n, 0) - ra * rb / t::DOUBLE, 2) / (ra * rb / t::DOUBLE)) / 2 AS h FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c USING (a, b))
    SELECT round(exp(-h) * (1 + h + h * h / 2 + h * h * h / 6), 6) AS p_value, exp(-h) * (1 + h + h * h / 2 + h * h * h / 6) < 0.05 AS significant FROM x""")
def chi_square_significance(t):
    return rounded(significance.chi_square(t, "o_orderstatus", "o_orderpriority").select("p_value", "significant"))


@query("lineitem", sql="""WITH v AS (SELECT l_quantity AS x, l_returnflag AS g, count(*) AS c FROM lineitem GROUP BY ALL), a AS (SELECT x, sum(c) AS n FROM v GROUP BY x), r AS (SELECT x, n, coalesce(sum(n) OVER (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS k FROM a),
    s AS (SELECT g, sum(c)::DOUBLE AS n, sum(c * k)::DOUBLE AS q FROM v JOIN r USING (x) GROUP BY g), t AS (SELECT sum(n)::DOUBLE AS n, sum(power(n, 3) - n) AS ties FROM a),
    h AS (SELECT (12 / (t.n * (t.n + 1)) * (SELECT sum(q * q / n) FROM s) - 3 * (t.n + 1)) / (1 - ties / (power(t.n, 3) - t.n)) AS h FROM t)
    SELECT round(exp(-h / 2), 5) AS p_value, exp(-h / 2) < 0.05 AS significant FROM h""")
def kruskal_significance(t):
    return rounded(significance.kruskal(t, "l_quantity", "l_returnflag").select("p_value", "significant"), 5)


@query("orders", sql=rsql("avg_o_totalprice", "SELECT o_orderpriority, count(*) AS runs, avg(o_totalprice) AS avg_o_totalprice FROM orders GROUP BY 1", "o_orderpriority runs", 4))
def domain_statistics(t):
    return rounded(memory.domain_statistics(t, "o_orderpriority", ["o_totalprice"]), 4)


@query("orders", sql="SELECT o_orderpriority, count(*) AS successes FROM orders WHERE o_orderstatus = 'F' AND o_orderdate > DATE '1998-01-01' - 1000 GROUP BY 1")
def recent_successes(t):
    return memory.recent_successes(t, "o_orderpriority", F.col("o_orderstatus") == "F", "o_orderdate", "1998-01-01", 1000)


@query("lineitem", sql="SELECT l_returnflag, l_suppkey, frequency, place FROM (SELECT l_returnflag, l_suppkey, count(*) AS frequency, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_suppkey) AS place FROM lineitem GROUP BY 1, 2) WHERE place <= 5")
def issue_frequency(t):
    return memory.most_frequent(t, "l_returnflag", "l_suppkey")


@query("lineitem", sql="SELECT l_returnflag, l_linenumber, round(e, 6) AS effectiveness, place FROM (SELECT l_returnflag, l_linenumber, avg(l_quantity) AS e, row_number() OVER (PARTITION BY l_returnflag ORDER BY avg(l_quantity) DESC, l_linenumber) AS place FROM lineitem GROUP BY 1, 2) WHERE place <= 3")
def best_remediation(t):
    return rounded(memory.most_effective(t, "l_returnflag", "l_linenumber", "l_quantity"))
