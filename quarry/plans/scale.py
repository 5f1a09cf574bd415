"""Registered queries over whole orders and ranks, and tests of distributions, each with its SQL where there is one."""

from __future__ import annotations

from ..operators import features, normality, quantiles, significance
from .catalogue import KPI_COLUMNS, KS_NORMAL, ORDERS_GAPS, PHI, gaps, query, rounded, rsql, union

_TRENDS = """SELECT o_orderkey, avg(x) OVER (o ROWS 2 PRECEDING) AS x_rolling_3, avg(x) OVER (o ROWS 5 PRECEDING) AS x_rolling_6, avg(x) OVER (o ROWS 11 PRECEDING) AS x_rolling_12, lag(x) OVER o AS x_lag1, x - lag(x) OVER o AS x_diff,
    100 * (last_value(x IGNORE NULLS) OVER (o ROWS UNBOUNDED PRECEDING) / last_value(x IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1) AS x_pct_change
    FROM (SELECT o_orderkey, o_orderdate, o_totalprice AS x FROM {t}) WINDOW o AS (ORDER BY o_orderdate, o_orderkey)"""


@query("orders", sql=rsql("x_rolling_3 x_rolling_6 x_rolling_12 x_lag1 x_diff x_pct_change", _TRENDS.format(t=ORDERS_GAPS), "o_orderkey", 4))
def trends_of_whole_table(t):
    x = gaps(t, "o_totalprice", "o_orderkey").select("o_orderkey", "o_orderdate", "o_totalprice").withColumnRenamed("o_totalprice", "x")
    return rounded(features.trends(x, ["x"], "o_orderdate", "o_orderkey").drop("o_orderdate", "x"), 4)


@query("customer", sql="SELECT c_custkey, (dense_rank() OVER (ORDER BY c_name) - 1)::BIGINT AS c_name_encoded FROM customer")
def label_encode_names(t):
    return features.label_encode(t, "c_name").select("c_custkey", "c_name_encoded")


_PLACES = {"p01": 0.001, "p25": 0.25, "p50": 0.5, "p999": 0.999}


@query("lineitem", sql=rsql(" ".join(_PLACES), union(KPI_COLUMNS, f"""SELECT '{{c}}' AS "column", {", ".join(f"quantile_cont({{c}}, {p}) AS {k}" for k, p in _PLACES.items())} FROM lineitem"""), "column", 4))
def exact_percentiles(t):
    return rounded(quantiles.percentile_table(t, KPI_COLUMNS, _PLACES, few=50), 4)


@query("lineitem", sql=rsql("middle", "SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS middle FROM lineitem GROUP BY ALL", "l_returnflag l_linestatus", 4))
def medians_of_large_groups(t):
    return rounded(quantiles.group_medians(t, ["l_returnflag", "l_linestatus"], "l_extendedprice", "middle"), 4)


_P = "least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * k * k * x * x)))))"
_KS_P = "SELECT *, {p} AS p_value, {p} > 0.05 AS {verdict} FROM (SELECT d, n, d * (sqrt(n) + 0.12 + 0.11 / sqrt(n)) AS x FROM ({ks}))"


@query("events", sql=rsql("d p_value", _KS_P.format(p=_P, verdict="normal", ks=KS_NORMAL), "n normal"))
def ks_normal_test(t):
    return rounded(significance.ks_normal(t, "value"))


_KS_EXPONENTIAL = "SELECT max(greatest(hi / t - f, f - lo / t)) AS d, max(t) AS n FROM (SELECT 1 - exp(-value / m) AS f, rank() OVER (ORDER BY value) - 1 AS lo, count(*) OVER (ORDER BY value) AS hi, t FROM events, (SELECT avg(value) AS m, count(*)::DOUBLE AS t FROM events))"


@query("events", sql=rsql("d p_value", _KS_P.format(p=_P, verdict="exponential", ks=_KS_EXPONENTIAL), "n exponential"))
def ks_exponential_test(t):
    return rounded(significance.ks_exponential(t, "value"))


_U = """WITH x AS (SELECT l_linestatus AS g, l_quantity AS v, row_number() OVER (ORDER BY l_quantity) AS i FROM lineitem), r AS (SELECT g, avg(i) OVER (PARTITION BY v) AS r, count(*) OVER (PARTITION BY v) AS t FROM x),
    s AS (SELECT count(*) FILTER (WHERE g = 'F')::DOUBLE AS a, count(*) FILTER (WHERE g = 'O')::DOUBLE AS b, count(*)::DOUBLE AS n, sum(r) FILTER (WHERE g = 'F') AS q, sum(t * t - 1)::DOUBLE AS ties FROM r),
    u AS (SELECT *, q - a * (a + 1) / 2 AS u FROM s), z AS (SELECT *, greatest(0.0, abs(u - a * b / 2) - 0.5) / sqrt(a * b / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM u)"""


@query("lineitem", sql=f"{_U} SELECT 2::BIGINT AS groups, false AS normal, round(u, 1) AS statistic, round(2 * (1 - {PHI.format(z='z')}), 6) AS p_value, 2 * (1 - {PHI.format(z='z')}) < 0.05 AS significant FROM z")
def compare_two_groups(t):
    """Uniform quantities are not normal, so the gate chooses Mann and Whitney's test."""
    out = normality.compare_groups(t, "l_quantity", "l_linestatus", ["l_orderkey", "l_linenumber"])
    return rounded(out.select("groups", "normal", "statistic", "p_value", "significant"))


@query("part")
def normality_of_columns(t):
    """The Shapiro-Wilk test has no SQL: expected normal order statistics need the inverse of the normal distribution. tests/test_scale.py holds it against published values."""
    return rounded(normality.normality_tests(t, ["p_size", "p_retailprice"], ["p_partkey"]))
