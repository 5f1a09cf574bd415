"""Registered queries of the tabular operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clean, detect, features, memory, profile, quality, stats

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
KPI_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LABELS = ["o_orderstatus", "o_orderpriority"]


def query(*tables: str, sql: str | None = None):
    """Registers f(table, ...) under its name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def gaps(df: DataFrame, c: str, key: str, k: int = 30) -> DataFrame:
    """The table with nulls where the key is a multiple of k, as test input for operators on missing values."""
    return df.withColumn(c, F.when(F.col(key) % k != 0, F.col(c)))


def union(columns, sql: str) -> str:
    return " UNION ALL ".join(sql.replace("{c}", c) for c in columns)


ORDERS_GAPS = "(SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 30 <> 0 THEN o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders)"
_KPI = """SELECT '{c}' AS "column", count({c}) AS count, avg({c}) AS mean, quantile_cont({c}, 0.5) AS median, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, sum({c}) AS sum,
 quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.75) AS q75, skewness({c}) AS skewness, kurtosis({c}) AS kurtosis, quantile_cont({c}, 0.05) AS p5, quantile_cont({c}, 0.1) AS p10, quantile_cont({c}, 0.9) AS p90, quantile_cont({c}, 0.95) AS p95, quantile_cont({c}, 0.99) AS p99,
 quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS iqr, stddev_samp({c}) / avg({c}) AS cv, max({c}) - min({c}) AS range FROM lineitem"""


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, since sums hang on the order of rows in their last digits."""
    return df.select(*[F.round(F.col(f"`{c}`"), places).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in df.dtypes])


def rsql(columns: str, inner: str, others: str = "", places: int = 6) -> str:
    parts = [f'round("{c}", {places}) AS "{c}"' for c in columns.split()] + [f'"{c}"' for c in others.split()]
    return f"SELECT {', '.join(parts)} FROM ({inner})"


_STATS = "mean median std min max sum q25 q75 skewness kurtosis p5 p10 p90 p95 p99 iqr cv range"


@query("lineitem", sql=rsql(_STATS, union(KPI_COLUMNS, _KPI), "column count", 4))
def numeric_kpi_profile(t):
    return rounded(profile.numeric_kpis(t, KPI_COLUMNS), 4)


@query("orders", sql=rsql("mode_percent entropy top_concentration", union(LABELS, """SELECT '{c}' AS "column", count(*) AS distinct_values, max(CASE WHEN r = 1 THEN v END) AS mode, max(CASE WHEN r = 1 THEN n END) AS mode_count, max(CASE WHEN r = 1 THEN 100 * p END) AS mode_percent, -sum(p * log2(p)) AS entropy, 100 * sum(CASE WHEN r <= 3 THEN p END) AS top_concentration FROM (SELECT {c} AS v, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS p, row_number() OVER (ORDER BY count(*) DESC, {c}) AS r FROM orders GROUP BY {c})"""), "column distinct_values mode mode_count"))
def categorical_kpi_profile(t):
    return rounded(profile.categorical_kpis(t, LABELS))


@query("customer", sql=rsql("entropy", """SELECT 'c_mktsegment' AS "column", entropy(c_mktsegment) AS entropy FROM customer""", "column"))
def entropy_by_column(t):
    return rounded(profile.categorical_kpis(t, ["c_mktsegment"]).select("column", "entropy"))


@query("orders", sql='SELECT count(DISTINCT o_orderdate) AS periods, min(o_orderdate) AS "first", max(o_orderdate) AS "last", count(*) - count(o_orderdate) AS missing FROM orders')
def time_kpi(t):
    return profile.time_kpis(t, "o_orderdate")


@query("orders", sql=union(["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], f"""SELECT '{{c}}' AS "column", count(*) - count({{c}}) AS missing, count(*) AS rows, (count(*) - count({{c}}))::DOUBLE / count(*) AS missing_share FROM {ORDERS_GAPS}"""))
def missingness_profile(t):
    return profile.missingness(gaps(t, "o_totalprice", "o_orderkey"))


@query("lineitem", sql="SELECT sum(n)::BIGINT AS rows, sum(n - 1)::BIGINT AS duplicates, sum(n - 1)::DOUBLE / sum(n) AS rate FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_returnflag, l_linestatus)")
def duplicate_rate(t):
    return profile.duplicate_rate(t.select("l_suppkey", "l_returnflag", "l_linestatus"))


@query("lineitem", sql="SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def dedupe_exact(t):
    return clean.dedupe(t.select("l_suppkey", "l_returnflag"))


@query("orders", sql="SELECT o_custkey, o_orderstatus, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def dedupe_keep_first(t):
    return clean.dedupe(t.select("o_custkey", "o_orderstatus", "o_orderkey", F.col("o_orderkey").alias("_o")), ["o_custkey", "o_orderstatus"], "_o").drop("_o")


@query("orders", sql=f"SELECT count(*) AS rows, count(o_totalprice) AS complete FROM {ORDERS_GAPS}")
def complete_rows(t):
    return profile.complete_rows(gaps(t, "o_totalprice", "o_orderkey"))


@query("orders", sql=f"SELECT o_orderkey, coalesce(o_totalprice, (SELECT median(o_totalprice) FROM {ORDERS_GAPS})) AS o_totalprice FROM {ORDERS_GAPS}")
def median_impute(t):
    return clean.impute_median(gaps(t, "o_totalprice", "o_orderkey"), "o_totalprice").select("o_orderkey", "o_totalprice")


@query("orders", sql=f"SELECT o_orderkey, coalesce(o_totalprice, median(o_totalprice) OVER (PARTITION BY o_orderpriority)) AS o_totalprice FROM {ORDERS_GAPS}")
def group_median_impute(t):
    return clean.impute_group_median(gaps(t, "o_totalprice", "o_orderkey"), "o_totalprice", "o_orderpriority").select("o_orderkey", "o_totalprice")


@query("customer", sql="WITH g AS (SELECT c_custkey, CASE WHEN c_custkey % 30 <> 0 THEN c_mktsegment END AS s FROM customer) SELECT c_custkey, coalesce(s, (SELECT s FROM g WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)) AS c_mktsegment FROM g")
def mode_impute(t):
    return clean.impute_mode(gaps(t, "c_mktsegment", "c_custkey"), "c_mktsegment").select("c_custkey", "c_mktsegment")


@query("part", sql="SELECT p_partkey, CASE WHEN p_partkey % 30 <> 0 THEN p_name ELSE 'MISSING' END AS p_name FROM part")
def missing_placeholder(t):
    return clean.impute_placeholder(gaps(t, "p_name", "p_partkey"), "p_name").select("p_partkey", "p_name")


@query("customer", sql="SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def drop_sparse_columns(t):
    return clean.drop_sparse(t.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 100 == 0, F.col("c_mktsegment"))))


_Q = "(SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)"


@query("events", sql=rsql("q25 q75 lower upper", f"""SELECT 'value' AS "column", a AS q25, b AS q75, a - 1.5 * (b - a) AS lower, b + 1.5 * (b - a) AS upper FROM {_Q}""", "column"))
def iqr_bounds(t):
    return rounded(clean.iqr_bounds(t, ["value"]))


@query("events", sql=f"SELECT event_id, value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a) AS value_outlier_flag FROM events, {_Q}")
def iqr_outlier_flags(t):
    return clean.flag_outliers(t, ["value"]).select("event_id", "value_outlier_flag")


@query("events", sql=f"SELECT event_id, value FROM events, {_Q} WHERE NOT (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))")
def iqr_outlier_remove(t):
    return clean.remove_outliers(t, ["value"]).select("event_id", "value")


@query("orders", sql="WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders), f AS (SELECT o_orderkey, o_totalprice, o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a) AS o FROM orders, q) SELECT o_orderkey, o_totalprice FROM f WHERE NOT (o AND (SELECT avg(o::INT) FROM f) <= 0.01)")
def outlier_policy(t):
    return clean.outlier_policy(t, ["o_totalprice"]).select("o_orderkey", "o_totalprice")


@query("events", sql="SELECT count(*) FILTER (WHERE abs((value - m) / nullif(s, 0)) > 3) AS outliers, count(*) AS rows FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)")
def zscore_outliers(t):
    return clean.zscore_outliers(t, "value")


@query("events", sql=rsql("mad", "SELECT count(*) FILTER (WHERE abs(0.6745 * (value - m) / nullif(d, 0)) > 3.5) AS outliers, max(d) AS mad FROM events, (SELECT median(value) AS m, mad(value) AS d FROM events)", "outliers"))
def modified_zscore_outliers(t):
    return rounded(clean.modified_zscore_outliers(t, "value"))


@query("events", sql=rsql("mean_all mean_inside median_all median_inside std_all std_inside farthest", f"SELECT arg_max(value, abs(value - (SELECT median(value) FROM events))) FILTER (WHERE NOT i) AS farthest, avg(value) AS mean_all, avg(value) FILTER (WHERE i) AS mean_inside, median(value) AS median_all, median(value) FILTER (WHERE i) AS median_inside, stddev_samp(value) AS std_all, stddev_samp(value) FILTER (WHERE i) AS std_inside, count(*) FILTER (WHERE NOT i) AS outliers FROM (SELECT value, value >= a - 1.5 * (b - a) AND value <= b + 1.5 * (b - a) AS i FROM events, {_Q})", "outliers"))
def outlier_impact(t):
    return rounded(clean.outlier_impact(t, "value"))


@query("events", sql=rsql("share", f"SELECT count(*) FILTER (WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outliers, count(*) FILTER (WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) / count(*)::DOUBLE AS share FROM events, {_Q}", "outliers"))
def outlier_summary(t):
    return rounded(clean.outlier_summary(t, ["value"]))


_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)"
_O = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query("orders", sql=rsql("r3 r6 r12 lag1 diff pct", f"SELECT o_orderkey, avg(o_totalprice) {_W.format(k=2)} AS r3, avg(o_totalprice) {_W.format(k=5)} AS r6, avg(o_totalprice) {_W.format(k=11)} AS r12, lag(o_totalprice) {_O} AS lag1, o_totalprice - lag(o_totalprice) {_O} AS diff, (o_totalprice / nullif(lag(o_totalprice) {_O}, 0) - 1) * 100 AS pct FROM orders", "o_orderkey", 4))
def rolling_lag_change(t):
    x = features.trends(t, ["o_totalprice"], "o_orderdate", "o_orderkey", ["o_custkey"])
    names = {"o_totalprice_rolling_3": "r3", "o_totalprice_rolling_6": "r6", "o_totalprice_rolling_12": "r12", "o_totalprice_lag1": "lag1", "o_totalprice_diff": "diff", "o_totalprice_pct_change": "pct"}
    return rounded(x.select("o_orderkey", *[F.col(a).alias(b) for a, b in names.items()]), 4)


@query("part", sql='SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS "rank" FROM part')
def group_rank_avg(t):
    return clean.group_rank(t, "p_brand", "p_size").select("p_partkey", "rank")


@query("lineitem", sql=rsql("mean sum std", "SELECT l_orderkey, l_linenumber, avg(l_quantity) OVER w AS mean, sum(l_quantity) OVER w AS sum, stddev_samp(l_quantity) OVER w AS std, count(l_quantity) OVER w AS count FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)", "l_orderkey l_linenumber count", 4))
def group_stats_back_join(t):
    x = features.group_stats(t, "l_returnflag", ["l_quantity"])
    return rounded(x.select("l_orderkey", "l_linenumber", *[F.col(f"l_quantity_by_l_returnflag_{k}").alias(k) for k in ("mean", "sum", "std", "count")]), 4)


_M = "(SELECT date_trunc('month', o_orderdate)::DATE AS month, avg(o_totalprice) AS value FROM orders GROUP BY 1)"


@query("orders", sql=rsql("value", f"SELECT * FROM {_M}", "month", 4))
def monthly_mean(t):
    return rounded(stats.monthly(t, "o_orderdate", "o_totalprice"), 4)


@query("orders", sql=rsql("value", f"SELECT s.month, m.value FROM (SELECT unnest(generate_series(min(month)::TIMESTAMP, max(month)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month FROM (SELECT * FROM {_M} WHERE month(month) <> 6)) s LEFT JOIN (SELECT * FROM {_M} WHERE month(month) <> 6) m USING (month)", "month", 4))
def monthly_gap_filled(t):
    return rounded(stats.gap_filled(stats.monthly(t.where(F.month("o_orderdate") != 6), "o_orderdate", "o_totalprice")), 4)


@query("orders", sql=rsql("value growth volatility", f"SELECT month, value, 100 * (value / lag(value) OVER (ORDER BY month) - 1) AS growth, CASE WHEN count(value) OVER w = 3 THEN stddev_samp(value) OVER w END AS volatility FROM {_M} WINDOW w AS (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", "month", 4))
def monthly_growth_volatility(t):
    return rounded(stats.month_changes(stats.monthly(t, "o_orderdate", "o_totalprice")), 4)


@query("orders", sql=rsql("value", f"SELECT month(month)::BIGINT AS month_of_year, avg(value) AS value, count(*) AS n FROM {_M} GROUP BY 1", "month_of_year n", 4))
def month_of_year_pattern(t):
    return rounded(stats.seasonal_means(stats.monthly(t, "o_orderdate", "o_totalprice")), 4)


@query("orders", sql=rsql("r", union([str(k) for k in range(1, 13)], f"SELECT {{c}}::BIGINT AS lag, corr(value, b) AS r FROM (SELECT value, lag(value, {{c}}) OVER (ORDER BY month) AS b FROM {_M})"), "lag"))
def autocorrelation_lags(t):
    return rounded(stats.autocorrelation(stats.monthly(t, "o_orderdate", "o_totalprice"), "month", "value"))


@query("orders", sql=rsql("first last total_growth compound_growth", f'SELECT f AS "first", l AS "last", n, 100 * (l - f) / abs(f) AS total_growth, 100 * (pow(l / f, 1.0 / (n - 1)) - 1) AS compound_growth FROM (SELECT arg_min(value, month) AS f, arg_max(value, month) AS l, count(*) AS n FROM {_M})', "n", 4))
def growth_cagr(t):
    return rounded(stats.growth(stats.monthly(t, "o_orderdate", "o_totalprice"), "value", "month"), 4)


@query("orders", sql=rsql("slope intercept r2", "SELECT *, CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'flat' END AS direction, CASE WHEN r2 > 0.49 THEN 'strong' WHEN r2 > 0.09 THEN 'moderate' ELSE 'weak' END AS strength FROM (SELECT o_orderstatus, regr_slope(o_totalprice, d) AS slope, regr_intercept(o_totalprice, d) AS intercept, regr_r2(o_totalprice, d) AS r2, count(*) AS n FROM (SELECT *, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::DOUBLE AS d FROM orders) GROUP BY 1)", "o_orderstatus n direction strength", 4))
def linear_trend(t):
    x = t.withColumn("d", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("double"))
    return rounded(stats.linear_trend(x, "o_totalprice", "d", "o_orderstatus"), 4)


_PAIRS = [(a, b) for i, a in enumerate(KPI_COLUMNS) for b in KPI_COLUMNS[i + 1 :]]


@query("lineitem", sql=rsql("r", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a, b in _PAIRS), "a b"))
def pearson_pairs(t):
    return rounded(stats.pearson_pairs(t, KPI_COLUMNS))


_RANK = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query("part", sql=rsql("r", f"SELECT 'p_size' AS a, 'p_retailprice' AS b, corr(x::DOUBLE, y::DOUBLE) AS r FROM (SELECT {_RANK.replace('{c}', 'p_size')} AS x, {_RANK.replace('{c}', 'p_retailprice')} AS y FROM part)", "a b"))
def spearman_pairs(t):
    return rounded(stats.spearman_pairs(t, ["p_size", "p_retailprice"]))


@query("lineitem", sql=rsql("r", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a, b in _PAIRS) + ") CROSS JOIN (SELECT 'negligible' AS strength) WHERE abs(r) > 0.0001", "a b strength"))
def strong_pairs(t):
    return rounded(stats.strong_pairs(stats.pearson_pairs(t, KPI_COLUMNS), 0.0001))


_REGION = "(SELECT r_name, c_acctbal, c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"


def with_region(customer, nation, region):
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))


@query("customer", "nation", "region", sql=rsql("total mean median std", f"SELECT r_name, sum(c_acctbal) AS total, avg(c_acctbal) AS mean, median(c_acctbal) AS median, stddev_samp(c_acctbal) AS std, count(*) AS n FROM {_REGION} GROUP BY 1", "r_name n", 4))
def regional_comparison(c, n, r):
    return rounded(stats.regional(with_region(c, n, r), "r_name", "c_acctbal"), 4)


@query("customer", "nation", sql=rsql("total", "WITH s AS (SELECT n_name, sum(c_acctbal) AS total FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1) (SELECT n_name, total, 'top' AS side FROM s ORDER BY total DESC, n_name LIMIT 5) UNION ALL (SELECT n_name, total, 'bottom' AS side FROM s ORDER BY total, n_name LIMIT 5)", "n_name side", 4))
def regional_top_bottom(c, n):
    s = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.sum("c_acctbal").alias("total"))
    return rounded(stats.top_and_bottom(s, "n_name", "total"), 4)


@query("orders", sql=rsql("gini cv ratio", "SELECT g AS gini, cv, ratio, CASE WHEN g > 0.4 THEN 'high' WHEN g > 0.25 THEN 'medium' ELSE 'low' END AS level FROM (SELECT 2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*)::DOUBLE AS g, stddev_samp(x) / avg(x) AS cv, max(x) / min(x) AS ratio FROM (SELECT x, row_number() OVER (ORDER BY x) AS i FROM (SELECT sum(o_totalprice) AS x FROM orders GROUP BY o_custkey)))", "level"))
def gini_inequality(t):
    return rounded(stats.gini(t, "o_custkey", "o_totalprice"))


@query("lineitem", sql=rsql("score", "SELECT l_suppkey, ((avg(l_quantity) - (SELECT min(l_quantity) FROM lineitem)) / (SELECT max(l_quantity) - min(l_quantity) FROM lineitem) + (avg(l_extendedprice) - (SELECT min(l_extendedprice) FROM lineitem)) / (SELECT max(l_extendedprice) - min(l_extendedprice) FROM lineitem)) / 2 AS score FROM lineitem GROUP BY 1 ORDER BY score DESC, l_suppkey LIMIT 10", "l_suppkey"))
def top_performers(t):
    return rounded(stats.top_performers(t, "l_suppkey", ["l_quantity", "l_extendedprice"]))


@query("orders", sql="SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def contingency_table(t):
    return stats.contingency(t, "o_orderstatus", "o_orderpriority")


@query("orders", sql=rsql("chi2 df cramers_v", "WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL), e AS (SELECT x.ra * y.rb / t::DOUBLE AS e, coalesce(n, 0) AS n, t FROM (SELECT a, sum(n) AS ra FROM c GROUP BY a) x CROSS JOIN (SELECT b, sum(n) AS rb FROM c GROUP BY b) y LEFT JOIN c USING (a, b) CROSS JOIN (SELECT sum(n) AS t FROM c)) SELECT chi2, d AS df, sqrt(chi2 / (t * m)) AS cramers_v FROM (SELECT sum((n - e) * (n - e) / e) AS chi2, max(t) AS t FROM e), (SELECT ((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1))::DOUBLE AS d, least(count(DISTINCT a), count(DISTINCT b)) - 1 AS m FROM c)"))
def chi_square_independence(t):
    return rounded(stats.chi_square(t, "o_orderstatus", "o_orderpriority"))


_G = "(SELECT {g} AS g, count(*)::DOUBLE AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1)"


@query("lineitem", sql=rsql("t df effect_size", f"SELECT (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) AS t, a.n + b.n - 2 AS df, abs(a.m - b.m) / sqrt((a.v + b.v) / 2) AS effect_size FROM {_G.format(g='l_linestatus')} a JOIN {_G.format(g='l_linestatus')} b ON a.g < b.g"))
def t_test_effect(t):
    return rounded(stats.t_test(t, "l_quantity", "l_linestatus"))


@query("lineitem", sql=rsql("f df_between df_within", f"SELECT (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) AS f, (count(*) - 1)::DOUBLE AS df_between, sum(n) - count(*) AS df_within FROM {_G.format(g='l_returnflag')}, (SELECT avg(l_quantity) AS gm FROM lineitem)", places=4))
def anova_f(t):
    return rounded(stats.anova(t, "l_quantity", "l_returnflag"), 4)


_R = f"(SELECT {{g}} AS g, {_RANK.replace('{c}', 'l_quantity')} AS r, count(*) OVER (PARTITION BY l_quantity)::DOUBLE AS t FROM lineitem)"
_TIES = "(SELECT sum(t * t - 1) AS ties, count(*)::DOUBLE AS n FROM {r})"


@query("lineitem", sql=rsql("h df", f"SELECT (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h, (k - 1)::DOUBLE AS df FROM (SELECT sum(s * s / c) AS q, count(*) AS k FROM (SELECT g, sum(r::DOUBLE) AS s, count(*) AS c FROM {_R.format(g='l_returnflag')} GROUP BY g)), {_TIES.format(r=_R.format(g='l_returnflag'))}", places=4))
def kruskal_h(t):
    return rounded(stats.kruskal(t, "l_quantity", "l_returnflag"), 4)


@query("lineitem", sql=rsql("u z", f"SELECT u, greatest(0, abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM (SELECT sum(r::DOUBLE) FILTER (WHERE g = 'F') - count(*) FILTER (WHERE g = 'F')::DOUBLE * (count(*) FILTER (WHERE g = 'F') + 1) / 2 AS u, count(*) FILTER (WHERE g = 'F')::DOUBLE AS n1, count(*) FILTER (WHERE g <> 'F')::DOUBLE AS n2 FROM {_R.format(g='l_linestatus')}), {_TIES.format(r=_R.format(g='l_linestatus'))}", places=4))
def mann_whitney_u(t):
    return rounded(stats.mann_whitney(t, "l_quantity", "l_linestatus"), 4)


@query("events", sql=rsql("jb p", "SELECT jb, exp(-jb / 2) AS p FROM (SELECT n / 6 * (s * s + k * k / 4) AS jb FROM (SELECT count(value) AS n, skewness(value) * (count(value) - 2) / sqrt(count(value)::DOUBLE * (count(value) - 1)) AS s, kurtosis_pop(value) AS k FROM events))", places=4))
def jarque_bera(t):
    return rounded(stats.jarque_bera(t, "value"), 4)


@query("events", sql=rsql("d", "SELECT max(greatest(hi / t - f, f - lo / t)) AS d FROM (SELECT 1 - exp(-value / m) AS f, rank() OVER (ORDER BY value) - 1 AS lo, count(*) OVER (ORDER BY value) AS hi, t FROM events, (SELECT avg(value) AS m, count(*)::DOUBLE AS t FROM events))"))
def ks_exponential(t):
    return rounded(stats.ks_exponential(t, "value").select("d"))


# The normal distribution function as a series of positive terms; k-th odd factorials by lgamma.
PHI = "(0.5 + sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)))))"
KS_NORMAL = f"SELECT max(greatest(hi / t - f, f - lo / t)) AS d, max(t) AS n FROM (SELECT lo, hi, t, {PHI.format(z='z')} AS f FROM (SELECT (value - m) / s AS z, rank() OVER (ORDER BY value) - 1 AS lo, count(*) OVER (ORDER BY value) AS hi, t FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s, count(*)::DOUBLE AS t FROM events)))"


@query("events", sql=rsql("d", KS_NORMAL))
def ks_normal(t):
    return rounded(stats.ks_normal(t, "value").select("d"))


@query("events", sql=rsql("mean median std variance skewness kurtosis range iqr", "SELECT *, CASE WHEN abs(skewness) < 0.5 THEN 'symmetric' WHEN abs(skewness) < 1 THEN 'moderate' ELSE 'high' END AS skew_label, CASE WHEN skewness > 0 THEN 'right' ELSE 'left' END AS skew_direction FROM (SELECT avg(value) AS mean, median(value) AS median, stddev_samp(value) AS std, var_samp(value) AS variance, skewness(value) AS skewness, kurtosis(value) AS kurtosis, max(value) - min(value) AS range, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events)", "skew_label skew_direction", 4))
def distribution_params(t):
    return rounded(stats.distribution(t, "value"), 4)


@query("events", sql=rsql("density", "SELECT least(30, floor((value - a) / ((b - a) / 30))::BIGINT + 1) AS bin, count(*) AS n, count(*) / (max(t) * (max(b) - max(a)) / 30) AS density FROM events, (SELECT min(value) AS a, max(value) AS b, count(value) AS t FROM events) GROUP BY 1", "bin n"))
def histogram_30(t):
    return rounded(profile.histogram(t, "value"))


@query("events", sql=rsql("at density", "WITH b AS (SELECT min(value) AS a, max(value) AS z, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h FROM events), v AS (SELECT value AS x, count(*) AS w FROM events GROUP BY 1), g AS (SELECT unnest(range(0, 100))::INT AS point) SELECT point, a + point * (z - a) / 99 AS at, sum(w * exp(-0.5 * pow((a + point * (z - a) / 99 - x) / h, 2))) / max(n * h * sqrt(2 * pi())) AS density FROM v, b, g GROUP BY ALL", "point"))
def kernel_density(t):
    return rounded(profile.kde(t, "value"))


@query("lineitem", sql="SELECT class, sum(n)::BIGINT AS n FROM (" + union(KPI_COLUMNS, "SELECT CASE WHEN {c} <= a THEN 'Low' WHEN {c} > b THEN 'High' ELSE 'Medium' END AS class, count(*) AS n FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM lineitem) GROUP BY 1") + ") GROUP BY 1")
def quartile_classes(t):
    return profile.quartile_classes(t, KPI_COLUMNS)


@query("orders", sql="WITH x AS (SELECT (CASE WHEN o_orderkey % 30 = 0 THEN 1 ELSE 0 END) + (CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) AS k FROM orders) SELECT greatest(1, ceil((k - a) / ((b - a) / 5.0)))::BIGINT AS bin, count(*)::BIGINT AS n FROM x, (SELECT min(k) AS a, max(k) AS b FROM x) GROUP BY 1")
def row_quality_bins(t):
    return profile.row_quality_bins(gaps(gaps(t, "o_totalprice", "o_orderkey"), "o_orderstatus", "o_orderkey", 7), ["o_totalprice", "o_orderstatus"])


@query("orders", sql="SELECT o_orderkey, year(o_orderdate)::BIGINT AS year, month(o_orderdate)::BIGINT AS month, quarter(o_orderdate)::BIGINT AS quarter, day(o_orderdate)::BIGINT AS day, (isodow(o_orderdate) - 1)::BIGINT AS dayofweek, dayofyear(o_orderdate)::BIGINT AS dayofyear, week(o_orderdate)::BIGINT AS weekofyear, (isodow(o_orderdate) >= 6)::BIGINT AS is_weekend, (day(o_orderdate) = 1)::BIGINT AS is_month_start, (last_day(o_orderdate::DATE) = o_orderdate::DATE)::BIGINT AS is_month_end, (date_trunc('quarter', o_orderdate)::DATE = o_orderdate::DATE)::BIGINT AS is_quarter_start, (last_day(o_orderdate::DATE) = o_orderdate::DATE AND month(o_orderdate) % 3 = 0)::BIGINT AS is_quarter_end FROM orders")
def datetime_features(t):
    x = features.calendar(t.select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")
    return x.toDF(*[c.replace("o_orderdate_", "") for c in x.columns])


@query("lineitem", sql=rsql("per_quantity ratio pct", "SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) AS per_quantity, l_discount / nullif(l_tax, 0) AS ratio, 100 * l_discount / nullif(l_discount + l_tax, 0) AS pct FROM lineitem", "l_orderkey l_linenumber"))
def ratio_features(t):
    x = features.ratio_pairs(features.per_unit(t, ["l_extendedprice"], "l_quantity"), [("l_discount", "l_tax")])
    return rounded(x.select("l_orderkey", "l_linenumber", F.col("l_extendedprice_per_l_quantity").alias("per_quantity"), F.col("l_discount_l_tax_ratio").alias("ratio"), F.col("l_discount_pct_of_total").alias("pct")))


@query("lineitem", sql=rsql("l_quantity_l_extendedprice_ratio l_quantity_l_discount_ratio l_extendedprice_l_discount_ratio", "SELECT l_orderkey, l_linenumber, l_quantity / nullif(l_extendedprice, 0) AS l_quantity_l_extendedprice_ratio, l_quantity / nullif(l_discount, 0) AS l_quantity_l_discount_ratio, l_extendedprice / nullif(l_discount, 0) AS l_extendedprice_l_discount_ratio FROM lineitem", "l_orderkey l_linenumber"))
def interaction_ratios(t):
    return rounded(features.interactions(t.select("l_orderkey", "l_linenumber", *KPI_COLUMNS[:3]), KPI_COLUMNS[:3]).drop(*KPI_COLUMNS[:3]))


@query("lineitem", sql="SELECT l_orderkey, l_linenumber, (l_linestatus <> (SELECT l_linestatus FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1))::BIGINT AS l_linestatus_encoded FROM lineitem")
def binary_encode(t):
    x = t.withColumn("_o", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return features.binary_encode(x, "l_linestatus", "_o").select("l_orderkey", "l_linenumber", "l_linestatus_encoded")


@query("orders", sql="SELECT o_orderkey, (o_orderstatus = 'F')::BIGINT AS f, (o_orderstatus = 'O')::BIGINT AS o, (o_orderstatus = 'P')::BIGINT AS p, 0::BIGINT AS n FROM orders")
def one_hot(t):
    return features.one_hot(t.select("o_orderkey", "o_orderstatus"), "o_orderstatus").select("o_orderkey", *[F.col(f"o_orderstatus_{a}").alias(b) for a, b in zip(["F", "O", "P", "nan"], "fopn", strict=True)])


@query("part", sql="SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand) - 1)::BIGINT AS p_brand_encoded FROM part")
def label_encode(t):
    return features.label_encode(t, "p_brand").select("p_partkey", "p_brand_encoded")


@query("orders", sql=rsql("o_totalprice_std o_totalprice_norm", "SELECT o_orderkey, (o_totalprice - m) / s AS o_totalprice_std, (o_totalprice - a) / (b - a) AS o_totalprice_norm FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s, min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders)", "o_orderkey"))
def scaled_columns(t):
    return rounded(features.scaled(t, ["o_totalprice"]).select("o_orderkey", "o_totalprice_std", "o_totalprice_norm"))


@query("events", sql=rsql("value_log", "SELECT event_id, ln(1 + value) AS value_log FROM events", "event_id"))
def log1p_skew(t):
    return rounded(features.log_skewed(t, ["value"], 0.0).select("event_id", "value_log"))


@query("part", sql="SELECT p_partkey, p_retailprice AS currency, p_size / 100.0::DOUBLE AS percent, 'a b' AS text, CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'False' END AS flag, make_timestamp(1990 + p_size % 20, 1 + p_size % 12, 1 + p_size % 28, 0, 0, 0) AS day FROM part")
def standardized_text(t):
    size = F.col("p_size")
    day = F.format_string("%d-%d-%d", 1990 + size % 20, 1 + size % 12, 1 + size % 28)
    return t.select("p_partkey", S.strip_currency(F.concat(F.lit("$ "), F.col("p_retailprice").cast("string"))).alias("currency"), S.strip_percent(F.concat(size.cast("string"), F.lit(" %"))).alias("percent"), S.collapse_blanks(F.lit("  a \t b ")).alias("text"), S.boolean_text(F.when(size % 2 == 0, " YES").otherwise("off")).alias("flag"), S.parse_time(day).alias("day"))


@query("documents", sql=r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\b\d{4}[ -]?\d{4}[ -]?\d{4}\b', '[ID]', 'g'), '\+?\d[\d ()-]{8,14}\d', '[PHONE]', 'g')) AS text_sha256 FROM documents")
def pii_redact(t):
    return t.select("doc_id", F.sha2(S.redact_pii(F.col("text")), 256).alias("text_sha256"))


_FORMATS = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y-%m-%d %H:%M:%S", "%d-%m-%Y", "%Y/%m/%d", "%d.%m.%Y", "%Y", "%m/%Y", "%d-%b-%Y", "%d %B %Y", "%B %d, %Y"]
_ISO = S.ISO_TIME
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_DETECT = (
    "SELECT '{c}' AS \"column\", n, distinct_share, numeric, CASE WHEN numeric >= 0.8 THEN whole ELSE 0 END AS integer, CASE WHEN numeric >= 0.8 THEN numeric - whole ELSE 0 END AS float, datetime, boolean, "
    "CASE WHEN distinct_share < 0.1 AND d > 1 THEN 1 - distinct_share ELSE 0 END AS categorical, CASE WHEN numeric > 0.8 AND wide / numeric > 0.8 THEN 0.9 ELSE least(0.8, 0.3 * places) END AS geographic, "
    "CASE WHEN distinct_share >= 0.95 THEN distinct_share * ids ELSE 0 END AS id, currency, 0.3 AS text FROM (SELECT count(*) AS n, count(DISTINCT s) AS d, count(DISTINCT s) / count(*)::DOUBLE AS distinct_share, count(v) / count(*)::DOUBLE AS numeric, "
    "count(*) FILTER (v = floor(v)) / count(*)::DOUBLE AS whole, count(*) FILTER (abs(v) <= 180) / count(*)::DOUBLE AS wide, "
    f"greatest({', '.join(f"count(*) FILTER (try_strptime(CASE WHEN '{f}' <> '%Y' OR regexp_matches(s, '^[0-9]{{4}}$') THEN s END, '{f}') IS NOT NULL)" for f in _FORMATS)}, count(*) FILTER (regexp_matches(s, '{_ISO}') AND try_cast(s AS TIMESTAMP) IS NOT NULL)) / count(*)::DOUBLE AS datetime, "
    f"greatest({', '.join(f"coalesce(bool_and(low IN ('{a}', '{b}')) FILTER (low NOT IN ('nan', 'none', '')), false)::INT" for a, b in detect.BOOLEAN_SETS)})::DOUBLE AS boolean, "
    f"{' + '.join(f"max(contains(low, '{p}')::INT)" for p in detect.PLACES)} AS places, "
    f"greatest({', '.join(f"count(*) FILTER (regexp_matches(s, '{p}'))" for p in detect.ID_PATTERNS)}) / count(*)::DOUBLE AS ids, "
    f"greatest({', '.join(f"count(*) FILTER (regexp_matches(s, '{p}', 'i'))" for p in detect.CURRENCY_MARKS)}, count(*) FILTER (regexp_matches(regexp_replace(s, '[₹$,\\s]', '', 'g'), '{_NUMBER}'))) / count(*)::DOUBLE AS currency "
    f"FROM (SELECT s, lower(trim(s)) AS low, CASE WHEN regexp_matches(trim(s), '{_NUMBER}') THEN try_cast(trim(s) AS DOUBLE) END AS v FROM (SELECT {{c}}::VARCHAR AS s FROM {{t}}) WHERE s IS NOT NULL))"
)
_TYPED = {"documents": ["doc_id", "lang", "source", "n_chars"], "orders": ["o_orderstatus", "o_orderdate", "o_totalprice"]}
_SCORES = ", ".join(f'round("{k}"::DOUBLE, 6) AS "{k}"' for k in ["distinct_share", *detect.TYPES])
_DETECTED = " UNION ALL ".join(_DETECT.replace("{c}", c).replace("{t}", t) for t, cs in _TYPED.items() for c in cs)
_BEST = f"greatest({', '.join(detect.TYPES)})"


@query("documents", "orders", sql=f"""SELECT "column", n, {_SCORES}, round({_BEST}::DOUBLE, 6) AS confidence, CASE WHEN {_BEST} < 0.6 THEN 'text' {' '.join(f"WHEN {k} = {_BEST} THEN '{k}'" for k in detect.TYPES)} END AS type FROM ({_DETECTED})""")
def type_detection_scores(d, o):
    a = detect.type_scores(d, _TYPED["documents"])
    return rounded(a.unionByName(detect.type_scores(o, _TYPED["orders"])))



@query("customer", sql="SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) WHERE i % (SELECT count(*) // 100 FROM customer) = 0")
def systematic_sample(t):
    return detect.systematic_sample(t, "c_custkey", 100).select("c_custkey")


@query("customer", sql="SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer) WHERE i < 30 OR (i >= n // 2 - 15 AND i < n // 2 + 15) OR i >= n - 30")
def positional_sample(t):
    return detect.positional_sample(t, "c_custkey", 90).select("c_custkey")


@query("customer", sql="SELECT c_mktsegment, least(100, count(*))::BIGINT AS n FROM customer GROUP BY 1")
def stratified_sample_counts(t):
    return detect.stratified_sample(t, "c_mktsegment", "c_custkey", 500).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("orders", sql=f"SELECT 'sufficient_data' AS gate, count(*) >= 100 AS passed, 'critical' AS severity, count(*)::DOUBLE AS value FROM orders UNION ALL SELECT 'key_columns_present', true, 'critical', 1.0 UNION ALL SELECT 'high_missingness', 1 - count(o_totalprice) / count(*)::DOUBLE <= 0.5, 'warning', (count(*) - count(o_totalprice)) / count(*)::DOUBLE FROM {ORDERS_GAPS} UNION ALL SELECT 'reasonable_duplicates', true, 'warning', 0.0")
def validation_gates(t):
    return quality.gates(gaps(t, "o_totalprice", "o_orderkey"))


@query("part", sql=union(["p_brand", "p_size", "p_partkey"], """SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_values, count(DISTINCT {c}) <= 1 AS constant, count(DISTINCT {c}) > 100 AND count(DISTINCT {c}) > 0.8 * count({c}) AS high_cardinality FROM part"""))
def constant_and_cardinality_flags(t):
    return profile.column_flags(t, ["p_brand", "p_size", "p_partkey"])


@query("lineitem", sql=rsql("importance", union(KPI_COLUMNS, """SELECT '{c}' AS "column", var_samp({c}) AS importance FROM lineitem"""), "column", 4))
def feature_importance(t):
    return rounded(profile.feature_importance(t, KPI_COLUMNS), 4)


@query("lineitem", sql=union(KPI_COLUMNS, """SELECT '{c}' AS "column", 0::BIGINT AS infinite, count(*) FILTER (WHERE abs({c}) > 1e10) AS huge FROM lineitem"""))
def extreme_values(t):
    return profile.extreme_values(t, KPI_COLUMNS)


@query("orders", "events", sql="SELECT o_orderpriority, count(*)::BIGINT AS pairs FROM (SELECT o_orderpriority, o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY ALL) o, (SELECT ts::DATE - 30 AS e FROM events) e, range(1) WHERE false GROUP BY 1 UNION ALL SELECT * FROM (SELECT o_orderpriority, sum(n * r)::BIGINT AS pairs FROM (SELECT o_orderpriority, o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY ALL) o JOIN (SELECT CAST(ts AS DATE) - 9000 AS e, count(*) AS r FROM events GROUP BY 1) e ON d >= e GROUP BY 1 ORDER BY pairs DESC, 1 LIMIT 10)")
def rule_theta_join(o, e):
    return memory.rules_in_reach(o, e, "o_orderdate", "ts", "o_orderpriority", 9000)


@query("customer", sql="SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey FROM customer c WHERE c_custkey % 2 = 0 AND NOT EXISTS (SELECT 1 FROM customer d WHERE d.c_custkey = c.c_custkey AND d.c_custkey % 3 = 0)")
def anti_dedupe_union(t):
    k = t.select("c_custkey")
    return memory.anti_union(k.where("c_custkey % 3 = 0"), k.where("c_custkey % 2 = 0"), "c_custkey")


@query("lineitem", sql=rsql("confidence", "SELECT l_returnflag, l_suppkey, votes, confidence FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY votes DESC, confidence DESC, l_suppkey) AS r FROM (SELECT l_returnflag, l_suppkey, sum(l_quantity) AS votes, avg(l_discount) AS confidence FROM lineitem GROUP BY ALL)) WHERE r = 1", "l_returnflag l_suppkey votes"))
def mapping_vote(t):
    return rounded(memory.vote(t, "l_returnflag", "l_suppkey", "l_quantity", "l_discount"))


@query("orders", sql="SELECT o_custkey, count(*)::BIGINT AS usage_count FROM orders GROUP BY 1")
def counter_upsert(t):
    x = t.groupBy("o_custkey", (F.col("o_orderkey") % 2).alias("h")).agg(F.count("*").alias("usage_count"))
    return memory.count_up(x.where("h = 0"), x.where("h = 1"), ["o_custkey"])


@query("part", sql="SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 5")
def top_k_with_ties(t):
    return t.groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(5)


@query("events", sql="SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def flatten_json_props(t):
    from ..sources.load import flatten

    return flatten(t.select("event_id", F.from_json("props", "k bigint").alias("props"))).withColumnRenamed("props.k", "k")


@query("orders", sql="SELECT o_orderkey, ntile(10) OVER (ORDER BY o_totalprice, o_orderkey)::BIGINT AS bucket FROM orders")
def quantile_buckets(t):
    n = t.count()
    i = F.col("_row_id")
    big, small = n % 10, n // 10  # the first big buckets hold one row more
    x = detect.numbered(t, "o_totalprice", "o_orderkey")
    return x.select("o_orderkey", F.when(i < big * (small + 1), F.floor(i / (small + 1)) + 1).otherwise(big + F.floor((i - big * (small + 1)) / max(1, small)) + 1).cast("long").alias("bucket"))
