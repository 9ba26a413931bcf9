"""Analytical questions (QRY) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import query as q
from .registry import query, rounded, sql_rounded

SEGMENTS = """
SELECT l_returnflag AS segment, count(l_extendedprice) AS n, avg(l_extendedprice) AS mean,
       coalesce(stddev_samp(l_extendedprice), 0.0) AS std, quantile_cont(l_extendedprice, 0.5) AS median,
       quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.75) AS q75
FROM lineitem WHERE l_returnflag IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY l_returnflag
"""


@query("qry_01_segment_comparison", sql_rounded(f"""
SELECT *, std / sqrt(n) AS sem, q75 - q25 AS iqr, mean - 1.96 * std / sqrt(n) AS ci95_lower,
       mean + 1.96 * std / sqrt(n) AS ci95_upper FROM ({SEGMENTS})""",
    "segment n", 4, "mean std median q25 q75 sem iqr ci95_lower ci95_upper"))
def segment_comparison(t):
    return rounded(q.segment_comparison(t.lineitem, "l_returnflag", "l_extendedprice"), 4)


@query("qry_01_segment_comparison_many_segments", sql_rounded("""
SELECT l_suppkey AS segment, count(l_quantity) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std,
       quantile_cont(l_quantity, 0.5) AS median, quantile_cont(l_quantity, 0.25) AS q25,
       quantile_cont(l_quantity, 0.75) AS q75
FROM lineitem GROUP BY l_suppkey""", "segment n", 4, "mean std median q25 q75"))
def segment_comparison_many(t):
    out = q.segment_comparison(t.lineitem, "l_suppkey", "l_quantity")
    return rounded(out.select("segment", "n", "mean", "std", "median", "q25", "q75"), 4)


MOMENTS = """
SELECT {g} AS g, count({m}) AS n, avg({m}) AS mu, var_samp({m}) AS v FROM lineitem
WHERE {g} IS NOT NULL AND {m} IS NOT NULL GROUP BY {g} HAVING count({m}) >= 2
"""


@query("qry_02_welch_test", sql_rounded(f"""
WITH m AS ({MOMENTS.format(g='l_linestatus', m='l_extendedprice')}),
p AS (SELECT arg_min(g, g) AS segment_a, arg_max(g, g) AS segment_b, arg_min(n, g) AS na, arg_max(n, g) AS nb,
             arg_min(mu, g) AS ma, arg_max(mu, g) AS mb, arg_min(v, g) AS va, arg_max(v, g) AS vb,
             count(*) AS k FROM m)
SELECT segment_a, segment_b, (ma - mb) / sqrt(va / na + vb / nb) AS t,
       pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS dof,
       abs(ma - mb) / sqrt((va + vb) / 2.0 + 1e-12) AS cohen_d
FROM p WHERE k = 2""", "segment_a segment_b", 6, "t dof cohen_d", dof=3))
def welch_test(t):
    return rounded(q.welch_test(t.lineitem, "l_linestatus", "l_extendedprice").drop("p_value"), 6, dof=3)


@query("qry_03_anova", sql_rounded(f"""
WITH m AS ({MOMENTS.format(g='l_returnflag', m='l_quantity')}),
c AS (SELECT sum(n * mu) / sum(n) AS gm FROM m),
s AS (SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, sum(n * pow(mu - gm, 2)) AS ss_between,
             sum((n - 1) * v) AS ss_within FROM m, c)
SELECT groups, rows, ss_between, ss_within, CAST(groups - 1 AS DOUBLE) AS dof_between,
       CAST(rows - groups AS DOUBLE) AS dof_within,
       (ss_between / (groups - 1)) / (ss_within / (rows - groups)) AS f FROM s WHERE groups >= 3""",
    "groups rows", 5, "ss_between ss_within dof_between dof_within f", ss_within=1, ss_between=3))
def anova(t):
    return rounded(q.anova(t.lineitem, "l_returnflag", "l_quantity").drop("p_value"), 5, ss_within=1, ss_between=3)


G1_TO_POP = "skewness({c}) * (count({c}) - 2) / sqrt(CAST(count({c}) AS DOUBLE) * (count({c}) - 1))"
FENCES = f"""
SELECT count(o_totalprice) AS rows, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std,
       {G1_TO_POP.format(c='o_totalprice')} AS skewness, quantile_cont(o_totalprice, 0.25) AS q25,
       quantile_cont(o_totalprice, 0.75) AS q75 FROM orders
"""


@query("qry_04_outlier_summary", sql_rounded(f"""
WITH f AS ({FENCES})
SELECT 'o_totalprice' AS column_name, any_value(rows) AS rows, any_value(mean) AS mean, any_value(std) AS std,
       any_value(skewness) AS skewness, any_value(q25) AS q25, any_value(q75) AS q75, any_value(q75 - q25) AS iqr,
       count(*) FILTER (o_totalprice < q25 - 1.5 * (q75 - q25) OR o_totalprice > q75 + 1.5 * (q75 - q25)) AS n_outliers,
       count(*) FILTER (o_totalprice < q25 - 3 * (q75 - q25) OR o_totalprice > q75 + 3 * (q75 - q25)) AS n_extreme,
       count(*) FILTER (abs((o_totalprice - mean) / std) > 3) AS n_z_over_3,
       any_value(q25 - 1.5 * (q75 - q25)) AS lower_fence, any_value(q75 + 1.5 * (q75 - q25)) AS upper_fence,
       100.0 * count(*) FILTER (o_totalprice < q25 - 1.5 * (q75 - q25) OR o_totalprice > q75 + 1.5 * (q75 - q25))
         / any_value(rows) AS outlier_pct
FROM orders, f""", "column_name rows n_outliers n_extreme n_z_over_3", 4,
    "mean std skewness q25 q75 iqr lower_fence upper_fence outlier_pct"))
def outlier_summary(t):
    return rounded(q.outlier_summary(t.orders, "o_totalprice").withColumnRenamed("column", "column_name"), 4)


@query("qry_04_outlier_rows", sql_rounded("""
WITH d AS (SELECT event_id, value FROM events WHERE value IS NOT NULL),
s AS (SELECT avg(value) AS mu, stddev_samp(value) AS sd, quantile_cont(value, .25) AS a, quantile_cont(value, .75) AS b
      FROM d)
SELECT event_id, value, (value - mu) / sd AS z_score FROM d, s
WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)
ORDER BY abs((value - mu) / sd) DESC, event_id LIMIT 10""", "event_id", 6, "value z_score"))
def outlier_rows(t):
    return rounded(q.outlier_rows(t.events, "value", ["event_id"]), 6)


CONTRIB = """
WITH s AS (SELECT {d} AS segment, sum({m}) AS total FROM {t} WHERE {d} IS NOT NULL AND {m} IS NOT NULL GROUP BY {d}),
r AS (SELECT segment, total, 100.0 * total / (sum(total) OVER () + 1e-12) AS share_pct,
             row_number() OVER (ORDER BY total {o}, segment) AS rank FROM s)
SELECT CAST(rank AS INTEGER) AS rank, segment, total, share_pct, sum(share_pct) OVER (ORDER BY rank) AS cumulative_pct
FROM r QUALIFY rank <= {k}
"""


@query("qry_05_top_contributors", sql_rounded(
    CONTRIB.format(d="l_suppkey", m="l_extendedprice", t="lineitem", o="DESC", k=5),
    "rank segment", 5, "total share_pct cumulative_pct", total=2))
def top_contributors(t):
    return rounded(q.contributors(t.lineitem, "l_suppkey", "l_extendedprice", 5), 5, total=2)


@query("qry_05_bottom_contributors", sql_rounded(
    CONTRIB.format(d="o_custkey", m="o_totalprice", t="orders", o="ASC", k=7),
    "rank segment", 5, "total share_pct cumulative_pct", total=2))
def bottom_contributors(t):
    return rounded(q.contributors(t.orders, "o_custkey", "o_totalprice", 7, ascending=True), 5, total=2)


@query("qry_06_bivariate", sql_rounded("""
WITH p AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL
           AND l_extendedprice IS NOT NULL),
k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
             rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p)
SELECT count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman,
       tanh(atanh(corr(x, y)) - 1.96 / sqrt(count(*) - 3)) AS ci_lower,
       tanh(atanh(corr(x, y)) + 1.96 / sqrt(count(*) - 3)) AS ci_upper,
       regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, pow(corr(x, y), 2) AS r2 FROM k""",
    "n", 7, "pearson spearman ci_lower ci_upper slope intercept r2", slope=4, intercept=3))
def bivariate(t):
    out = q.bivariate(t.lineitem, "l_quantity", "l_extendedprice").drop("pearson_p", "spearman_p")
    return rounded(out, 7, slope=4, intercept=3)


NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("qry_07_correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
    + ("1.0" if a == b else f"round(corr({a}, {b}), 8) + 0.0") + "::DOUBLE AS r FROM "
    + ("(SELECT 1)" if a == b else "lineitem") for a in NUM for b in NUM))
def correlation_matrix(t):
    return rounded(q.correlation_matrix(t.lineitem, NUM), 8)


DIST = """
SELECT '{c}' AS column_name, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std,
       stddev_samp({c}) / sqrt(count({c})) AS sem, min({c}) AS min, quantile_cont({c}, .25) AS q25,
       quantile_cont({c}, .5) AS median, quantile_cont({c}, .75) AS q75, max({c}) AS max, {g1} AS skewness,
       kurtosis_pop({c}) AS kurtosis, quantile_cont({c}, .75) - quantile_cont({c}, .25) AS iqr,
       avg({c}) - 1.96 * stddev_samp({c}) / sqrt(count({c})) AS ci95_lower,
       avg({c}) + 1.96 * stddev_samp({c}) / sqrt(count({c})) AS ci95_upper FROM {t}
"""


@query("qry_08_numeric_distribution", sql_rounded(
    DIST.format(c="o_totalprice", t="orders", g1=G1_TO_POP.format(c="o_totalprice")), "column_name n", 4,
    "mean std sem min q25 median q75 max skewness kurtosis iqr ci95_lower ci95_upper"))
def numeric_distribution(t):
    out = q.numeric_distribution(t.orders, "o_totalprice").withColumnRenamed("column", "column_name")
    return rounded(out.drop("normality_k2", "normality_p"), 4)


@query("qry_09_categorical_distribution", sql_rounded("""
SELECT c_mktsegment AS value, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM customer
WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment ORDER BY n DESC, value LIMIT 10""", "value n", 6, "pct"))
def categorical_distribution(t):
    return rounded(q.categorical_distribution(t.customer, "c_mktsegment"))


@query("qry_10_snapshot", """
SELECT count(*) AS rows, CAST(6 AS INTEGER) AS columns,
       count(*) * 6 - count(event_id) - count(ts) - count(user_id) - count(event_type) - count(value) - count(props)
         AS missing_cells FROM events""")
def snapshot(t):
    return q.snapshot(t.events)


@query("qry_12_describe_column", """
WITH c AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT 'mode' AS statistic, (SELECT v FROM c ORDER BY n DESC, v LIMIT 1) AS value
UNION ALL SELECT 'n', CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) FROM c
UNION ALL SELECT 'distinct', CAST(count(*) AS VARCHAR) FROM c""")
def describe_column(t):
    return q.describe_column(t.orders, "o_orderpriority", protected=["o_clerk"])


@query("qry_13_value_counts", """
SELECT event_type AS value, count(*) AS n FROM events WHERE event_type IS NOT NULL
GROUP BY 1 ORDER BY n DESC, value LIMIT 3""")
def value_counts(t):
    return q.value_counts(t.events, "event_type", 3)


def _groupby_sql() -> str:
    parts = []
    for agg in ("mean", "median", "sum", "min", "max", "count"):
        fn = {"mean": "avg"}.get(agg, agg)
        parts.append(
            f"SELECT '{agg}' AS agg, segment, round(CAST(v AS DOUBLE), 2) AS value FROM (SELECT p_brand AS segment, "
            f"{fn}(p_retailprice) AS v FROM part WHERE p_brand IS NOT NULL GROUP BY 1 "
            f"ORDER BY v DESC NULLS LAST, segment LIMIT 10)"
        )
    return " UNION ALL ".join(parts)


@query("qry_14_groupby_agg", _groupby_sql())
def groupby_agg(t):
    out = None
    for agg in q.AGGREGATES:
        part = q.groupby_agg(t.part, "p_brand", "p_retailprice", agg).select(F.lit(agg).alias("agg"), "segment", "value")
        out = part if out is None else out.unionByName(part)
    return rounded(out, 2)


@query("qry_15_correlation", """
SELECT 'p_size' AS column_a, 'p_retailprice' AS column_b, round(corr(p_size, p_retailprice), 8) + 0.0 AS r,
       count(*) AS n FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL""")
def correlation(t):
    return rounded(q.correlation_of(t.part, "p_size", "p_retailprice"), 8)


@query("qry_16_row_count", "SELECT count(*) AS rows FROM lineitem")
def row_count(t):
    return q.row_count(t.lineitem)


@query("qry_16_null_count", "SELECT 'c_name' AS column_name, count(*) - count(c_name) AS nulls FROM customer")
def null_count(t):
    return q.null_count(t.customer, "c_name").withColumnRenamed("column", "column_name")
