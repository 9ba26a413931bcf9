"""Insights (INS) and feature engineering (FE) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as fe, insight
from .registry import query, rounded, sql_rounded

X = ["l_quantity", "l_discount", "l_extendedprice"]


def shaped(t):
    """Line items with a linear, a curved and a stepped outcome."""
    q, k = F.col("l_quantity"), F.col("l_partkey")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", *X, "l_returnflag", "l_linestatus", "l_suppkey",
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000.0 + k % 30).alias("net"),
        ((q - 25) * (q - 25) + k % 50).cast("double").alias("curve"), (F.when(q > 30, 40.0).otherwise(10.0) + k % 7).alias("step"),
    )


SH = """(SELECT *, l_extendedprice * (1 - l_discount) / 1000.0::DOUBLE + l_partkey % 30 AS net, ((l_quantity - 25) * (l_quantity - 25) + l_partkey % 50)::DOUBLE AS curve,
 (CASE WHEN l_quantity > 30 THEN 40.0 ELSE 10.0 END + l_partkey % 7)::DOUBLE AS step FROM lineitem)"""


def named(df):
    return df.withColumnRenamed("column", "column_name")


@query("ins_01_pair_gate", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n, round(corr({c}, net), 8) + 0.0 AS r FROM {SH} WHERE {c} IS NOT NULL AND net IS NOT NULL "
    f"HAVING count(*) >= 15 AND stddev_pop({c}) >= 1e-8 AND stddev_pop(net) >= 1e-8" for c in X))
def pair_gate(t):
    return rounded(named(insight.pair_stats(shaped(t), X, F.col("net"))).select("column_name", "n", "r"), 8)


@query("ins_02_linear_relations", sql_rounded(" UNION ALL ".join(f"""
SELECT '{c}' AS column_name, count(*) AS n, corr({c}, net) AS r, pow(corr({c}, net), 2) AS r2, regr_slope(net, {c}) AS slope, regr_intercept(net, {c}) AS intercept,
 tanh(atanh(corr({c}, net)) - 1.96 / sqrt(count(*) - 3)) AS ci_lower, tanh(atanh(corr({c}, net)) + 1.96 / sqrt(count(*) - 3)) AS ci_upper,
 regr_slope(net, {c}) * stddev_samp({c}) AS slope_sd FROM {SH} HAVING abs(corr({c}, net)) >= .15""" for c in X),
    "column_name n", 6, "r r2 slope intercept ci_lower ci_upper slope_sd"))
def linear(t):
    return rounded(named(insight.linear_relations(shaped(t), X, F.col("net")).drop("p_value")), 6)


CURVE = """
SELECT * FROM (WITH d AS (SELECT {c}::DOUBLE AS x, curve AS y FROM {s}), m AS (SELECT avg(x) AS mx, stddev_samp(x) AS sx, avg(y) AS my, stddev_samp(y) AS sy, corr(x, y) AS r FROM d),
z AS (SELECT (x - mx) / sx AS z, (y - my) / sy AS v FROM d, m),
s AS (SELECT count(*)::DOUBLE AS n, sum(z) AS z1, sum(z * z) AS z2, sum(z * z * z) AS z3, sum(z * z * z * z) AS z4, sum(v) AS b0, sum(z * v) AS b1, sum(z * z * v) AS b2, sum(v * v) AS vv FROM z),
e AS (SELECT *, z4 + 1e-5 AS a11, z2 + 1e-5 AS a22 FROM s),
k AS (SELECT *, a11 * (a22 * n - z1 * z1) - z3 * (z3 * n - z1 * z2) + z2 * (z3 * z1 - a22 * z2) AS det FROM e),
w AS (SELECT *, (b2 * (a22 * n - z1 * z1) - z3 * (b1 * n - z1 * b0) + z2 * (b1 * z1 - a22 * b0)) / det AS wa,
 (a11 * (b1 * n - b0 * z1) - b2 * (z3 * n - z1 * z2) + z2 * (z3 * b0 - b1 * z2)) / det AS wb,
 (a11 * (a22 * b0 - z1 * b1) - z3 * (z3 * b0 - z2 * b1) + b2 * (z3 * z1 - a22 * z2)) / det AS wc FROM k)
SELECT '{c}' AS column_name, n::BIGINT AS n, CASE WHEN wa > 0 THEN 'U-shaped' ELSE 'inverted U-shaped' END AS curve,
 1 - (vv - 2 * (wa * b2 + wb * b1 + wc * b0) + wa * wa * z4 + wb * wb * z2 + wc * wc * n + 2 * wa * wb * z3 + 2 * wa * wc * z2 + 2 * wb * wc * z1) / (vv - b0 * b0 / n) AS r2_quad,
 r * r AS r2_lin, CASE WHEN '{c}' = 'l_quantity' THEN true ELSE false END AS found FROM w, m)"""


@query("ins_03_curved_relations", sql_rounded(" UNION ALL ".join(CURVE.format(c=c, s=SH) for c in ("l_quantity", "l_discount")),
    "column_name n curve found", 6, "r2_quad r2_lin"))
def curved(t):
    out = insight.curved_relations(shaped(t), ["l_quantity", "l_discount"], F.col("curve"))
    return rounded(named(out).drop("vertex_x", "p_value"), 6)


STEP = """
SELECT * FROM (WITH d AS (SELECT {c}::DOUBLE AS x, step - (SELECT avg(step) FROM {s}) AS y FROM {s}),
v AS (SELECT x, count(*)::DOUBLE AS k, sum(y) AS s, sum(y * y) AS q FROM d GROUP BY x),
c AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(k) OVER (ORDER BY x) AS nl, sum(s) OVER (ORDER BY x) AS sl, sum(k) OVER () AS n, sum(s) OVER () AS ts, sum(q) OVER () AS tq FROM v),
g AS (SELECT *, sl * sl / nl + (ts - sl) * (ts - sl) / (n - nl) AS gain FROM c WHERE nx IS NOT NULL AND nl >= greatest(10, floor(.05 * n)) AND n - nl >= greatest(10, floor(.05 * n)))
SELECT '{c}' AS column_name, n::BIGINT AS n, (x + nx) / 2 AS threshold, nl::BIGINT AS n_left, sl / nl + (SELECT avg(step) FROM {s}) AS mean_left,
 (ts - sl) / (n - nl) + (SELECT avg(step) FROM {s}) AS mean_right, (ts - sl) / (n - nl) - sl / nl AS delta, gain / tq AS r2 FROM g ORDER BY gain DESC, x LIMIT 1)"""


@query("ins_04_threshold_effects", sql_rounded(" UNION ALL ".join(STEP.format(c=c, s=SH) for c in ("l_quantity", "l_discount")),
    "column_name n n_left", 6, "threshold mean_left mean_right delta r2"))
def threshold(t):
    out = insight.threshold_effects(shaped(t), ["l_quantity", "l_discount"], F.col("step"))
    return rounded(named(out).drop("cohen_d", "p_value", "found"), 6)


def reversed_table(t):
    """Within each flag the outcome falls with quantity, across flags it rises."""
    lift = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 60).otherwise(120)
    x = F.col("l_quantity") + lift
    return t.lineitem.select("l_returnflag", "l_linestatus", x.alias("x"), (3.0 * lift - x + F.col("l_partkey") % 5).alias("y"), F.col("l_discount").alias("d"))


RV = """(SELECT l_returnflag, l_linestatus, l_quantity + f AS x, 3.0::DOUBLE * f - (l_quantity + f) + l_partkey % 5 AS y FROM
 (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 60 ELSE 120 END AS f FROM lineitem))"""


@query("ins_05_reversals", f"""
WITH w AS (SELECT corr(x, y) AS r_global FROM {RV}), g AS (SELECT 'l_returnflag' AS grouping_name, l_returnflag AS g, count(*) AS n, corr(x, y) AS r FROM {RV} GROUP BY 2
 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*), corr(x, y) FROM {RV} GROUP BY 2)
SELECT 'x' AS column_name, grouping_name, round(any_value(r_global), 7) + 0.0 AS r_global, count(*) AS groups,
 count(*) FILTER (r * sign(r_global) < -.05) AS reversed, round(sum(r * n) / sum(n), 7) + 0.0 AS mean_group_r FROM g, w
GROUP BY grouping_name HAVING count(*) FILTER (r * sign(any_value(r_global)) < -.05) / count(*) >= .6""".replace(
    "GROUP BY grouping_name HAVING count(*) FILTER (r * sign(any_value(r_global)) < -.05) / count(*) >= .6",
    "GROUP BY grouping_name HAVING count(*) FILTER (r * sign(r_global) < -.05) >= .6 * count(*)"))
def reversals(t):
    out = insight.reversals(reversed_table(t), ["x"], F.col("y"), ["l_returnflag", "l_linestatus"])
    return rounded(named(out).withColumnRenamed("grouping", "grouping_name").drop("p_global"), 7)


@query("ins_06_quartile_contrast", sql_rounded(" UNION ALL ".join(f"""
SELECT * FROM (WITH q AS (SELECT quantile_cont({c}::DOUBLE, .25) AS q25, quantile_cont({c}::DOUBLE, .75) AS q75 FROM {SH}),
r AS (SELECT any_value(q25) AS q25, any_value(q75) AS q75, 100.0 * avg(y) FILTER ({c} >= q75) AS rate_high, 100.0 * avg(y) FILTER ({c} <= q25) AS rate_low
 FROM (SELECT *, (l_returnflag = 'R')::INT AS y FROM {SH}), q)
SELECT '{c}' AS column_name, *, CASE WHEN rate_low > 1e-4 THEN rate_high / rate_low ELSE 1.0 END AS relative_risk FROM r)""" for c in X),
    "column_name", 6, "q25 q75 rate_high rate_low relative_risk"))
def contrast(t):
    df = shaped(t)
    y = (F.col("l_returnflag") == "R").cast("double")
    return rounded(named(insight.quartile_contrast(df, X, y)), 6)


@query("ins_07_binary_target", """
WITH c AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT v FROM c ORDER BY n DESC, v LIMIT 1)
SELECT (SELECT v FROM t) AS positive_class, count(*) AS rows, count(*) FILTER (o_orderpriority = (SELECT v FROM t)) AS positives FROM orders""")
def binary_target(t):
    y, label = insight.target_column(t.orders, "o_orderpriority")
    return t.orders.agg(F.lit(label).alias("positive_class"), F.count("*").alias("rows"), F.sum(y).cast("long").alias("positives"))


@query("ins_09_insights")
def all_insights(t):
    df = shaped(t).select(*X, "l_returnflag", "l_linestatus", "curve")
    return named(insight.insights(df, "curve", "regression"))


# ---- features ----


@query("fe_01_date_parts", """
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS fe_o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS fe_o_orderdate_month,
 CAST(isodow(o_orderdate) - 1 AS INTEGER) AS fe_o_orderdate_dayofweek, CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS fe_o_orderdate_is_weekend FROM orders""")
def date_parts(t):
    parts = {}
    for name, c in fe.date_columns(t.orders, "o_totalprice").items():
        parts.update(fe.date_parts(c, name))
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in parts.items()])


def spread(t):
    return t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", (F.col("l_quantity") * F.col("l_extendedprice") * F.col("l_extendedprice")).alias("heavy"))


@query("fe_02_skewed_columns", " UNION ALL ".join(
    f"SELECT '{n}' AS column_name, count(*) AS n, round(min({e}), 4)::DOUBLE AS low, round(skewness({e}), 7) + 0.0 AS skew FROM lineitem"
    for n, e in (("l_quantity", "l_quantity"), ("l_extendedprice", "l_extendedprice"), ("heavy", "l_quantity * l_extendedprice * l_extendedprice"))))
def skewed(t):
    return rounded(named(fe.skewed_columns(spread(t), ["l_quantity", "l_extendedprice", "heavy"])), 7, low=4)


@query("fe_03_interaction_pairs", """
WITH s AS (SELECT *, l_quantity * l_extendedprice * l_extendedprice AS heavy FROM lineitem),
p AS (SELECT 'l_quantity' AS column_a, 'heavy' AS column_b, corr(l_quantity, heavy) AS r, count(*) AS n FROM s
 UNION ALL SELECT 'l_extendedprice', 'heavy', corr(l_extendedprice, heavy), count(*) FROM s
 UNION ALL SELECT 'l_quantity', 'l_extendedprice', corr(l_quantity, l_extendedprice), count(*) FROM s
 UNION ALL SELECT 'l_discount', 'heavy', corr(l_discount, heavy), count(*) FROM s)
SELECT column_a, column_b, round(r, 8) + 0.0 AS r, n FROM p WHERE abs(r) > .1 AND abs(r) < .95 ORDER BY abs(r) DESC LIMIT 4""")
def interactions(t):
    return rounded(fe.interaction_pairs(spread(t), ["l_quantity", "l_extendedprice", "l_discount", "heavy"]), 8)


@query("fe_04_05_engineer")
def engineer(t):
    df = t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_shipdate", (F.col("l_quantity") * F.col("l_extendedprice")).alias("gross"),
                           (F.col("l_quantity") * F.col("l_extendedprice") > 1.2e6).cast("int").alias("big"))
    out, chosen = fe.engineer(df, "big")
    return out.select(*[F.col(f"`{c}`") for c in chosen]).agg(*[F.round(F.avg(F.col(f"`{c}`")), 6).alias(c) for c in chosen])


@query("fe_06_symbolic_features", """
WITH s AS (SELECT l_quantity AS a, l_extendedprice AS b, l_extendedprice / l_quantity + l_partkey % 10 AS y FROM lineitem),
f AS (SELECT 'ratio_l_extendedprice_l_quantity' AS feature, abs(corr(CASE WHEN abs(a) > 1e-4 THEN b / a ELSE 0 END, y)) AS c FROM s
 UNION ALL SELECT 'log_prod_l_extendedprice_l_quantity', abs(corr(ln(1 + abs(b)) * ln(1 + abs(a)), y)) FROM s
 UNION ALL SELECT 'spread_l_extendedprice_l_quantity', abs(corr((b - a) / sqrt(b * b + a * a + 1), y)) FROM s)
SELECT feature, round(c, 8) + 0.0 AS correlation, round(c - greatest((SELECT abs(corr(a, y)) FROM s), (SELECT abs(corr(b, y)) FROM s)), 8) + 0.0 AS lift FROM f""")
def symbolic(t):
    df = t.lineitem.select("l_extendedprice", "l_quantity", (F.col("l_extendedprice") / F.col("l_quantity") + F.col("l_partkey") % 10).alias("y"))
    return rounded(fe.symbolic_features(df, "y").select("feature", "correlation", "lift"), 8)


@query("fe_07_symbolic_view", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity, 0), 8) + 0.0 AS ratio_l_extendedprice_l_quantity FROM lineitem""")
def symbolic_view(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", (F.col("l_extendedprice") / F.col("l_quantity")).alias("y"))
    found = fe.symbolic_features(df, "y", ["l_extendedprice", "l_quantity"], top_k=1)
    fe.symbolic_view(df, found, "lineitem_features")
    view = t.spark.table("lineitem_features")
    return rounded(view.select("l_orderkey", "l_linenumber", "ratio_l_extendedprice_l_quantity"), 8)


@query("fe_08_robust_scale", """
WITH d AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS v FROM events),
m AS (SELECT quantile_cont(v, .5) AS m FROM d), f AS (SELECT event_id, coalesce(v, m) AS v FROM d, m),
q AS (SELECT quantile_cont(v, .25) AS a, quantile_cont(v, .5) AS b, quantile_cont(v, .75) AS c FROM f)
SELECT event_id, round((v - b) / CASE WHEN c > a THEN c - a ELSE 1.0 END, 7) + 0.0 AS v FROM f, q""")
def robust_scale(t):
    df = t.events.select("event_id", F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("v"))
    return rounded(fe.robust_scale(df, ["v"]), 7)


@query("fe_09_one_hot", """
SELECT event_id, (event_type = 'click')::INT::DOUBLE AS event_type_click, (event_type = 'error')::INT::DOUBLE AS event_type_error,
 (event_type = 'purchase')::INT::DOUBLE AS event_type_purchase, (event_type = 'signup')::INT::DOUBLE AS event_type_signup,
 (event_type = 'view')::INT::DOUBLE AS event_type_view FROM events""")
def one_hot(t):
    df = t.events.select("event_id", "event_type")
    return fe.one_hot(df, "event_type", fe.categories(df, "event_type")).drop("event_type")


@query("fe_10_ordinal_codes", """
WITH d AS (SELECT DISTINCT p_name AS v FROM part WHERE p_partkey % 3 > 0), c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM d)
SELECT p_partkey, coalesce(code, -1) AS p_name_code FROM part LEFT JOIN c ON p_name = v""")
def ordinal(t):
    codes = fe.ordinal_codes(t.part.where("p_partkey % 3 > 0"), "p_name")
    return fe.ordinal_encode(t.part.select("p_partkey", "p_name"), "p_name", codes).select("p_partkey", "p_name_code")


@query("fe_11_clean_category", """
SELECT event_id, CASE WHEN event_id % 4 = 0 OR event_type IS NULL THEN '__missing__' ELSE event_type END AS event_type FROM events""")
def clean_category(t):
    raw = F.when(F.col("event_id") % 8 == 0, F.lit(" N/A ")).when(F.col("event_id") % 4 == 0, None).otherwise(F.concat(F.lit(" "), "event_type"))
    return t.events.select("event_id", fe.clean_category(raw).alias("event_type"))


@query("fe_12_useful_features", """
SELECT v.* FROM (SELECT count(DISTINCT c_custkey) AS a, count(DISTINCT c_name) AS b, count(DISTINCT c_nationkey) AS c, count(DISTINCT c_acctbal) AS d, count(*) AS n FROM customer),
LATERAL (VALUES ('c_custkey', a, true), ('c_name', b, NOT (b > 30 AND b / n::DOUBLE > .5)), ('c_nationkey', c, true), ('c_acctbal', d, true)) AS v(column_name, distinct_values, keep)""")
def useful(t):
    return named(fe.useful_features(t.customer, "c_mktsegment")).withColumnRenamed("distinct", "distinct_values")


@query("fe_13_encode_target", "SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END::DOUBLE AS label, count(*) AS n FROM orders GROUP BY 1, 2")
def encode_target(t):
    return fe.encode_target(t.orders, "o_orderstatus")[0].groupBy("o_orderstatus", "label").agg(F.count("*").alias("n"))


@query("fe_14_balanced_weights", """
SELECT l_orderkey, l_linenumber, round(count(*) OVER () / (3.0 * count(*) OVER (PARTITION BY l_returnflag)), 9) + 0.0 AS weight FROM lineitem""")
def weights(t):
    return rounded(fe.balanced_weights(t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag").drop("l_returnflag"), 9)


@query("fe_15_stratified_split", """
SELECT o_orderstatus, CAST(floor((count(*) - 1) * .8) AS BIGINT) + 1 AS train_rows, count(*) AS rows FROM orders GROUP BY 1""")
def split(t):
    s = fe.stratified_split(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"])
    return s.groupBy("o_orderstatus").agg(F.sum(F.col("is_train").cast("long")).alias("train_rows"), F.count("*").alias("rows"))


@query("fe_16_regression_target", """
SELECT count(*) AS rows, count(*) FILTER (c_custkey % 3 > 0) AS parsed, 'regression' AS task_type FROM customer""")
def regression_target(t):
    raw = F.when(F.col("c_custkey") % 3 == 0, F.lit("none")).otherwise(F.concat(F.lit("$ "), F.col("c_custkey").cast("string"), F.lit(" k")))
    return fe.regression_or_classification(t.customer.select(raw.alias("spend")), "spend")
