"""Evaluation, decision and conformal metrics (EVAL) on scored line items."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import evaluate as ev
from .registry import query, rounded, sql_rounded


def scored(t):
    prob = (F.col("l_quantity").cast("int") * 10 + F.col("l_partkey") % 500) / 1000.0
    y = (F.col("l_quantity") + F.col("l_suppkey") % 40 > 45).cast("int")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", y.alias("y"), prob.alias("p")
    ).withColumn("pred", (F.col("p") >= 0.5).cast("int"))


S = """(SELECT *, (p >= 0.5)::INT AS pred FROM (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_extendedprice,
 (l_quantity + l_suppkey % 40 > 45)::INT AS y, (CAST(l_quantity AS INT) * 10 + l_partkey % 500) / 1000.0::DOUBLE AS p FROM lineitem))"""


def three_way(t):
    a, b, c = F.col("l_partkey") % 10 + 1, F.col("l_suppkey") % 7 + 1, F.col("l_linenumber") + 1
    s = (a + b + c).cast("double")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", F.array(a / s, b / s, c / s).alias("probs"))


T3 = """(SELECT *, a / (a + b + c)::DOUBLE AS p0, b / (a + b + c)::DOUBLE AS p1, c / (a + b + c)::DOUBLE AS p2 FROM (SELECT l_orderkey, l_linenumber,
 l_quantity, l_discount, l_returnflag, l_partkey % 10 + 1 AS a, l_suppkey % 7 + 1 AS b, l_linenumber + 1 AS c FROM lineitem))"""
CLASSES = ["A", "N", "R"]


@query("eval_01_classification_metrics", sql_rounded(f"""
WITH c AS (SELECT count(*) FILTER (y = 1 AND pred = 1)::DOUBLE AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp,
 count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) AS rows, count(*) FILTER (y = pred) AS ok FROM {S})
SELECT rows, ok / rows::DOUBLE AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c""",
    "rows", 8, "accuracy precision recall f1"))
def binary_metrics(t):
    return rounded(ev.classification_metrics(scored(t), "y", "pred"), 8)


@query("eval_01_macro_metrics", sql_rounded(f"""
WITH d AS (SELECT l_returnflag AS y, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'A' WHEN p1 >= p2 THEN 'N' ELSE 'R' END AS pred FROM {T3}),
k AS (SELECT unnest(['A', 'N', 'R']) AS c),
m AS (SELECT c, (SELECT count(*) FROM d WHERE y = c AND pred = c)::DOUBLE AS h, (SELECT count(*) FROM d WHERE y = c) AS s,
 (SELECT count(*) FROM d WHERE pred = c) AS q FROM k)
SELECT (SELECT count(*) FROM d) AS rows, sum(h) / sum(s) AS accuracy, avg(h / q) AS precision, avg(h / s) AS recall,
 avg(2 * h / (q + s)) AS f1 FROM m""", "rows", 8, "accuracy precision recall f1"))
def macro_metrics(t):
    p = F.col("probs")
    pred = F.when((p[0] >= p[1]) & (p[0] >= p[2]), "A").when(p[1] >= p[2], "N").otherwise("R")
    return rounded(ev.classification_metrics(three_way(t).withColumn("pred", pred), "l_returnflag", "pred"), 8)


@query("eval_02_ranking_metrics", sql_rounded(f"""
WITH v AS (SELECT p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM {S} GROUP BY p),
r AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(neg) OVER (ORDER BY p DESC) AS cn FROM v)
SELECT sum(pos + neg)::BIGINT AS rows, 1 - sum(pos * (cn - neg / 2)) / (sum(pos) * sum(neg)) AS roc_auc,
 sum(pos * cp / (cp + cn)) / sum(pos) AS pr_auc FROM r""", "rows", 8, "roc_auc pr_auc"))
def ranking(t):
    return rounded(ev.ranking_metrics(scored(t), "y", "p"), 8)


@query("eval_02_multiclass_auc", f"""
WITH l AS (SELECT 'A' AS c, p0 AS p, (l_returnflag = 'A')::INT AS y FROM {T3} UNION ALL SELECT 'N', p1, (l_returnflag = 'N')::INT FROM {T3}
 UNION ALL SELECT 'R', p2, (l_returnflag = 'R')::INT FROM {T3}),
v AS (SELECT c, p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM l GROUP BY c, p),
r AS (SELECT *, sum(neg) OVER (PARTITION BY c ORDER BY p DESC) AS cn FROM v),
a AS (SELECT c, 1 - sum(pos * (cn - neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM r GROUP BY c)
SELECT count(*) AS classes, round(avg(auc), 8) + 0.0 AS roc_auc FROM a""")
def multi_auc(t):
    return rounded(ev.multiclass_auc(three_way(t), "l_returnflag", "probs", CLASSES), 8)


@query("eval_03_brier", f"SELECT count(*) AS rows, round(avg(pow(p - y, 2)), 8) + 0.0 AS brier FROM {S}")
def brier(t):
    return rounded(ev.brier(scored(t), "y", "p"), 8)


@query("eval_03_multiclass_brier", f"""
SELECT count(*) AS rows, round(avg(pow(p0 - (l_returnflag = 'A')::INT, 2) + pow(p1 - (l_returnflag = 'N')::INT, 2)
 + pow(p2 - (l_returnflag = 'R')::INT, 2)), 8) + 0.0 AS brier FROM {T3}""")
def multi_brier(t):
    return rounded(ev.multiclass_brier(three_way(t), "l_returnflag", "probs", CLASSES), 8)


def priced(t):
    return scored(t).select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 2000.0 + F.col("p") * 1000.0).alias("yhat"))


P = f"(SELECT l_extendedprice AS y, l_quantity * 2000.0 + p * 1000.0 AS yhat FROM {S})"


@query("eval_04_regression_metrics", sql_rounded(f"""
SELECT count(*) AS rows, avg(abs(y - yhat)) AS mae, sqrt(avg(pow(y - yhat, 2))) AS rmse, 1 - avg(pow(y - yhat, 2)) / var_pop(y) AS r2 FROM {P}""",
    "rows", 4, "mae rmse r2", r2=8))
def regression(t):
    return rounded(ev.regression_metrics(priced(t), "y", "yhat"), 4, r2=8)


@query("eval_05_confusion", f"SELECT y AS actual, pred AS predicted, count(*) AS n FROM {S} GROUP BY 1, 2")
def confusion(t):
    return ev.confusion(scored(t), "y", "pred")


@query("eval_06_roc_curve", sql_rounded(f"""
WITH v AS (SELECT p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM {S} GROUP BY p),
r AS (SELECT p, row_number() OVER (ORDER BY p DESC) AS i, sum(pos) OVER (ORDER BY p DESC) / sum(pos) OVER () AS tpr,
 sum(neg) OVER (ORDER BY p DESC) / sum(neg) OVER () AS fpr, count(*) OVER () AS k FROM v)
SELECT p AS threshold, fpr, tpr FROM r WHERE i % greatest(1, (k + 1) // 50) = 0 UNION ALL SELECT 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE""", "", 8, "threshold fpr tpr"))
def roc(t):
    return rounded(ev.roc_curve(scored(t), "y", "p"), 8)


@query("eval_07_calibration_curve", sql_rounded(f"""
SELECT CAST(greatest(ceil(p * 10) - 1, 0) AS INTEGER) AS bin, count(*) AS n, avg(p) AS prob_pred, avg(y) AS prob_true FROM {S} GROUP BY 1""",
    "bin n", 8, "prob_pred prob_true"))
def calibration(t):
    return rounded(ev.calibration_curve(scored(t), "y", "p"), 8)


COUNTS = """count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp, count(*) FILTER (y = 0 AND pred = 0) AS tn,
 count(*) FILTER (y = 1 AND pred = 0) AS fn"""


@query("eval_08_roi", f"""
WITH c AS (SELECT {COUNTS} FROM {S})
SELECT *, fp * 20.0::DOUBLE + fn * 150.0::DOUBLE AS total_cost, tp * 100.0::DOUBLE + tn * 5.0::DOUBLE AS total_value,
 tp * 100.0::DOUBLE + tn * 5.0::DOUBLE - (fp * 20.0::DOUBLE + fn * 150.0::DOUBLE) AS net_roi, (tn + fp) * 5.0::DOUBLE - (tp + fn) * 150.0::DOUBLE AS baseline_roi,
 tp * 100.0::DOUBLE + tn * 5.0::DOUBLE - (fp * 20.0::DOUBLE + fn * 150.0::DOUBLE) - ((tn + fp) * 5.0::DOUBLE - (tp + fn) * 150.0::DOUBLE) AS model_savings FROM c""")
def roi(t):
    return ev.roi(scored(t), "y", "pred", 20, 150, 100, 5)


@query("eval_09_error_cost", sql_rounded(f"""
SELECT count(*) AS rows, sum(abs(y - yhat)) AS total_error, avg(abs(y - yhat)) AS mae, 100 * avg(abs(y - yhat)) / avg(y) AS error_margin_pct FROM {P}""",
    "rows", 5, "total_error mae error_margin_pct", total_error=1))
def error_cost(t):
    return rounded(ev.error_cost(priced(t), "y", "yhat"), 5, total_error=1)


def _values(ts) -> str:
    return ", ".join(f"({float(x)!r}::DOUBLE)" for x in ts)


@query("eval_10_profit_curve", f"""
WITH th AS (SELECT * FROM (VALUES {_values(np.linspace(0.05, 0.95, 19))}) AS v(threshold)),
c AS (SELECT threshold, count(*) FILTER (y = 1 AND p >= threshold) * 100.0::DOUBLE + count(*) FILTER (y = 0 AND p < threshold) * 5.0::DOUBLE
 - count(*) FILTER (y = 0 AND p >= threshold) * 20.0::DOUBLE - count(*) FILTER (y = 1 AND p < threshold) * 150.0::DOUBLE AS profit FROM {S}, th GROUP BY threshold)
SELECT threshold, profit, row_number() OVER (ORDER BY profit DESC, threshold) = 1 AS best FROM c""")
def profit_curve(t):
    return ev.profit_curve(scored(t), "y", "p", 20, 150, 100, 5)


SWEEP = f"""
WITH th AS (SELECT * FROM (VALUES {_values(np.linspace(0.01, 0.99, 80))}) AS v(threshold)),
g AS (SELECT threshold, l_returnflag AS g, count(*) FILTER (y = 1 AND p >= threshold) AS tp, count(*) FILTER (y = 0 AND p >= threshold) AS fp,
 count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM {S}, th GROUP BY 1, 2),
s AS (SELECT threshold, sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(pos)::DOUBLE AS pos, sum(neg)::DOUBLE AS neg,
 min((tp + fp) / (pos + neg)::DOUBLE) AS lo, max((tp + fp) / (pos + neg)::DOUBLE) AS hi FROM g GROUP BY threshold),
w AS (SELECT threshold, tp * 100 - fp * 20 - (pos - tp) * 150 AS profit, (pos - tp) / pos AS risk, least(greatest(lo / (hi + 1e-6), 0), 1) AS fairness FROM s)
"""


@query("eval_11_threshold_sweep", SWEEP + "SELECT threshold, round(profit, 2) + 0.0 AS profit, round(risk, 8) + 0.0 AS risk, round(fairness, 8) + 0.0 AS fairness FROM w")
def threshold_sweep(t):
    s = ev.threshold_sweep(scored(t), "y", "p", "l_returnflag")
    return s.select("threshold", *[(F.round(c, d) + 0.0).alias(c) for c, d in (("profit", 2), ("risk", 8), ("fairness", 8))])


def part_points(t):
    """One point per part: revenue high, late share low, distinct supplier share high."""
    return t.lineitem.groupBy(F.col("l_partkey").alias("name")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("profit"), F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 6).alias("risk"),
        F.round(F.count_distinct("l_suppkey") / F.count("*"), 6).alias("fairness"),
    )


PTS = """p AS (SELECT l_partkey AS name, round(sum(l_extendedprice), 2) AS profit, round(avg((l_returnflag = 'R')::INT), 6) AS risk,
 round(count(DISTINCT l_suppkey) / count(*)::DOUBLE, 6) AS fairness FROM lineitem GROUP BY 1),
f AS (SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.profit >= a.profit AND b.risk <= a.risk AND b.fairness >= a.fairness
 AND (b.profit > a.profit OR b.risk < a.risk OR b.fairness > a.fairness)))"""


@query("eval_12_skyline", f"WITH {PTS} SELECT * FROM f")
def skyline(t):
    return ev.skyline(part_points(t), "profit", "risk", "fairness")


@query("eval_13_knee", f"""
WITH {PTS}, r AS (SELECT min(profit) AS p0, greatest(1e-6, max(profit) - min(profit)) AS ps, min(risk) AS r0, greatest(1e-6, max(risk) - min(risk)) AS rs,
 min(fairness) AS f0, greatest(1e-6, max(fairness) - min(fairness)) AS fs FROM p),
d AS (SELECT f.*, sqrt(.4 * pow(1 - (profit - p0) / ps, 2) + .3 * pow((risk - r0) / rs, 2) + .3 * pow(1 - (fairness - f0) / fs, 2)) AS distance FROM f, r)
SELECT name, round(distance, 8) + 0.0 AS distance, CASE WHEN name = (SELECT name FROM d ORDER BY distance, name LIMIT 1) THEN 'BALANCED_KNEE'
 WHEN name = (SELECT name FROM d ORDER BY profit DESC, name LIMIT 1) THEN 'MAX_PROFIT' WHEN name = (SELECT name FROM d ORDER BY risk, name LIMIT 1) THEN 'MIN_RISK'
 WHEN name = (SELECT name FROM d ORDER BY fairness DESC, name LIMIT 1) THEN 'MAX_FAIRNESS' ELSE 'PARETO_OPTIMAL' END AS role FROM d""")
def knee(t):
    p = part_points(t)
    k = ev.knee(p, ev.skyline(p, "profit", "risk", "fairness"), "profit", "risk", "fairness", "name")
    return rounded(k.select("name", "distance", "role"), 8)


@query("eval_14_hypervolume", f"""
WITH {PTS}, b AS (SELECT DISTINCT profit AS u, 1.0 - risk AS v, fairness AS w FROM f WHERE profit > 0 AND risk < 1.0 AND fairness > 0),
l AS (SELECT w AS level, w - coalesce(lag(w) OVER (ORDER BY w), 0) AS h FROM (SELECT DISTINCT w FROM b)),
s AS (SELECT level, h, u, max(v) AS v FROM l JOIN b ON b.w >= l.level GROUP BY 1, 2, 3),
a AS (SELECT h, (u - coalesce(lead(u) OVER (PARTITION BY level ORDER BY u DESC), 0)) * max(v) OVER (PARTITION BY level ORDER BY u DESC) AS a FROM s)
SELECT round(sum(a * h), 2) + 0.0 AS hypervolume FROM a""")
def hypervolume(t):
    f = ev.skyline(part_points(t), "profit", "risk", "fairness")
    return rounded(ev.hypervolume(f, "profit", "risk", "fairness", (0.0, 1.0, 0.0)), 2)


@query("eval_15_group_accuracy", f"""
WITH o AS (SELECT avg((y = pred)::INT) AS overall, count(*) AS rows FROM {S}),
g AS (SELECT 'l_returnflag' AS column_name, l_returnflag AS grp, count(*) AS n, avg((y = pred)::INT) AS accuracy FROM {S} GROUP BY 2
 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*), avg((y = pred)::INT) FROM {S} GROUP BY 2)
SELECT column_name, grp, n, round(accuracy, 8) + 0.0 AS accuracy, round(overall, 8) + 0.0 AS overall, overall - accuracy > .15 AS alert FROM g, o
WHERE n > greatest(10, .05 * rows)""")
def group_accuracy(t):
    g = ev.group_accuracy(scored(t), "y", "pred", ["l_returnflag", "l_linestatus"])
    return rounded(g.withColumnRenamed("column", "column_name"), 8)


@query("eval_16_uncertain_rows", f"""
SELECT l_orderkey, l_linenumber, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS predicted,
 round(1 - (list_sort([p0, p1, p2])[3] - list_sort([p0, p1, p2])[2]), 8) + 0.0 AS uncertainty FROM {T3}
ORDER BY 1 - (list_sort([p0, p1, p2])[3] - list_sort([p0, p1, p2])[2]) DESC, l_orderkey, l_linenumber LIMIT 10""")
def uncertain(t):
    return rounded(ev.uncertain_rows(three_way(t), "probs", ["l_orderkey", "l_linenumber"], 10), 8)


CAL = "l_orderkey % 2 = 0"
CONF = f"""
WITH c AS (SELECT 1 - CASE l_returnflag WHEN 'A' THEN p0 WHEN 'N' THEN p1 ELSE p2 END AS s, l_quantity, l_discount FROM {T3} WHERE {CAL}),
o AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i, count(*) OVER () AS n FROM c),
h AS (SELECT any_value((n - 1) * least(ceil((n + 1) * 0.9) / n, 1.0)) AS h FROM o),
q AS (SELECT max(CASE WHEN i = floor(h) THEN s END) + (max(CASE WHEN i = ceil(h) THEN s END) - max(CASE WHEN i = floor(h) THEN s END)) * (any_value(h) - floor(any_value(h))) AS q FROM o, h),
m AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_discount) AS md, stddev_pop(l_discount) AS sd FROM c),
e AS (SELECT t.*, q, sqrt((pow((l_quantity - mq) / sq, 2) + pow((l_discount - md) / sd, 2)) / 2) AS distance,
 (1 - p0 <= q)::INT + (1 - p1 <= q)::INT + (1 - p2 <= q)::INT AS k,
 CASE l_returnflag WHEN 'A' THEN 1 - p0 <= q WHEN 'N' THEN 1 - p1 <= q ELSE 1 - p2 <= q END AS hit,
 CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'A' WHEN p1 >= p2 THEN 'N' ELSE 'R' END AS top FROM {T3} t, q, m WHERE NOT ({CAL}))
"""


def _conformal(t):
    df = three_way(t)
    cal, test = df.where(CAL), df.where(f"NOT ({CAL})")
    q = ev.conformal_threshold(cal.withColumn("s", ev.class_score("l_returnflag", "probs", CLASSES)), "s")
    mean, std = ev.center_spread(cal, ["l_quantity", "l_discount"])
    return ev.conformal_sets(test, "probs", CLASSES, q, ev.distance_to_center(["l_quantity", "l_discount"], mean, std)), q


@query("eval_17_conformal_threshold", CONF + "SELECT round(q, 8) + 0.0 AS q_hat, (SELECT count(*) FROM c) AS rows FROM q")
def conformal_threshold(t):
    cal = three_way(t).where(CAL)
    q = ev.conformal_threshold(cal.withColumn("s", ev.class_score("l_returnflag", "probs", CLASSES)), "s")
    return rounded(cal.agg(F.lit(q).alias("q_hat"), F.count("*").alias("rows")), 8)


@query("eval_18_conformal_sets", CONF + """
SELECT l_orderkey, l_linenumber, top AS predicted, greatest(k, 1) AS set_size, round(distance, 7) + 0.0 AS distance,
 round(-(p0 * log2(p0) + p1 * log2(p1) + p2 * log2(p2)), 7) + 0.0 AS entropy,
 CASE WHEN distance > 2.75 THEN 'EPISTEMIC_OOD_FLAG' WHEN k > 1 OR -(p0 * log2(p0) + p1 * log2(p1) + p2 * log2(p2)) > .85 THEN 'ALEATORIC_NOISE'
 ELSE 'HIGH_CONFIDENCE' END AS verdict FROM e""")
def conformal_sets(t):
    e, _ = _conformal(t)
    return rounded(e.select("l_orderkey", "l_linenumber", "predicted", F.size("conformal_set").alias("set_size"), "distance", "entropy", "verdict"), 7)


@query("eval_18_conformal_report", CONF + """
SELECT count(*) AS rows, 0.1::DOUBLE AS alpha, round(any_value(q), 7) + 0.0 AS q_hat, round(avg(CASE WHEN k = 0 THEN top = l_returnflag ELSE hit END::INT), 7) + 0.0 AS coverage,
 round(avg(greatest(k, 1)), 7) + 0.0 AS mean_size, count(*) FILTER (distance > 2.75) AS ood_rows, round(100.0 * avg((distance > 2.75)::INT), 7) + 0.0 AS ood_pct FROM e""")
def conformal_report(t):
    e, q = _conformal(t)
    return rounded(ev.conformal_report(e, "l_returnflag", q), 7)
