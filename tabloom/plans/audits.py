"""Leakage (LEAK) and drift (DRF) audits on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift, leakage
from .registry import query, rounded, sql_rounded

ORDER_FEATURES = ["o_custkey", "o_totalprice", "o_orderpriority"]


def orders(t):
    return t.orders.select("o_orderstatus", *ORDER_FEATURES)


def entropy_sql(expr: str, source: str) -> str:
    return f"""(SELECT greatest(ln(sum(n)) - sum(n * ln(n)) / sum(n), 0.0) FROM
      (SELECT count(*)::DOUBLE AS n FROM {source} WHERE {expr} IS NOT NULL GROUP BY {expr}))"""


@query("leak_01_entropy", f"SELECT 'o_orderstatus' AS column_name, round({entropy_sql('o_orderstatus', 'orders')}, 9) + 0.0 AS entropy")
def entropy(t):
    return rounded(leakage.target_entropy(t.orders, "o_orderstatus").withColumnRenamed("column", "column_name"), 9)


def bins_sql(c: str, source: str, bins: int = 10) -> str:
    """Bin number of column ``c`` on its own distinct quantile edges (right-closed)."""
    steps = [f"({c} > (SELECT quantile_cont({c}::DOUBLE, {i / bins}) FROM {source}))::INT" for i in range(1, bins)]
    return "(" + " + ".join(steps) + ")"


def mi_sql(name: str, x: str, y: str, source: str) -> str:
    return f"""
SELECT '{name}' AS column_name, (SELECT sum(n)::BIGINT FROM c) AS rows, greatest(
 ((SELECT sum(n * ln(n)) FROM c) - (SELECT sum(n * ln(n)) FROM (SELECT sum(n)::DOUBLE AS n FROM c GROUP BY x))
  - (SELECT sum(n * ln(n)) FROM (SELECT sum(n)::DOUBLE AS n FROM c GROUP BY y))) / (SELECT sum(n) FROM c)
 + ln((SELECT sum(n) FROM c)), 0.0) AS mi, {entropy_sql(y, source)} AS h
FROM (SELECT 1) WHERE true"""


def _mi_query(parts: list[tuple[str, str]], y: str, source: str) -> str:
    out = []
    for name, x in parts:
        out.append(
            f"SELECT * FROM (WITH c AS (SELECT {x} AS x, {y} AS y, count(*)::DOUBLE AS n FROM {source} "
            f"WHERE {name} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1, 2) {mi_sql(name, x, y, source)})"
        )
    return (
        "SELECT column_name, rows, round(mi, 8) + 0.0 AS mi, round(CASE WHEN h > 1e-7 THEN least(mi / h, 1.0) ELSE 0 END, 8) + 0.0 "
        "AS mi_ratio FROM (" + " UNION ALL ".join(out) + ")"
    )


@query("leak_02_discrete_mutual_information", _mi_query([("o_orderpriority", "o_orderpriority")], "o_orderstatus", "orders"))
def discrete_mi(t):
    out = leakage.information_ratios(t.orders, "o_orderstatus", ["o_orderpriority"])
    return rounded(out.withColumnRenamed("column", "column_name"), 8)


@query("leak_03_binned_mutual_information", _mi_query(
    [("o_custkey", bins_sql("o_custkey", "orders")), ("o_totalprice", bins_sql("o_totalprice", "orders"))], "o_orderstatus", "orders"))
def binned_mi(t):
    out = leakage.information_ratios(t.orders, "o_orderstatus", ["o_custkey", "o_totalprice"])
    return rounded(out.withColumnRenamed("column", "column_name"), 8)


@query("leak_04_target_bins", f"""
SELECT {bins_sql('o_totalprice', 'orders')}::VARCHAR AS bin, count(*) AS n FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1""")
def target_bins(t):
    return t.orders.groupBy(leakage.target_code(t.orders, "o_totalprice", "regression").alias("bin")).agg(F.count("*").alias("n"))


@query("leak_05_discrete_rule", """
SELECT 'l_linenumber' AS target, count(DISTINCT l_linenumber) AS distinct_values,
  count(DISTINCT l_linenumber) <= greatest(5, CAST(floor(0.05 * count(*)) AS BIGINT)) AS discrete FROM lineitem""")
def discrete_rule(t):
    flag = leakage.is_discrete(t.lineitem, "l_linenumber", "regression")
    return t.lineitem.agg(F.lit("l_linenumber").alias("target"), F.count_distinct("l_linenumber").alias("distinct_values"), F.lit(flag).alias("discrete"))


def eta_sql(g: str, v: str, source: str) -> str:
    return f"""
(SELECT CASE WHEN sum(n * s) + sum(n * pow(m - c, 2)) <= 1e-12 THEN 0.0 ELSE
 sqrt(sum(n * pow(m - c, 2)) / (sum(n * s) + sum(n * pow(m - c, 2)))) END FROM (
 SELECT *, sum(n * m) OVER () / sum(n) OVER () AS c FROM (SELECT {g} AS g, count(*) AS n, avg({v}) AS m, var_pop({v}) AS s
 FROM {source} WHERE {g} IS NOT NULL AND {v} IS NOT NULL GROUP BY {g})))"""


@query("leak_06_correlation_ratio", f"""
SELECT 'o_orderpriority' AS column_name, round({eta_sql('o_orderpriority', 'o_totalprice', 'orders')}, 8) + 0.0 AS eta
UNION ALL SELECT 'o_orderstatus', round({eta_sql('o_orderstatus', 'o_totalprice', 'orders')}, 8) + 0.0""")
def correlation_ratio(t):
    cols = ["o_orderpriority", "o_orderstatus"]
    s = leakage.strengths(t.orders.select("o_totalprice", *cols), "o_totalprice", cols)
    return rounded(s.select(F.col("column").alias("column_name"), F.col("strength").alias("eta")), 8)


def cramer_sql(x: str, y: str, source: str) -> str:
    return f"""
(WITH c AS (SELECT {x} AS x, {y} AS y, count(*)::DOUBLE AS n FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1, 2),
m AS (SELECT *, sum(n) OVER (PARTITION BY x) AS nx, sum(n) OVER (PARTITION BY y) AS ny FROM c)
SELECT sqrt(greatest(least((sum(n * n / (nx * ny)) - 1) / (least(count(DISTINCT x), count(DISTINCT y)) - 1), 1), 0)) FROM m)"""


@query("leak_07_cramers_v", f"""
SELECT 'o_orderpriority' AS column_name, round({cramer_sql('o_orderpriority', 'o_orderstatus', 'orders')}, 8) + 0.0 AS cramers_v
UNION ALL SELECT 'o_clerk_group', round({cramer_sql("(o_custkey % 97)", 'o_orderstatus', 'orders')}, 8) + 0.0""")
def cramers_v(t):
    df = t.orders.select("o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 97).cast("string").alias("o_clerk_group"))
    s = leakage.strengths(df, "o_orderstatus", ["o_orderpriority", "o_clerk_group"])
    return rounded(s.select(F.col("column").alias("column_name"), F.col("strength").alias("cramers_v")), 8)


def rank_corr_sql(x: str, y: str, source: str) -> str:
    return f"""(SELECT greatest(abs(corr(x, y)), abs(corr(rx, ry))) FROM (SELECT x, y,
 rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
 rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry
 FROM (SELECT {x}::DOUBLE AS x, {y}::DOUBLE AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)))"""


@query("leak_08_correlation", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round({rank_corr_sql(c, 'l_extendedprice', 'lineitem')}, 8) + 0.0 AS strength"
    for c in ("l_quantity", "l_discount", "l_partkey")))
def correlation(t):
    s = leakage.strengths(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_partkey"])
    return rounded(s.select(F.col("column").alias("column_name"), "strength"), 8)


def shipped(t):
    li = t.lineitem.select("l_orderkey", "l_shipdate", "l_returnflag", "l_quantity")
    return li.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")


@query("leak_09_temporal_inversion", """
SELECT 'l_shipdate' AS column_name, count(*) AS rows, round(avg((l_shipdate > o_orderdate)::INT), 8) + 0.0 AS future_ratio,
 count(*) >= 3 AND avg((l_shipdate > o_orderdate)::INT) > 0.05 AS inverted FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def temporal(t):
    out = leakage.temporal_inversions(shipped(t), "o_orderdate", ["l_shipdate"])
    return rounded(out.withColumnRenamed("column", "column_name"), 8)


@query("leak_11_identifiers", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, round(count(DISTINCT {c})::DOUBLE / count(*), 8) + 0.0 AS unique_ratio,
 {idn} AS id_name, ({idn} AND count(DISTINCT {c})::DOUBLE / count(*) > .5) OR (count(DISTINCT {c})::DOUBLE / count(*) > .9 AND count(*) >= 10 AND {cnt}) AS id_like FROM events"""
    for c, idn, cnt in (("event_id", "true", "true"), ("user_id", "true", "true"), ("event_type", "false", "true"), ("value", "false", "false"))))
def identifiers(t):
    out = leakage.unique_ratios(t.events, ["event_id", "user_id", "event_type", "value"])
    return rounded(out.withColumnRenamed("column", "column_name").withColumnRenamed("distinct", "distinct_values"), 8)


def proxied(t):
    """Orders with a planted proxy and an identifier."""
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return t.orders.select(
        "o_orderstatus", "o_orderkey", "o_totalprice", "o_orderpriority",
        (rank * 10 + F.col("o_totalprice") / 1e7).alias("proxy"),
    )


PROXIED = """(SELECT o_orderstatus, o_orderkey, o_totalprice, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END * 10
 + o_totalprice / 1e7 AS proxy FROM orders)"""
AUDIT = f"""
WITH d AS {PROXIED}, mi AS ({_mi_query([("o_orderkey", bins_sql("o_orderkey", "d")), ("o_totalprice", bins_sql("o_totalprice", "d")),
 ("o_orderpriority", "o_orderpriority"), ("proxy", bins_sql("proxy", "d"))], "o_orderstatus", "d")}),
s AS (SELECT 'o_orderkey' AS c, {eta_sql('o_orderstatus', 'o_orderkey', 'd')} AS strength, true AS id_like
 UNION ALL SELECT 'o_totalprice', {eta_sql('o_orderstatus', 'o_totalprice', 'd')}, false
 UNION ALL SELECT 'o_orderpriority', {cramer_sql('o_orderpriority', 'o_orderstatus', 'd')}, false
 UNION ALL SELECT 'proxy', {eta_sql('o_orderstatus', 'proxy', 'd')}, false),
a AS (SELECT c AS column_name, id_like, mi_ratio, strength,
 CASE WHEN strength >= .95 OR mi_ratio >= .85 THEN 'CRITICAL' WHEN strength >= .85 OR mi_ratio >= .7 OR id_like THEN 'WARNING' ELSE 'CLEAN' END AS severity
 FROM s JOIN mi ON s.c = mi.column_name)
"""


@query("leak_12_severity", AUDIT + "SELECT column_name, id_like, round(mi_ratio, 7) + 0.0 AS mi_ratio, round(strength, 7) + 0.0 AS strength, severity FROM a")
def severity(t):
    a = leakage.audit(proxied(t), "o_orderstatus")
    return rounded(a.select(F.col("column").alias("column_name"), "id_like", "mi_ratio", "strength", "severity"), 7)


def clashing(t):
    return t.lineitem.select("l_quantity", "l_discount", "l_linenumber", "l_returnflag")


CLASH = """
SELECT count(*) AS conflict_count, coalesce(sum(labels), 0)::BIGINT AS conflict_labels, coalesce(sum(rows), 0)::BIGINT AS rows_affected FROM (
 SELECT count(DISTINCT l_returnflag) AS labels, count(*) AS rows FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL
 AND l_linenumber IS NOT NULL GROUP BY l_quantity, l_discount, l_linenumber HAVING count(DISTINCT l_returnflag) > 1)
"""


@query("leak_13_contradictory_labels", sql_rounded(f"""
SELECT *, CASE WHEN conflict_count > 0 THEN least(100.0, label_ratio * 400 + conflict_count * 10) ELSE 0.0 END AS suspicion FROM (
SELECT *, least(1.0, conflict_labels::DOUBLE / (SELECT count(*) FROM lineitem)) AS label_ratio FROM ({CLASH}))""",
    "conflict_count conflict_labels rows_affected", 6, "label_ratio suspicion"))
def contradictions(t):
    return rounded(leakage.contradictions(clashing(t), "l_returnflag"), 6)


@query("leak_14_overall_risk", AUDIT + """
SELECT count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'WARNING') AS warning, false AS temporal,
 least(100.0, round(35.0 * count(*) FILTER (severity = 'CRITICAL') + 15.0 * count(*) FILTER (severity = 'WARNING'), 1))::DOUBLE AS risk_score,
 count(*) FILTER (severity <> 'CLEAN') > 0 AS has_leakage FROM a""")
def overall_risk(t):
    d = proxied(t)
    return leakage.overall_risk(leakage.audit(d, "o_orderstatus"), leakage.contradictions(d, "o_orderstatus"))


@query("leak_15_quarantine", "SELECT o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def quarantine(t):
    d = proxied(t)
    return leakage.quarantine(d, leakage.audit(d, "o_orderstatus"))


# ---- drift: early line items against late ones ----

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount"]
LI_CAT = ["l_returnflag", "l_linestatus"]


def sides(t):
    cut = F.lit("1998-01-01").cast("timestamp")
    df = t.lineitem.select(*LI_NUM, *LI_CAT, "l_shipdate")
    return df.where(F.col("l_shipdate") < cut).drop("l_shipdate"), df.where(F.col("l_shipdate") >= cut).drop("l_shipdate")


SIDES = "SELECT *, l_shipdate >= TIMESTAMP '1998-01-01' AS cur FROM lineitem WHERE l_shipdate IS NOT NULL"


def psi_sql(c: str, op: str, source: str = SIDES) -> str:
    probs = ", ".join(str(i / 10) for i in range(11))
    return f"""
SELECT * FROM (WITH d AS (SELECT {c}::DOUBLE AS x, cur FROM ({source}) WHERE {c} IS NOT NULL),
e AS (SELECT list_sort(list_distinct(quantile_cont(x, [{probs}]))) AS e FROM d WHERE NOT cur),
b AS (SELECT len(list_filter(e, lambda q, i: i > 1 AND i < len(e) AND x {op} q)) AS b, cur FROM d, e),
n AS (SELECT b, count(*) FILTER (NOT cur) AS r, count(*) FILTER (cur) AS c FROM b GROUP BY b),
p AS (SELECT CASE WHEN r > 0 THEN r / sum(r) OVER () ELSE 1e-4 END AS e, CASE WHEN c > 0 THEN c / sum(c) OVER () ELSE 1e-4 END AS a FROM n)
SELECT '{c}' AS column_name, greatest(sum((a - e) * ln(a / e)), 0.0) AS psi FROM p)"""


def cat_psi_sql(c: str) -> str:
    return f"""
SELECT * FROM (WITH n AS (SELECT {c} AS b, count(*) FILTER (NOT cur) AS r, count(*) FILTER (cur) AS c FROM ({SIDES}) WHERE {c} IS NOT NULL GROUP BY 1),
p AS (SELECT CASE WHEN r > 0 THEN r / sum(r) OVER () ELSE 1e-4 END AS e, CASE WHEN c > 0 THEN c / sum(c) OVER () ELSE 1e-4 END AS a FROM n)
SELECT '{c}' AS column_name, greatest(sum((a - e) * ln(a / e)), 0.0) AS psi FROM p)"""


def ks_sql(c: str) -> str:
    return f"""
SELECT * FROM (WITH v AS (SELECT {c}::DOUBLE AS x, count(*) FILTER (NOT cur) AS r, count(*) FILTER (cur) AS c FROM ({SIDES}) WHERE {c} IS NOT NULL GROUP BY 1),
g AS (SELECT x, abs(sum(r) OVER (ORDER BY x) / sum(r) OVER () - sum(c) OVER (ORDER BY x) / sum(c) OVER ()) AS d, lead(x) OVER (ORDER BY x) AS nx,
 sum(r) OVER () AS nr, sum(c) OVER () AS nc FROM v),
k AS (SELECT '{c}' AS column_name, max(nr)::BIGINT AS ref_rows, max(nc)::BIGINT AS cur_rows, max(d) AS ks, coalesce(sum(d * (nx - x)), 0.0) AS wasserstein FROM g),
l AS (SELECT *, sqrt(ref_rows::DOUBLE * cur_rows / (ref_rows + cur_rows)) * ks AS lam FROM k)
SELECT column_name, ref_rows, cur_rows, ks, wasserstein, CASE WHEN lam < .2 THEN 1.0 ELSE least(greatest(2 * list_sum(list_transform(range(1, 61),
 lambda j: (CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * j * j * lam * lam))), 0.0), 1.0) END AS p_value FROM l)"""


def moments_sql(c: str) -> str:
    return f"""
SELECT '{c}' AS column_name, avg({c}) FILTER (NOT cur) AS ref_mean, avg({c}) FILTER (cur) AS cur_mean, stddev_samp({c}) FILTER (NOT cur) AS ref_std,
 stddev_samp({c}) FILTER (cur) AS cur_std, CASE WHEN abs(avg({c}) FILTER (NOT cur)) > 1e-4 THEN 100.0 * (avg({c}) FILTER (cur) - avg({c}) FILTER (NOT cur))
 / avg({c}) FILTER (NOT cur) ELSE 0.0 END AS mean_shift_pct FROM ({SIDES})"""


def named(df):
    return df.withColumnRenamed("column", "column_name")


@query("drf_01_psi", sql_rounded(" UNION ALL ".join(psi_sql(c, ">") for c in LI_NUM), "column_name", 9, "psi"))
def psi_right(t):
    return rounded(named(drift.numeric_psi(*sides(t), LI_NUM)), 9)


@query("drf_02_psi_histogram", sql_rounded(" UNION ALL ".join(psi_sql(c, ">=") for c in LI_NUM), "column_name", 9, "psi"))
def psi_left(t):
    return rounded(named(drift.numeric_psi(*sides(t), LI_NUM, right_closed=False)), 9)


@query("drf_03_category_psi", sql_rounded(" UNION ALL ".join(cat_psi_sql(c) for c in LI_CAT), "column_name", 9, "psi"))
def psi_category(t):
    return rounded(named(drift.category_psi(*sides(t), LI_CAT)), 9)


@query("drf_04_05_distances", sql_rounded(
    " UNION ALL ".join(ks_sql(c) for c in LI_NUM), "column_name ref_rows cur_rows", 7, "ks wasserstein p_value", wasserstein=4))
def distances(t):
    return rounded(named(drift.distances(*sides(t), LI_NUM)), 7, wasserstein=4)


@query("drf_06_moments", sql_rounded(
    " UNION ALL ".join(moments_sql(c) for c in LI_NUM), "column_name", 5, "ref_mean cur_mean ref_std cur_std mean_shift_pct"))
def moments(t):
    return rounded(named(drift.moments(*sides(t), LI_NUM)), 5)


REPORT = f"""
WITH k AS ({" UNION ALL ".join(ks_sql(c) for c in LI_NUM)}),
pr AS ({" UNION ALL ".join(psi_sql(c, ">") for c in LI_NUM)}), pl AS ({" UNION ALL ".join(psi_sql(c, ">=") for c in LI_NUM)}),
pc AS ({" UNION ALL ".join(cat_psi_sql(c) for c in LI_CAT)})
"""


@query("drf_07_report", REPORT + """
SELECT column_name, 'numeric' AS kind, round(psi, 8) + 0.0 AS psi, p_value < .05 OR psi >= .2 AS drift_detected FROM k JOIN pr USING (column_name)
UNION ALL SELECT column_name, 'categorical', round(psi, 8) + 0.0, psi >= .2 FROM pc""")
def report(t):
    return rounded(named(drift.report(*sides(t))).select("column_name", "kind", "psi", "drift_detected"), 8)


STATUS = REPORT + """, st AS (
SELECT column_name, CASE WHEN p_value < .01 AND psi > .2 THEN 'CRITICAL_DRIFT' WHEN p_value < .01 OR psi > .1 THEN 'MODERATE_SHIFT' ELSE 'HEALTHY' END AS status
FROM k JOIN pl USING (column_name)
UNION ALL SELECT column_name, CASE WHEN psi > .2 THEN 'CRITICAL_DRIFT' WHEN psi > .1 THEN 'MODERATE_SHIFT' ELSE 'HEALTHY' END FROM pc)"""


@query("drf_08_sentinel", STATUS + "SELECT column_name, status FROM st")
def sentinel(t):
    return named(drift.sentinel(*sides(t))).select("column_name", "status")


def mmd_sql(ref: str, cur: str, columns: list[str]) -> str:
    """Maximum mean discrepancy of two sides as SQL, over the same fixed frequencies."""
    turns = ", ".join("(" + " + ".join(f"{w!r} * z{i}" for i, w in enumerate(ws)) + ")" for ws in drift.frequencies(len(columns)).tolist())
    z = ", ".join(f"({c}::DOUBLE - avg({c}::DOUBLE) FILTER (side = 0) OVER ()) / CASE WHEN stddev_pop({c}::DOUBLE) FILTER (side = 0) OVER () >= 1e-4 "
                  f"THEN stddev_pop({c}::DOUBLE) FILTER (side = 0) OVER () ELSE 1 END AS z{i}" for i, c in enumerate(columns))
    return f"""WITH b AS (SELECT *, 0 AS side FROM ({ref}) UNION ALL BY NAME SELECT *, 1 AS side FROM ({cur})),
z AS (SELECT side, {z} FROM b WHERE {" AND ".join(f"{c} IS NOT NULL" for c in columns)}),
a AS (SELECT side, unnest(range({drift.FREQUENCIES})) AS j, unnest([{turns}]) AS angle FROM z),
e AS (SELECT j, avg(cos(angle)) FILTER (side = 0) - avg(cos(angle)) FILTER (side = 1) AS c, avg(sin(angle)) FILTER (side = 0) - avg(sin(angle)) FILTER (side = 1) AS s FROM a GROUP BY j)
SELECT (SELECT count(*) FROM b WHERE side = 0) AS ref_rows, round(sqrt(sum(c * c + s * s) / {drift.FREQUENCIES}), 6) + 0.0 AS mmd FROM e"""


MMD = mmd_sql("SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'", "SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'", LI_NUM)


@query("drf_09_mmd", MMD)
def mmd(t):
    ref, cur = sides(t)
    return rounded(ref.agg(F.count("*").alias("ref_rows"), F.lit(drift.mmd(ref, cur, LI_NUM)).alias("mmd")), 6)


@query("drf_10_verdict", STATUS + f""", n AS (SELECT count(*) AS columns, count(*) FILTER (status = 'CRITICAL_DRIFT') AS drifting FROM st),
v AS (SELECT columns, drifting, drifting / greatest(columns, 1)::DOUBLE AS drift_ratio, mmd FROM n, ({MMD}) AS m)
SELECT columns, drifting, round(drift_ratio, 6) + 0.0 AS drift_ratio, mmd,
 CASE WHEN drift_ratio >= .3 OR mmd > .45 THEN 'CRITICAL_DRIFT' WHEN drift_ratio >= .1 OR mmd > .2 THEN 'WARN_MONITOR' ELSE 'PASS_HEALTHY' END AS status,
 CASE WHEN drift_ratio >= .3 OR mmd > .45 THEN 'ACTIVATE_SAFE_FALLBACK' WHEN drift_ratio >= .1 OR mmd > .2 THEN 'TRIGGER_RETRAIN' ELSE 'PASS_HEALTHY' END AS action FROM v""")
def verdict(t):
    ref, cur = sides(t)
    return rounded(drift.verdict(drift.sentinel(ref, cur), drift.mmd(ref, cur, LI_NUM)), 6)


@query("drf_11_outlier_rate")
def outlier_rate(t):
    return drift.outlier_rate(*sides(t))


@query("drf_12_self_drift", """
WITH o AS (SELECT o_totalprice, o_custkey, row_number() OVER (ORDER BY o_orderkey) > (SELECT count(*) // 2 FROM orders) AS cur FROM orders),
r AS (""" + " UNION ALL ".join(psi_sql(c, ">", "SELECT * FROM o") for c in ("o_totalprice", "o_custkey")) + """)
SELECT count(*) AS columns, round(avg(psi), 8) + 0.0 AS mean_psi,
 CASE WHEN avg(psi) < .1 THEN 'NO DRIFT DETECTED' WHEN avg(psi) < .25 THEN 'MODERATE DRIFT' ELSE 'SEVERE DRIFT' END AS status FROM r""")
def self_drift(t):
    ref, cur = drift.halves(t.orders.select("o_orderkey", "o_totalprice", "o_custkey"), "o_orderkey")
    return rounded(drift.summary(drift.report(ref.drop("o_orderkey"), cur.drop("o_orderkey"))).drop("drifted"), 8)


@query("drf_13_tail_split", """
WITH o AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) > (SELECT count(*) - greatest(CAST(floor(count(*) * 0.2) AS BIGINT), 20) FROM orders) AS cur FROM orders)
SELECT cur, count(*) AS n, round(avg(o_totalprice), 4) + 0.0 AS mean FROM o GROUP BY cur""")
def tail_split(t):
    ref, cur = drift.tail(t.orders, "o_orderkey")
    both = ref.withColumn("cur", F.lit(False)).unionByName(cur.withColumn("cur", F.lit(True)))
    return rounded(both.groupBy("cur").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean")), 4)
