"""Causal estimates (CAU) and conservation laws (INV) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import causal, laws
from .registry import query, rounded


def chain(t):
    """quantity -> gross -> tax due, with discount as an unrelated column."""
    noise = (F.col("l_partkey") % 100) / 10.0
    gross = F.col("l_quantity") * 3.0 + noise
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("z"), gross.alias("x"),
        (gross * 1.5 + F.col("l_quantity") * 0.5 + (F.col("l_suppkey") % 10) / 5.0).alias("y"), F.col("l_discount").alias("w"),
    )


CH = """(SELECT l_orderkey, l_linenumber, l_quantity AS z, l_quantity * 3.0::DOUBLE + (l_partkey % 100) / 10.0::DOUBLE AS x,
 (l_quantity * 3.0::DOUBLE + (l_partkey % 100) / 10.0::DOUBLE) * 1.5::DOUBLE + l_quantity * 0.5::DOUBLE + (l_suppkey % 10) / 5.0::DOUBLE AS y, l_discount AS w FROM lineitem)"""


@query("cau_01_graph")
def graph(t):
    df = chain(t).drop("l_orderkey", "l_linenumber")
    return causal.edge_table(df, causal.discover_graph(df, "y"), "y")


@query("cau_01_roles")
def roles(t):
    df = chain(t).drop("l_orderkey", "l_linenumber")
    return causal.roles(df, causal.discover_graph(df, "y"), "y")


SLOPE = f"""(SELECT (covar_pop(x, y) * var_pop(z) - covar_pop(z, y) * covar_pop(x, z)) / (var_pop(x) * var_pop(z) - pow(covar_pop(x, z), 2)) FROM {CH})"""


@query("cau_03_intervention", f"""
SELECT 'x' AS treatment, 'y' AS outcome, 100.0::DOUBLE AS value, round(avg(y), 4) + 0.0 AS baseline,
 round(avg(y) + {SLOPE} * (100 - avg(x)), 4) + 0.0 AS expected, round({SLOPE} * (100 - avg(x)), 4) + 0.0 AS ate FROM {CH}""")
def intervention(t):
    df = chain(t)
    g = causal.Graph(["z", "x", "y"], {("z", "x"), ("z", "y"), ("x", "y")})
    e = causal.intervention(df, "x", "y", 100.0, g, keys=["l_orderkey", "l_linenumber"])
    return rounded(e.select("treatment", "outcome", "value", "baseline", "expected", "ate"), 4)


@query("cau_04_bootstrap_interval")
def bootstrap(t):
    df = chain(t)
    g = causal.Graph(["z", "x", "y"], {("z", "x"), ("z", "y"), ("x", "y")})
    return causal.intervention(df, "x", "y", 100.0, g, keys=["l_orderkey", "l_linenumber"]).select("ate", "ci_lower", "ci_upper")


@query("cau_05_backdoor_effect", f"""
WITH b AS (SELECT {SLOPE} AS bx), z AS (SELECT (covar_pop(z, y) - bx * covar_pop(x, z)) / var_pop(z) AS bz, avg(y) - bx * avg(x) AS part, avg(z) AS mz FROM {CH}, b GROUP BY bx),
r AS (SELECT sum(pow(y - bx * x - bz * z - (part - bz * mz), 2)) AS sse, count(*) AS n, var_pop(x) * count(*) AS sxx, pow(corr(x, z), 2) AS r2 FROM {CH}, b, z)
SELECT 'x' AS treatment, 'y' AS outcome, n, round(bx, 6) + 0.0 AS ate, round(sqrt(sse / (n - 3) / (sxx * (1 - r2))), 7) + 0.0 AS se FROM b, r""")
def backdoor(t):
    e = causal.backdoor_effect(chain(t), "x", "y", ["z"]).select("treatment", "outcome", "n", "ate", "se")
    return rounded(e, 6, se=7)


@query("cau_07_resolved_reversal", """
WITH d AS (SELECT l_returnflag AS g, l_quantity + f AS x, 3.0::DOUBLE * f - (l_quantity + f) + l_partkey % 5 AS y FROM
 (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 60 ELSE 120 END AS f FROM lineitem)),
p AS (SELECT g, count(*) AS n, regr_slope(y, x) AS b FROM d GROUP BY g)
SELECT 'x' AS treatment, 'y' AS outcome, 'l_returnflag' AS grouping_name, count(*) AS groups, round((SELECT regr_slope(y, x) FROM d), 6) + 0.0 AS aggregate_slope,
 round(sum(n * b) / sum(n), 6) + 0.0 AS stratified_slope, 'Confounder' AS role, 'stratified' AS effect_to_use FROM p""")
def resolved(t):
    from .insights import reversed_table

    g = causal.Graph(["l_returnflag", "x", "y"], {("l_returnflag", "x"), ("l_returnflag", "y"), ("x", "y")})
    out = causal.resolved_reversals(reversed_table(t), "x", "y", "l_returnflag", g)
    return rounded(out.withColumnRenamed("grouping", "grouping_name"), 6)


@query("ins_08_prescription")
def prescription(t):
    df = chain(t)
    p = causal.prescribe(df, "y", ["x", "w"], keys=["l_orderkey", "l_linenumber"])
    return df.sparkSession.createDataFrame([(p["column"], p["baseline"], p["value"], p["ate"], p["effect_per_unit"])] if p else [],
                                           "column_name string, baseline double, value double, ate double, effect_per_unit double")


def ledger(t):
    """Line items with an exact balance: net + rebate = gross."""
    gross = F.col("l_extendedprice")
    rebate = F.floor(gross * F.col("l_discount") * 100) / 100.0
    off = F.when(F.col("l_orderkey") % 1000 == 7, 5.0).otherwise(0.0)
    return t.lineitem.select("l_orderkey", "l_linenumber", gross.alias("gross"), rebate.alias("rebate"), (gross - rebate).alias("net"),
                             (gross - rebate + off).alias("booked"), F.col("l_quantity").alias("quantity"))


LG = """(SELECT l_orderkey, l_linenumber, l_extendedprice AS gross, r AS rebate, l_extendedprice - r AS net,
 l_extendedprice - r + CASE WHEN l_orderkey % 1000 = 7 THEN 5.0 ELSE 0.0 END AS booked, l_quantity AS quantity
 FROM (SELECT *, floor(l_extendedprice * l_discount * 100) / 100.0::DOUBLE AS r FROM lineitem))"""
BALANCE = laws.Law("gross - rebate - booked = 0", {"gross": 1.0, "rebate": -1.0, "booked": -1.0}, 0.0, 1e-6)


@query("inv_01_discover_laws", """
SELECT 'gross' AS column_name, 1.0::DOUBLE AS coefficient, 0.0::DOUBLE AS total, count(*) AS rows FROM lineitem
UNION ALL SELECT 'rebate', -1.0, 0.0, count(*) FROM lineitem UNION ALL SELECT 'net', -1.0, 0.0, count(*) FROM lineitem""")
def discover(t):
    df = ledger(t).select("gross", "rebate", "net", "quantity")
    found = laws.law_table(df, laws.discover(df))
    return found.select(F.explode("coefficients").alias("column_name", "coefficient"), "total", F.lit(t.lineitem.count()).alias("rows"))


@query("inv_03_audit", f"""
SELECT '{BALANCE.name}' AS law, count(*) FILTER (abs(gross - rebate - booked) > 1e-6) AS violations, count(*) AS rows,
 count(*) FILTER (abs(gross - rebate - booked) <= 1e-6) AS passed_rows, round(avg((abs(gross - rebate - booked) > 1e-6)::INT), 8) + 0.0 AS violation_rate FROM {LG}""")
def audit(t):
    return rounded(laws.audit(ledger(t), [BALANCE]), 8)


@query("inv_03_violating_rows", f"SELECT l_orderkey, l_linenumber FROM {LG} WHERE abs(gross - rebate - booked) > 1e-6")
def violating(t):
    return laws.violating_rows(ledger(t), [BALANCE]).select("l_orderkey", "l_linenumber")


@query("inv_04_project", f"""
SELECT l_orderkey, l_linenumber, round(gross - (gross - rebate - booked) / 3, 4) + 0.0 AS gross, round(rebate + (gross - rebate - booked) / 3, 4) + 0.0 AS rebate,
 round(booked + (gross - rebate - booked) / 3, 4) + 0.0 AS booked FROM {LG}""")
def project(t):
    p = laws.project(ledger(t), [BALANCE], ["gross", "rebate", "booked"])
    return rounded(p.select("l_orderkey", "l_linenumber", "gross", "rebate", "booked"), 4)


@query("inv_04_verify", f"""
SELECT count(*) AS rows, count(*) AS passed FROM {LG}""")
def verify(t):
    p = laws.project(ledger(t), [BALANCE], ["gross", "rebate", "booked"])
    r = laws.residuals(p, [BALANCE], ["l_orderkey", "l_linenumber"])
    return r.agg(F.count("*").alias("rows"), F.sum(F.col("passed").cast("long")).alias("passed"))


@query("inv_05_project_nonnegative", f"""
SELECT count(*) AS rows, count(*) AS balanced, count(*) AS nonnegative FROM {LG}""")
def project_nonnegative(t):
    df = ledger(t).withColumn("rebate", F.col("rebate") - 20.0)
    p = laws.project_nonnegative(df, [BALANCE], ["gross", "rebate", "booked"], ["rebate", "booked"])
    ok = F.abs(F.col("gross") - F.col("rebate") - F.col("booked")) < 1e-4
    return p.agg(F.count("*").alias("rows"), F.sum(ok.cast("long")).alias("balanced"),
                 F.sum(((F.col("rebate") >= 0) & (F.col("booked") >= 0)).cast("long")).alias("nonnegative"))


@query("inv_06_simplex", """
WITH s AS (SELECT vec_id, list_sort(list_transform(embedding, lambda x: x::DOUBLE), 'DESC') AS u, embedding FROM embeddings),
c AS (SELECT vec_id, i, u[i] AS x, sum(u[i]) OVER (PARTITION BY vec_id ORDER BY i) AS cs FROM (SELECT vec_id, u, unnest(range(1, len(u) + 1)) AS i FROM s)),
t AS (SELECT vec_id, arg_max((cs - 1) / i, i) AS theta FROM c WHERE x - (cs - 1) / i > 0 GROUP BY vec_id),
p AS (SELECT vec_id, unnest(list_transform(embedding, lambda x: greatest(x::DOUBLE - theta, 0))) AS p FROM s JOIN t USING (vec_id))
SELECT vec_id, count(*) FILTER (p > 0) AS positive, round(sum(p), 6) + 0.0 AS total, round(max(p), 6) + 0.0 AS top FROM p GROUP BY vec_id""")
def simplex(t):
    p = t.embeddings.select("vec_id", F.explode(laws.simplex("embedding")).alias("p"))
    return rounded(p.groupBy("vec_id").agg(F.sum((F.col("p") > 0).cast("long")).alias("positive"), F.sum("p").alias("total"), F.max("p").alias("top")), 6)


@query("inv_07_monotone_fit", """
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d, avg(o_totalprice) AS y, count(*)::DOUBLE AS w, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE)) AS i
           FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
c AS (SELECT *, sum(w * y) OVER (ORDER BY i) AS sy, sum(w) OVER (ORDER BY i) AS sw FROM d),
a AS (SELECT f.i AS f, l.i AS l, (l.sy - f.sy + f.w * f.y) / (l.sw - f.sw + f.w) AS mean FROM c AS f JOIN c AS l ON l.i >= f.i),
m AS (SELECT f, l AS i, min(mean) OVER (PARTITION BY f ORDER BY l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS low FROM a)
SELECT d.d, round(max(low), 2) + 0.0 AS fitted FROM m JOIN d USING (i) GROUP BY d.d""")
def monotone(t):
    daily = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.avg("o_totalprice").alias("y"), F.count("*").cast("double").alias("w"))
    fit = laws.monotone_fit(daily.withColumn("x", F.unix_date("d")), "x", "y", "w")
    return rounded(fit.select("d", "fitted"), 2)
