"""Models (ML), uplift (CAU-06) and scenarios (SIM) on the driver tables."""

from __future__ import annotations

from itertools import permutations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..operators import models, scenario
from .registry import query, rounded

NUM = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
ALL = [*NUM, "l_returnflag"]


def base(t):
    """Line items with a noisy binary label and a numeric outcome."""
    label = (F.col("l_quantity") + F.col("l_suppkey") % 40 > 45).cast("double")
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", *ALL, label.alias("label"), (F.col("l_quantity") * 2.0 + F.col("l_discount") * 100.0 + F.col("l_partkey") % 7).alias("outcome"),
    )


KEYS = ["l_orderkey", "l_linenumber"]


def split(t, label: str = "label"):
    """Prepared train and test tables."""
    task = "classification" if label == "label" else "regression"
    return models.prepare(base(t), label, ALL, KEYS, task)


def metrics(t, key: str, task: str = "classification"):
    train, test, _ = split(t, "label" if task == "classification" else "outcome")
    return models.leaderboard(train, test, [key], task)[0]


@query("ml_01_logistic_regression")
def logreg(t):
    return metrics(t, "logreg")


def _determinant(cell) -> str:
    """Leibniz's sum over the permutations of four columns, as SQL; ``cell(i, j)`` names a number."""
    terms = []
    for p in permutations(range(4)):
        sign = (-1) ** sum(p[i] > p[j] for i in range(4) for j in range(i + 1, 4))
        terms.append(f"{'+' if sign > 0 else '-'} " + " * ".join(cell(i, p[i]) for i in range(4)))
    return "(" + " ".join(terms) + ")"


RIDGE_ALPHA = 50.0
# the normal equations of the four features, solved by Cramer's rule
_SUMS = ", ".join([f"covar_pop({a}, {b}) * count(*) + {RIDGE_ALPHA if a == b else 0.0} AS m{i}{j}" for i, a in enumerate(NUM) for j, b in enumerate(NUM)]
                  + [f"covar_pop({a}, y) * count(*) AS b{i}, avg({a}) AS a{i}" for i, a in enumerate(NUM)])
_WHOLE = _determinant(lambda i, j: f"m{i}{j}")
RIDGE = f"""l AS (SELECT *, l_quantity * 2.0 + l_discount * 100.0 + l_partkey % 7 AS y FROM lineitem), m AS (SELECT count(*) AS rows, {_SUMS} FROM l),
c AS (SELECT *, {", ".join(f"{_determinant(lambda i, j, k=k: f'b{i}' if j == k else f'm{i}{j}')} / {_WHOLE} AS c{k}" for k in range(4))} FROM m)"""


@query("ml_02_ridge_regression", f"WITH {RIDGE} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(c{i}, 7) + 0.0 AS coefficient, rows FROM c" for i, f in enumerate(NUM)))
def ridge(t):
    """All four features of the estimator's solver."""
    coef = models.ridge_coefficients(base(t), NUM, "outcome", RIDGE_ALPHA)
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(coef[f]).alias("coefficient")) for f in NUM])
    return rounded(base(t).agg(F.count("*").alias("rows")).select(F.explode(items).alias("e"), "rows").select("e.*", "rows"), 7)


@query("ml_02_linear_regression")
def linreg(t):
    return metrics(t, "linreg", "regression")


@query("ml_03_decision_tree")
def tree(t):
    return metrics(t, "dt")


@query("ml_04_random_forest")
def forest(t):
    return metrics(t, "rf")


@query("ml_05_boosted_trees")
def boosted(t):
    return metrics(t, "gb")


@query("ml_06_extra_trees")
def extra(t):
    return metrics(t, "et")


@query("ml_07_svm")
def svm(t):
    return metrics(t, "svm")


def vectors(t):
    split_on = F.expr("pmod(vec_id, 5) = 0")
    x = t.embeddings.select("vec_id", F.col("label").cast("double").alias("label"), F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    x = x.select("vec_id", "label", array_to_vector("v").alias("features"))
    return x.where(~split_on), x.where(split_on)


@query("ml_08_nearest_neighbours", """
WITH t AS (SELECT vec_id, label::DOUBLE AS label, embedding FROM embeddings WHERE vec_id % 5 <> 0), q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 5 = 0),
d AS (SELECT q.vec_id, t.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), t.label) AS rn FROM q, t),
v AS (SELECT vec_id, label, count(*) AS n FROM d WHERE rn <= 5 GROUP BY 1, 2)
SELECT vec_id, arg_min(label, row(-n, label)) AS prediction FROM v GROUP BY vec_id""")
def neighbours(t):
    train, test = vectors(t)
    return models.nearest_neighbours(train, test, "vec_id")


@query("ml_09_mlp")
def mlp(t):
    return metrics(t, "mlp")


@query("ml_10_random_search")
def random_search(t):
    train, _, _ = split(t)
    return models.search("logreg", train, KEYS, draws=20, parallelism=1)[1]


@query("ml_11_cross_validation")
def cross_validation(t):
    train, _, _ = split(t)
    return models.cross_validate("logreg", train, KEYS, folds=5)


@query("ml_12_calibration")
def calibration(t):
    train, test, _ = split(t)
    a, b = models.calibrate("dt", train, KEYS)
    s = models.calibrated(models.scored(models.fit_model("dt", train), test), a, b)
    return s.agg(F.avg("label").alias("rate"), F.avg(F.col("probs")[1]).alias("mean_probability"), F.count("*").alias("rows"))


@query("ml_13_ensemble")
def ensemble(t):
    train, test, _ = split(t)
    together, _ = models.best_ensemble(train, test, ["logreg", "dt", "svm", "rf"], KEYS, folds=2)
    return models.ev.classification_metrics(together, "label", "prediction")


@query("ml_14_leaderboard")
def leaderboard(t):
    train, test, _ = split(t)
    return models.leaderboard(train, test, ["logreg", "dt", "rf", "gb", "svm", "knn"])[0]


@query("ml_15_importance")
def importance(t):
    train, _, prep = split(t)
    return models.mean_importance([models.fit_model(k, train) for k in ("dt", "logreg")], prep.names, t.spark)


@query("ml_16_linear_attribution", f"WITH {RIDGE} " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(avg(abs(c{i} * ({f} - a{i}))), 6) + 0.0 AS attribution FROM l, c" for i, f in enumerate(NUM)))
def attribution(t):
    return rounded(models.linear_attribution(base(t), models.ridge_coefficients(base(t), NUM, "outcome", RIDGE_ALPHA)), 6)


@query("ml_16_permutation_importance")
def permutation(t):
    train, _, prep = split(t)
    return models.permutation_importance(models.fit_model("dt", train), base(t), ALL, KEYS, prep)


@query("ml_17_surrogate_rules")
def surrogate(t):
    train, test, prep = split(t)
    return models.surrogate_rules(models.scored(models.fit_model("logreg", train), test), prep.names)


@query("ml_18_tree_sql", "SELECT count(*) AS rows, 0::BIGINT AS different FROM lineitem")
def tree_sql(t):
    """The fitted tree as a CASE expression agrees with the model on every row."""
    df = base(t)
    prep = models.Preprocessor.fit(df, NUM)
    x = prep.transform(df)
    model = models.fit_model("dt", x)
    flat = model.transform(x).withColumn("v", vector_to_array("features"))
    sql = models.tree_sql(model, [f"v[{i}]" for i in range(len(prep.names))])
    s = flat.withColumn("by_sql", F.expr(sql))
    return s.agg(F.count("*").alias("rows"), F.sum((F.col("by_sql") != F.col("prediction")).cast("long")).alias("different"))


@query("ml_19_reconstruction_anomalies")
def anomalies(t):
    rows, per = models.reconstruction_anomalies(base(t).select(*KEYS, *NUM), NUM)
    share = rows.agg(F.avg(F.col("anomaly").cast("double"))).scalar()
    return per.withColumn("anomaly_share", share)


@query("ml_20_what_if")
def what_if(t):
    train, _, prep = split(t)
    w = models.what_if(models.fit_model("logreg", train), base(t), prep, {"l_quantity": F.col("l_quantity") + 5.0})
    return w.agg(F.count("*").alias("rows"), F.avg(F.col("probs_before")[1]).alias("before"), F.avg(F.col("probs")[1]).alias("after"))


@query("cau_06_uplift")
def uplift(t):
    df = base(t).withColumn("treated", (F.col("l_returnflag") == "R").cast("int"))
    return models.uplift_summary(models.uplift(df, ["l_quantity", "l_discount", "l_tax"], "label", "treated"))


# ---- scenarios: a fixed logistic score of the order's amounts ----

SIM = ["balance", "debt_ratio", "tenure"]


def accounts(t):
    spend = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spend"), F.count("*").alias("n"))
    return t.customer.join(spend, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", (F.col("c_acctbal") / 1000.0).alias("balance"), F.coalesce(F.col("spend") / 1e6, F.lit(0.0)).alias("debt_ratio"),
        F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("tenure"),
    )


score = scenario.RowScore(lambda x: 1.0 / (1.0 + F.exp(-(0.35 * x["balance"] - 0.9 * x["debt_ratio"] + 0.12 * x["tenure"] - 1.5))), SIM)


_ACCOUNTS = """a AS (SELECT c_custkey AS k, c_acctbal / 1000.0 AS b, coalesce(spend / 1e6, 0.0) AS d, coalesce(n, 0)::DOUBLE AS t
 FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS spend, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""
_P = "1.0 / (1.0 + exp(-(0.35 * {b} - 0.9 * {d} + 0.12 * {t} - 1.5)))"


def _p(b: str, d: str, t: str) -> str:
    return _P.format(b=b, d=d, t=t)


def _moved(letter: str, first: int) -> str:
    """The value of one feature under a numbered move of the coordinate search."""
    return (f"CASE move WHEN {first} THEN least({letter} + 0.05 * s{letter}, hi{letter}) WHEN {first + 1} THEN greatest({letter} - 0.05 * s{letter}, lo{letter}) "
            f"ELSE {letter} END AS n{letter}")


# the state of one round after another; a row that ends without reaching .5 has no proposal to compare
@query("sim_01_counterfactuals", f"""
WITH RECURSIVE {_ACCOUNTS},
r AS (SELECT {", ".join(f"stddev_pop({x}) AS s{x}, min({x}) AS lo{x}, max({x}) AS hi{x}" for x in "bdt")} FROM a),
s(k, b, d, t, ob, od, ot, p, i) AS (
  SELECT k, b, d, t, b, d, t, p, 0 FROM (SELECT *, {_p("b", "d", "t")} AS p FROM a) WHERE p < 0.5
  UNION ALL
  SELECT k, nb, nd, nt, ob, od, ot, np, i + 1 FROM (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY np < 0.5, CASE WHEN np >= 0.5 THEN move ELSE 1 - np + 0.05 * (pow((nb - ob) / sb, 2) + pow((nd - od) / sd, 2) + pow((nt - ot) / st, 2)) END, move) AS rn
    FROM (SELECT *, {_p("nb", "nd", "nt")} AS np FROM (
      SELECT s.*, r.*, move, {_moved("b", 0)}, {_moved("d", 2)}, {_moved("t", 4)} FROM s, r, (SELECT unnest(range(6)) AS move) WHERE p < 0.5 AND i < 400))) WHERE rn = 1),
l AS (SELECT k, arg_max(row(b, d, t, p), i) AS x FROM s GROUP BY k)
SELECT k AS c_custkey, x[4] >= 0.5 AS found, {", ".join(f"CASE WHEN x[4] >= 0.5 THEN round(x[{i}], 9) + 0.0 END AS {c}" for i, c in ((1, "balance"), (2, "debt_ratio"), (3, "tenure"), (4, "p")))} FROM l""")
def counterfactuals(t):
    a = accounts(t)
    low = score(a).where("p < 0.5").drop("p")
    found = scenario.counterfactuals(low, a, SIM, "c_custkey", score)
    return rounded(found.select("c_custkey", "found", *[F.when(F.col("found"), F.col(c)).alias(c) for c in (*SIM, "p")]), 9)


_LADDER = "(VALUES " + ", ".join(f"({i + 1}, {x}::DOUBLE)" for i, x in enumerate(scenario.STEPS)) + ") AS l(idx, x)"


def _recourse_round(prev: str) -> str:
    """Balance may only rise, the debt ratio only fall; a row below .55 takes its best move, another stays as it is."""
    return f"""(SELECT k, nb AS b, nd AS d, t, ob, od, np AS p, p0 FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY np < 0.55, CASE WHEN np >= 0.55 THEN abs(nb - ob) / mb + abs(nd - od) / md ELSE 1 - np END, move) AS rn
  FROM (SELECT *, {_p("nb", "nd", "t")} AS np FROM (
    SELECT *, CASE WHEN what = 'b' THEN greatest(least(greatest(b + x * mb, lob), hib), ob) ELSE b END AS nb,
           CASE WHEN what = 'd' THEN least(least(greatest(d - x * md, lod), hid), od) ELSE d END AS nd
    FROM {prev} AS z, q, (SELECT 0 AS move, 'stay' AS what, 0.0::DOUBLE AS x UNION ALL SELECT idx, 'b', x FROM {_LADDER} UNION ALL SELECT idx + 6, 'd', x FROM {_LADDER}) AS m
    WHERE p < 0.55 OR move = 0))) WHERE rn = 1)"""


@query("sim_02_recourse", f"""
WITH {_ACCOUNTS},
c AS (SELECT {", ".join(f"quantile_cont({x}, 0.01) AS lo{x}, quantile_cont({x}, 0.5) AS med{x}, quantile_cont({x}, 0.99) AS hi{x}" for x in "bd")} FROM a),
q AS (SELECT {", ".join(f"median(abs({x} - med{x})) AS m{x}, any_value(lo{x}) AS lo{x}, any_value(hi{x}) AS hi{x}" for x in "bd")} FROM a, c),
z AS (SELECT k, b, d, t, b AS ob, d AS od, p, p AS p0 FROM (SELECT *, {_p("b", "d", "t")} AS p FROM a) WHERE p < 0.55),
e AS (SELECT *, abs(b - ob) / mb + abs(d - od) / md AS cost FROM {_recourse_round(_recourse_round("z"))} AS y, q)
SELECT k AS c_custkey, {", ".join(f"round({x}, 9) + 0.0 AS {n}" for x, n in (("b", "balance"), ("d", "debt_ratio"), ("t", "tenure"), ("p0", "p_before"), ("p", "p"), ("cost", "cost")))},
 CASE WHEN p >= 0.55 THEN 'OPTIMAL_RECOURSE_FOUND' WHEN cost > 1e-9 THEN 'HIGH_COST_RECOURSE' ELSE 'INFEASIBLE' END AS feasibility FROM e""")
def recourse(t):
    a = accounts(t)
    low = score(a).where("p < 0.55").drop("p")
    r = scenario.recourse(low, a, SIM, "c_custkey", score, immutable=["tenure"], directions={"balance": "increasing", "debt_ratio": "decreasing"})
    return rounded(r.select("c_custkey", *SIM, "p_before", "p", "cost", "feasibility"), 9)


@query("sim_02_recourse_actions")
def recourse_actions(t):
    a = accounts(t)
    low = score(a).where("p < 0.55").drop("p")
    r = scenario.recourse(low, a, SIM, "c_custkey", score, immutable=["tenure"])
    return scenario.recourse_actions(r, a, "c_custkey", SIM)


def _adverse(df):
    return score(df).withColumn("p", 1.0 - F.col("p"))


@query("sim_03_stress")
def stress(t):
    a = accounts(t)
    rate = _adverse(a).agg(F.avg((F.col("p") >= 0.5).cast("double"))).first()[0]
    return scenario.stress_report(scenario.stress_replicates(a, SIM, ["c_custkey"], _adverse), rate)


@query("sim_04_risk_drivers")
def risk_drivers(t):
    a = accounts(t)
    rate = _adverse(a).agg(F.avg((F.col("p") >= 0.5).cast("double"))).first()[0]
    reps = scenario.stress_replicates(a, SIM, ["c_custkey"], _adverse)
    return scenario.risk_drivers(reps, scenario.stress_report(reps, rate), SIM)
