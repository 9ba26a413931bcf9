"""Statistical insights about a target: linear, curved and threshold effects, reversals and contrasts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import corr, finite, ident, numeric_columns, present, ratio, string_columns
from ..functions.ordering import running_totals
from ..functions.pvalues import f_upper, pearson_p, t_two_sided_col
from ..functions.quantiles import quantile_map

MIN_ROWS = 15


def _long(df: DataFrame, columns: Sequence[str], y: Column) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(c).alias("column"), finite(c).alias("x")) for c in columns])
    return df.select(y.alias("y"), F.explode(entries).alias("e")).select("e.column", "e.x", "y").where("x is not null and y is not null")


def pair_stats(df: DataFrame, columns: Sequence[str], y: Column, min_rows: int = MIN_ROWS) -> DataFrame:
    """Moments of each usable (column, target) pair: enough finite rows and spread on both sides."""
    s = _long(df, columns, y).groupBy("column").agg(
        F.count("*").alias("n"), corr("x", "y").alias("r"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"), F.stddev_pop("x").alias("px"), F.stddev_pop("y").alias("py"),
    )
    return s.where((F.col("n") >= min_rows) & (F.col("px") >= 1e-8) & (F.col("py") >= 1e-8)).drop("px", "py")


def linear_relations(df: DataFrame, columns: Sequence[str], y: Column, keep_all: bool = False) -> DataFrame:
    """Pearson r with interval, slope, intercept and effect of one SD; kept when p < .05 and |r| >= .15."""
    s = pair_stats(df, columns, y)
    z = F.atanh(F.least(F.greatest(F.col("r"), F.lit(-0.999999)), F.lit(0.999999)))
    half = 1.96 / F.sqrt(F.greatest(F.col("n") - 3, F.lit(1)))
    slope = F.col("r") * F.col("sy") / (F.col("sx") + 1e-12)
    out = s.select(
        "column", "n", "r", (F.col("r") * F.col("r")).alias("r2"), slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"),
        F.tanh(z - half).alias("ci_lower"), F.tanh(z + half).alias("ci_upper"), (slope * F.col("sx")).alias("slope_sd"),
        pearson_p(F.col("r"), F.col("n")).alias("p_value"),
    )
    return out if keep_all else out.where((F.col("p_value") < 0.05) & (F.abs("r") >= 0.15))


CURVES = "column string, n long, curve string, vertex_x double, r2_quad double, r2_lin double, p_value double, found boolean"


def curved_relations(df: DataFrame, columns: Sequence[str], y: Column) -> DataFrame:
    """Quadratic fit on standardised values per column; ``found`` marks a U or inverted U.

    Power sums of z come from one aggregate per column, the 3 x 3 systems are
    solved on those sums.
    """
    stats = pair_stats(df, columns, y, 25)
    z, v = (F.col("x") - F.col("mx")) / F.col("sx"), (F.col("y") - F.col("my")) / F.col("sy")
    sums = _long(df, columns, y).join(F.broadcast(stats), "column").select("column", "n", "mx", "sx", "r", z.alias("z"), v.alias("v")).groupBy(
        "column", "n", "mx", "sx", "r"
    ).agg(
        *[F.sum(F.pow("z", k)).alias(f"z{k}") for k in (1, 2, 3, 4)], *[F.sum(F.pow("z", k) * F.col("v")).alias(f"zv{k}") for k in (0, 1, 2)],
        F.sum(F.col("v") * F.col("v")).alias("vv"),
    ).collect()
    names = [s["column"] for s in sums]
    bounds = quantile_map(df.where(y.isNotNull()), names, [0.05, 0.95])
    rows = []
    for s in sorted(sums, key=lambda s: s["column"]):
        n = float(s["n"])
        a = np.array([[s["z4"], s["z3"], s["z2"]], [s["z3"], s["z2"], s["z1"]], [s["z2"], s["z1"], n]]) + 1e-5 * np.diag([1.0, 1.0, 0.0])
        b = np.array([s["zv2"], s["zv1"], s["zv0"]])
        w = np.linalg.solve(a, b)
        full = a - 1e-5 * np.diag([1.0, 1.0, 0.0])
        sse = float(s["vv"] - 2 * w @ b + w @ full @ w)
        sst = float(s["vv"] - s["zv0"] ** 2 / n)
        quad, lin = 1.0 - sse / (sst + 1e-12), float(s["r"]) ** 2
        f = (sst * (1.0 - lin) - sse) / (sse / (n - 3) + 1e-12)
        p = f_upper(f, 1, n - 3)
        vertex = -w[1] / (2 * w[0]) if abs(w[0]) > 1e-4 else float("nan")
        lo, hi = ((q - s["mx"]) / s["sx"] for q in bounds[s["column"]])
        found = bool(quad > lin + 0.10 and quad >= 0.15 and p < 0.01 and lo <= vertex <= hi)
        rows.append((s["column"], int(n), "U-shaped" if w[0] > 0 else "inverted U-shaped", float(s["mx"] + vertex * s["sx"]), quad, lin, p, found))
    return df.sparkSession.createDataFrame(rows, CURVES)


def threshold_effects(df: DataFrame, columns: Sequence[str], y: Column) -> DataFrame:
    """The single split of each column that leaves the least squared error; ``found`` marks a real step.

    Values collapse to counts and sums, prefix sums come from bucketed running
    totals, and every split point is scored exactly.
    """
    stats = pair_stats(df, columns, y, 25)
    sums = (
        _long(df, columns, y).join(F.broadcast(stats.select("column", "my")), "column").withColumn("d", F.col("y") - F.col("my"))
        .groupBy("column", "x").agg(F.count("*").alias("k"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q"))
    )
    run = running_totals(sums, "x", ["k", "s", "q"], by=["column"])
    all_of = sums.groupBy("column").agg(F.sum("k").alias("n"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    x = run.join(F.broadcast(all_of), "column").where("next_x is not null")
    nl, nr = F.col("cum_k").cast("double"), (F.col("n") - F.col("cum_k")).cast("double")
    sl, sr = F.col("cum_s"), F.col("ts") - F.col("cum_s")
    leaf = F.greatest(F.lit(10), F.floor(0.05 * F.col("n")))
    gain = sl * sl / nl + sr * sr / nr
    x = x.where((nl >= leaf) & (nr >= leaf)).withColumn("gain", gain)
    best = x.groupBy("column").agg(F.max(F.struct("gain", (-F.col("x")).alias("_o"), "x", "next_x", "cum_k", "cum_s", "cum_q", "n", "ts", "tq")).alias("b")).select("column", "b.*")
    ml, mr = sl / nl, sr / nr
    vl = (F.col("cum_q") - nl * ml * ml) / (nl - 1)
    vr = (F.col("tq") - F.col("cum_q") - nr * mr * mr) / (nr - 1)
    out = best.join(F.broadcast(stats.select("column", "my", "r")), "column").select(
        "column", "n", ((F.col("x") + F.col("next_x")) / 2.0).alias("threshold"), nl.cast("long").alias("n_left"),
        (ml + F.col("my")).alias("mean_left"), (mr + F.col("my")).alias("mean_right"), (mr - ml).alias("delta"),
        F.greatest(vl, F.lit(0.0)).alias("vl"), F.greatest(vr, F.lit(0.0)).alias("vr"), nl.alias("nl"), nr.alias("nr"), "r",
        (F.col("gain") / (F.col("tq") + 1e-12)).alias("r2"),
    )
    pooled = F.sqrt(((F.col("nl") - 1) * F.col("vl") + (F.col("nr") - 1) * F.col("vr")) / (F.col("n") - 2) + 1e-12)
    ea, eb = F.col("vl") / F.col("nl"), F.col("vr") / F.col("nr")
    t = F.try_divide(F.col("delta"), F.sqrt(ea + eb))
    dof = F.try_divide((ea + eb) * (ea + eb), ea * ea / (F.col("nl") - 1) + eb * eb / (F.col("nr") - 1))
    out = out.withColumn("cohen_d", F.abs("delta") / pooled).withColumn("t", t).withColumn("dof", dof)
    still = (F.col("vl") < 1e-9) & (F.col("vr") < 1e-9)
    p = F.when(still, F.when(F.abs("delta") > 1e-6, 0.0).otherwise(1.0)).otherwise(t_two_sided_col("t", "dof"))
    out = out.withColumn("p_value", p)
    found = (
        (F.col("cohen_d") >= 0.5) & (F.col("p_value") < 0.005) & (F.col("r2") >= 0.15)
        & ((F.col("r2") > F.col("r") * F.col("r") + 0.05) | (F.abs("r") < 0.40))
    )
    return out.select("column", "n", "threshold", "n_left", "mean_left", "mean_right", "delta", "cohen_d", "r2", "p_value", F.coalesce(found, F.lit(False)).alias("found"))


def reversals(df: DataFrame, columns: Sequence[str], y: Column, groups: Sequence[str]) -> DataFrame:
    """Simpson reversals: global |r| >= .15 whose sign flips in 60 % of 2-12 groups (or of their rows)."""
    whole = pair_stats(df, columns, y, 30).select("column", F.col("r").alias("r_global"), F.col("n").alias("n_global"))
    whole = whole.withColumn("p_global", pearson_p(F.col("r_global"), F.col("n_global"))).where((F.abs("r_global") >= 0.15) & (F.col("p_global") < 0.05))
    if not groups:
        return df.sparkSession.createDataFrame([], "column string, grouping string, r_global double, groups long, reversed long, mean_group_r double, p_global double")
    cats = F.array(*[F.struct(F.lit(g).alias("grouping"), ident(g).cast("string").alias("g")) for g in groups])
    nums = F.array(*[F.struct(F.lit(c).alias("column"), finite(c).alias("x")) for c in columns])
    long = df.select(y.alias("y"), F.explode(cats).alias("c"), nums.alias("nums")).where("c.g is not null").select("y", "c.*", F.explode("nums").alias("e")).select(
        "grouping", "g", "e.column", "e.x", "y"
    )
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    x, v = F.when(both, F.col("x")), F.when(both, F.col("y"))
    per = long.groupBy("grouping", "column", "g").agg(
        F.count(x).alias("n"), corr(x, v).alias("r"), F.stddev_pop(x).alias("px"), F.stddev_pop(v).alias("py")
    )
    usable = (F.col("n") >= MIN_ROWS) & (F.col("px") >= 1e-8) & (F.col("py") >= 1e-8) & F.col("r").isNotNull()
    flips = usable & (F.col("r") * F.signum("r_global") < -0.05)
    s = per.join(F.broadcast(whole), "column").groupBy("grouping", "column", "r_global", "p_global").agg(
        F.count("*").alias("values"), F.sum(usable.cast("long")).alias("groups"), F.sum(flips.cast("long")).alias("reversed"),
        F.sum(F.when(usable, F.col("n"))).alias("w"), F.sum(F.when(flips, F.col("n")).otherwise(0)).alias("wr"),
        F.sum(F.when(usable, F.col("n") * F.col("r"))).alias("rw"),
    )
    hit = (ratio(F.col("reversed"), F.col("groups")) >= 0.6) | (ratio(F.col("wr"), F.col("w")) >= 0.6)
    return s.where(F.col("values").between(2, 12) & (F.col("groups") >= 2)).where(hit).select(
        "column", "grouping", "r_global", "groups", "reversed", ratio(F.col("rw"), F.col("w")).alias("mean_group_r"), "p_global"
    )


def quartile_contrast(df: DataFrame, columns: Sequence[str], y: Column) -> DataFrame:
    """Target rate at or above the upper quartile against at or below the lower one, with relative risk."""
    q = quantile_map(df, list(columns), [0.25, 0.75])
    items = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(float(q[c][0])).alias("q25"), F.lit(float(q[c][1])).alias("q75"),
                 (finite(c) >= q[c][1]).alias("high"), (finite(c) <= q[c][0]).alias("low")) for c in columns if c in q
    ])
    s = df.select(y.alias("y"), F.explode(items).alias("e")).select("y", "e.*").groupBy("column", "q25", "q75").agg(
        (100.0 * F.avg(F.when(F.col("high"), F.col("y")))).alias("rate_high"), (100.0 * F.avg(F.when(F.col("low"), F.col("y")))).alias("rate_low")
    )
    return s.withColumn("relative_risk", F.when(F.col("rate_low") > 1e-4, F.col("rate_high") / F.col("rate_low")).otherwise(1.0))


def target_column(df: DataFrame, target: str, task: str = "classification") -> tuple[Column, str | None]:
    """Numeric target: the value itself, or 1 for the named class.

    Two classes: the larger value counts as 1.  More: the most frequent class
    against the rest (smallest value on ties).
    """
    if task == "regression":
        return finite(target), None
    counts = df.where(present(df, target)).groupBy(ident(target).alias("v")).agg(F.count("*").alias("n"))
    s = counts.agg(F.count("*").alias("k"), F.max("v").alias("hi"), F.min(F.struct((-F.col("n")).alias("o"), "v")).alias("top")).first()
    if s["k"] < 2:
        return F.lit(None).cast("double"), None
    chosen = s["hi"] if s["k"] == 2 else s["top"]["v"]
    return F.when(present(df, target), (ident(target) == F.lit(chosen)).cast("double")), str(chosen)


def insights(df: DataFrame, target: str, task: str = "classification", max_insights: int = 4, prescribe: bool = True) -> DataFrame:
    """Up to four findings in order: reversal, curve or step, prescription, linear (strongest first)."""
    y, label = target_column(df, target, task)
    numeric = numeric_columns(df, [target])
    texts = string_columns(df, [target])
    out: list[tuple] = []
    seen: set[str] = set()
    if texts:
        found = {r["column"]: r for r in reversals(df, numeric, y, texts).orderBy("column", "grouping").collect()}
        first = next((c for c in numeric if c in found), None)
        if first:
            r = found[first]
            out.append(("paradox", first, f"sign flips within {r['grouping']}", float(r["r_global"]), float(r["mean_group_r"])))
            seen.add(first)
    rest = [c for c in numeric if c not in seen]
    curves = {r["column"]: r for r in curved_relations(df, rest, y).where("found").collect()} if rest else {}
    steps = {r["column"]: r for r in threshold_effects(df, [c for c in rest if c not in curves], y).where("found").collect()} if set(rest) - set(curves) else {}
    for c in rest:
        if len(out) >= max_insights:
            break
        if c in curves:
            out.append(("curve", c, f"{curves[c]['curve']} with turning point", float(curves[c]["vertex_x"]), float(curves[c]["r2_quad"])))
            seen.add(c)
        elif c in steps:
            out.append(("threshold", c, "step at threshold", float(steps[c]["threshold"]), float(steps[c]["delta"])))
            seen.add(c)
    if prescribe and len(out) < max_insights:
        from .causal import prescribe as prescribe_action

        act = prescribe_action(df.withColumn("_target", y), "_target", numeric, seen)
        if act:
            out.append(("prescription", act["column"], f"move by {act['delta']:.6g}", act["value"], act["ate"]))
            seen.add(act["column"])
    left = [c for c in numeric if c not in seen]
    if left and len(out) < max_insights:
        for r in linear_relations(df, left, y).orderBy(F.abs("r").desc(), "column").limit(max_insights - len(out)).collect():
            out.append(("linear", r["column"], "positive" if r["r"] > 0 else "negative", float(r["r"]), float(r["slope_sd"])))
    if not out:
        out.append(("none", target, "no relation passed the significance filters", None, None))
    rows = [(i + 1, *r, label) for i, r in enumerate(out[:max_insights])]
    return df.sparkSession.createDataFrame(rows, "rank int, kind string, column string, finding string, value double, effect double, positive_class string")
