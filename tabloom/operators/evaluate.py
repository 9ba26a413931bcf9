"""Evaluation, decision and governance metrics over scored tables.

A scored table has a label column and a prediction or probability column; every
metric is an aggregate over it or over its counts per distinct score.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import finite, ident, present, ratio
from ..functions.cuts import MAX_CUTS, position
from ..functions.lineage import cut_lineage
from ..functions.ordering import running_totals
from ..functions.quantiles import quantile_map

#: Rows of a grid cell's block and parts of an axis at most in the skyline, points of a strip or slab in the hypervolume.
CELL_ROWS, GRID_PARTS, SWEEP_ROWS = 2048, 64, 20_000


def confusion(df: DataFrame, label: str, pred: str, times: str | None = None) -> DataFrame:
    """``actual, predicted, n``; a row of ``df`` stands for ``times`` rows."""
    n = F.sum(times) if times else F.count("*")
    return df.groupBy(ident(label).alias("actual"), ident(pred).alias("predicted")).agg(n.alias("n"))


def classification_metrics(df: DataFrame, label: str, pred: str, times: str | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1: binary for two classes (larger one positive), else macro averages."""
    cells = confusion(df, label, pred, times).where("actual is not null and predicted is not null")
    rows = cells.select(F.explode(F.array(
        F.struct(F.col("actual").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("predicted").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"),
                 F.lit(0).cast("long").alias("hit")),
    )).alias("e")).select("e.*")
    per = rows.groupBy("cls").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))
    p, r = F.coalesce(ratio(F.col("hit"), F.col("called")), F.lit(0.0)), F.coalesce(ratio(F.col("hit"), F.col("support")), F.lit(0.0))
    per = per.withColumn("p", p).withColumn("r", r).withColumn(
        "f", F.coalesce(F.try_divide(2.0 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    )
    s = per.agg(
        F.sum("support").alias("rows"), F.count("*").alias("classes"), F.count(F.when(F.col("support") > 0, 1)).alias("_true"),
        (F.sum("hit") / F.sum("support")).alias("accuracy"), F.max(F.struct("cls", "p", "r", "f")).alias("top"),
        F.avg("p").alias("mp"), F.avg("r").alias("mr"), F.avg("f").alias("mf"),
    )
    two = F.col("_true") == 2
    return s.select(
        "rows", "accuracy", F.when(two, F.col("top.p")).otherwise(F.col("mp")).alias("precision"),
        F.when(two, F.col("top.r")).otherwise(F.col("mr")).alias("recall"), F.when(two, F.col("top.f")).otherwise(F.col("mf")).alias("f1"),
    )


def score_counts(df: DataFrame, label: str, prob: str, positive=1, by: Sequence[str] = (), times: str | None = None) -> DataFrame:
    """``by..., s, pos, neg`` per distinct score ``s`` = -probability (so ascending means most likely first)."""
    y, n = (ident(label) == F.lit(positive)).cast("long"), ident(times) if times else F.lit(1)
    rows = df.select(*by, (-finite(prob)).alias("s"), y.alias("y"), n.alias("n")).where("s is not null and y is not null")
    return rows.groupBy(*by, "s").agg(F.sum(F.col("n") * F.col("y")).alias("pos"), F.sum(F.col("n") * (1 - F.col("y"))).alias("neg"))


def ranking_metrics(df: DataFrame, label: str, prob: str, positive=1, times: str | None = None) -> DataFrame:
    """Exact ROC-AUC (ties count half) and average precision of a binary score."""
    # the totals read the counts several times, and the rows behind them may be dear to score
    counts = cut_lineage(score_counts(df, label, prob, positive, times=times))
    run = running_totals(counts, "s", ["pos", "neg"])
    ahead = F.col("cum_neg") - F.col("neg")
    s = run.agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"),
        F.sum(F.col("pos").cast("double") * (ahead + F.col("neg") / 2.0)).alias("worse"),
        F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("ap"),
    )
    return s.select(
        (F.col("p") + F.col("n")).alias("rows"), (1.0 - ratio(F.col("worse"), F.col("p").cast("double") * F.col("n"))).alias("roc_auc"),
        ratio(F.col("ap"), F.col("p")).alias("pr_auc"),
    )


def multiclass_auc(df: DataFrame, label: str, probs: str, classes: Sequence) -> DataFrame:
    """Macro one-versus-rest ROC-AUC from an array of class probabilities, all classes in one pass."""
    y = ident(label)
    entries = F.array(*[
        F.struct(F.lit(str(c)).alias("cls"), (-ident(probs)[i]).alias("s"), (y == F.lit(c)).cast("long").alias("y")) for i, c in enumerate(classes)
    ])
    rows = df.select(F.explode(entries).alias("e")).select("e.*").where("y is not null")
    counts = rows.groupBy("cls", "s").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    run = running_totals(counts, "s", ["pos", "neg"], by=["cls"])
    worse = F.sum(F.col("pos").cast("double") * (F.col("cum_neg") - F.col("neg") / 2.0))
    per = run.groupBy("cls").agg((1.0 - ratio(worse, F.sum("pos").cast("double") * F.sum("neg"))).alias("auc"))
    return per.agg(F.count("*").alias("classes"), F.avg("auc").alias("roc_auc"))


def brier(df: DataFrame, label: str, prob: str, positive=1) -> DataFrame:
    y = (ident(label) == F.lit(positive)).cast("double")
    return df.agg(F.count("*").alias("rows"), F.avg(F.pow(finite(prob) - y, 2)).alias("brier"))


def multiclass_brier(df: DataFrame, label: str, probs: str, classes: Sequence) -> DataFrame:
    parts = None
    for i, c in enumerate(classes):
        d = F.pow(ident(probs)[i] - (ident(label) == F.lit(c)).cast("double"), 2)
        parts = d if parts is None else parts + d
    return df.agg(F.count("*").alias("rows"), F.avg(parts).alias("brier"))


def regression_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    y, p = finite(label), finite(pred)
    rows = df.select(y.alias("y"), (y - p).alias("e")).where("e is not null")
    return rows.agg(
        F.count("*").alias("rows"), F.avg(F.abs("e")).alias("mae"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"),
        (1.0 - ratio(F.avg(F.col("e") * F.col("e")), F.var_pop("y"))).alias("r2"),
    )


def roc_curve(df: DataFrame, label: str, prob: str, positive=1, points: int = 50) -> DataFrame:
    """``threshold, fpr, tpr`` from (inf, 0, 0) on, thinned to every k-th distinct threshold (about ``points``)."""
    counts = score_counts(df, label, prob, positive).withColumn("one", F.lit(1).cast("long"))
    size = counts.agg(F.count("*").alias("k"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    step = max(1, (size["k"] + 1) // points)
    run = running_totals(counts, "s", ["pos", "neg", "one"]).where(F.col("cum_one") % step == 0)
    start = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return start.unionByName(run.select(
        (-F.col("s")).alias("threshold"), (F.col("cum_neg") / F.lit(float(size["n"] or 1))).alias("fpr"),
        (F.col("cum_pos") / F.lit(float(size["p"] or 1))).alias("tpr"),
    ))


def calibration_curve(df: DataFrame, label: str, prob: str, positive=1, bins: int = 10) -> DataFrame:
    """Mean probability and positive rate per uniform bin; edge values fall in the lower bin."""
    y = (ident(label) == F.lit(positive)).cast("double")
    b = F.greatest(F.ceil(finite(prob) * bins) - 1, F.lit(0)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(finite(prob)).alias("prob_pred"), F.avg(y).alias("prob_true"))


def roi(df: DataFrame, label: str, pred: str, cost_fp: float, cost_fn: float, val_tp: float, val_tn: float) -> DataFrame:
    """Net value of binary decisions against the baseline of calling everything negative."""
    y, p = ident(label) == 1, ident(pred) == 1
    s = df.agg(
        F.count(F.when(y & p, 1)).alias("tp"), F.count(F.when(~y & p, 1)).alias("fp"),
        F.count(F.when(~y & ~p, 1)).alias("tn"), F.count(F.when(y & ~p, 1)).alias("fn"),
    )
    cost = F.col("fp") * float(cost_fp) + F.col("fn") * float(cost_fn)
    value = F.col("tp") * float(val_tp) + F.col("tn") * float(val_tn)
    base = (F.col("tn") + F.col("fp")) * float(val_tn) - (F.col("tp") + F.col("fn")) * float(cost_fn)
    return s.select("tp", "fp", "tn", "fn", cost.alias("total_cost"), value.alias("total_value"), (value - cost).alias("net_roi"),
                    base.alias("baseline_roi"), (value - cost - base).alias("model_savings"))


def error_cost(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Total and mean absolute error and the error margin relative to the mean target."""
    s = df.agg(F.count("*").alias("rows"), F.sum(F.abs(finite(label) - finite(pred))).alias("total_error"),
               F.avg(F.abs(finite(label) - finite(pred))).alias("mae"), F.avg(finite(label)).alias("_mean"))
    return s.select("rows", "total_error", "mae", F.coalesce(100.0 * ratio(F.col("mae"), F.col("_mean")), F.lit(0.0)).alias("error_margin_pct"))


def _sweep_counts(df: DataFrame, label: str, prob: str, thresholds: Sequence[float], group: str | None) -> DataFrame:
    """``g, threshold, tp, fp, pos, neg`` per threshold from one histogram of the scores."""
    y = (ident(label) == 1).cast("long")
    g = ident(group).cast("string") if group else F.lit("all")
    hist = df.where(present(df, prob) & present(df, label)).groupBy(g.alias("g"), position(finite(prob), [float(x) for x in thresholds], inclusive=True).alias("k")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")
    )
    cuts = F.array(*[F.lit(float(t)) for t in thresholds])
    wide = hist.select("g", "k", "pos", "neg", F.posexplode(cuts).alias("i", "threshold"))
    hit = F.col("k") > F.col("i")
    return wide.groupBy("g", "threshold").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
    )


def profit_curve(
    df: DataFrame, label: str, prob: str, cost_fp: float, cost_fn: float, val_tp: float, val_tn: float,
    thresholds: Sequence[float] | None = None,
) -> DataFrame:
    """Expected profit at 19 thresholds from .05 to .95, with the best one marked (lowest on ties)."""
    t = list(np.linspace(0.05, 0.95, 19) if thresholds is None else thresholds)
    c = _sweep_counts(df, label, prob, t, None)
    profit = (
        F.col("tp") * float(val_tp) + (F.col("neg") - F.col("fp")) * float(val_tn) - F.col("fp") * float(cost_fp)
        - (F.col("pos") - F.col("tp")) * float(cost_fn)
    )
    w = W.orderBy(F.col("profit").desc(), F.col("threshold"))
    return c.select("threshold", profit.alias("profit")).withColumn("best", F.row_number().over(w) == 1)


def threshold_sweep(
    df: DataFrame, label: str, prob: str, group: str | None = None, cost_fp: float = 20.0, cost_fn: float = 150.0,
    val_tp: float = 100.0, val_tn: float = 0.0, steps: int = 80,
) -> DataFrame:
    """Profit, miss rate and demographic parity ratio at ``steps`` thresholds from .01 to .99."""
    c = _sweep_counts(df, label, prob, list(np.linspace(0.01, 0.99, steps)), group)
    rate = (F.col("tp") + F.col("fp")) / (F.col("pos") + F.col("neg"))
    s = c.withColumn("rate", rate).groupBy("threshold").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
        F.count("*").alias("groups"), F.min("rate").alias("lo"), F.max("rate").alias("hi"),
    )
    fn, tn = F.col("pos") - F.col("tp"), F.col("neg") - F.col("fp")
    whole = F.col("pos") + F.col("neg")
    parity = F.when(F.col("groups") > 1, F.col("lo") / (F.col("hi") + 1e-6)).otherwise(
        1.0 - F.abs((F.col("tp") + F.col("fp")) / whole - F.col("pos") / whole)
    )
    return s.select(
        "threshold", (F.col("tp") * val_tp + tn * val_tn - F.col("fp") * cost_fp - fn * cost_fn).alias("profit"),
        F.coalesce(ratio(fn, F.col("pos")), F.lit(0.0)).alias("risk"), F.least(F.greatest(parity, F.lit(0.0)), F.lit(1.0)).alias("fairness"),
    )


def _beaten(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of ``a`` dominated by some row of ``b`` (all columns: larger is better)."""
    out = np.zeros(len(a), dtype=bool)
    for lo in range(0, len(a), 512):
        part = a[lo: lo + 512, None, :]
        out[lo: lo + 512] = ((b[None] >= part).all(2) & (b[None] > part).any(2)).any(1)
    return out


def skyline(df: DataFrame, profit: str, risk: str, fairness: str, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Rows no other row dominates (profit and fairness high, risk low); equal rows all stay, as do rows with a gap.

    Each task first drops rows beaten inside its own batches. The rest fall into grid cells cut at quantiles of the
    three measures. A cell that lies below another one on every axis goes whole; the others are compared, in blocks of
    about ``cell_rows`` rows, with the cells at or above them. Only cuts and counts reach the driver.
    """
    names, schema = [profit, risk, fairness], df.schema

    def better(pdf: pd.DataFrame) -> np.ndarray:
        m = pdf[names].to_numpy(dtype=float)
        m[:, 1] = -m[:, 1]
        return m

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = better(pdf)
            keep = np.argsort(-m.sum(1), kind="stable")
            chosen = pdf.iloc[keep]
            m = m[keep]
            ahead = ~_beaten(m, m[:1024])
            yield chosen[ahead][~_beaten(m[ahead], m[ahead])]

    axes = [F.col("x"), F.col("y"), F.col("z")]
    left = df.mapInPandas(local, schema).withColumn("_row", F.monotonically_increasing_id())
    left = cut_lineage(left)
    points = left.select("_row", finite(profit).alias("x"), (-finite(risk)).alias("y"), finite(fairness).alias("z")).where("x is not null and y is not null and z is not null")
    n = points.count()
    # a frontier is a surface, so its rows lie in about parts x parts cells
    parts = min(GRID_PARTS, max(1, math.ceil(math.sqrt(n / cell_rows))))
    cuts = points.agg(*[F.percentile_approx(c, [i / parts for i in range(1, parts)], 100 * parts) for c in axes]).first() if parts > 1 else [[]] * 3
    placed = points.select("*", *[position(c, sorted(set(own or [])), inclusive=True).alias(f"c{i}") for i, (c, own) in enumerate(zip(axes, cuts))])
    cell = ["c0", "c1", "c2"]
    cells = cut_lineage(placed.groupBy(*cell).agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("blocks")))
    other = cells.select(*[F.col(c).alias(f"o{c}") for c in cell], F.col("blocks").alias("oblocks"))
    above = lambda op: op("c0") & op("c1") & op("c2")
    live = cut_lineage(cells.join(other, above(lambda c: F.col(c) < F.col(f"o{c}")), "left_anti"))
    split = placed.join(live, cell).withColumn("block", F.pmod(F.xxhash64("_row"), "blocks").cast("int"))
    packed = cut_lineage(split.groupBy(*cell, "block").agg(*[F.collect_list(c).alias(c) for c in ("_row", "x", "y", "z")]))
    rivals = live.select(*[F.col(c).alias(f"o{c}") for c in cell], F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("oblock"))
    # a dead cell beats nothing that the cell above it doesn't beat
    pairs = live.drop("blocks").join(rivals, above(lambda c: F.col(c) <= F.col(f"o{c}")))
    theirs = packed.select(*[F.col(c).alias(f"o{c}") for c in (*cell, "block")], *[F.col(c).alias(f"o{c}") for c in ("x", "y", "z")])
    met = pairs.join(theirs, [f"o{c}" for c in (*cell, "block")]).join(packed, cell).select("_row", "x", "y", "z", "ox", "oy", "oz")

    def beaten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                down = _beaten(np.stack([r[1], r[2], r[3]], axis=1), np.stack([r[4], r[5], r[6]], axis=1))
                yield pd.DataFrame({"gone": np.asarray(r[0])[down]})

    gone = met.mapInPandas(beaten, "gone long").distinct()
    dead = placed.join(live, cell, "left_anti").select(F.col("_row").alias("gone"))
    return left.join(gone.unionByName(dead), F.col("_row") == F.col("gone"), "left_anti").drop("_row")


def knee(df: DataFrame, frontier: DataFrame, profit: str, risk: str, fairness: str, name: str, weights=(0.4, 0.3, 0.3)) -> DataFrame:
    """Frontier with the distance to the ideal point and a role: knee, extreme points or plain optimal."""
    aggs = []
    for k, c in (("p", profit), ("r", risk), ("f", fairness)):
        aggs += [F.min(ident(c)).alias(f"{k}0"), F.max(ident(c)).alias(f"{k}1")]
    s = df.agg(*aggs).first()
    w = np.asarray(weights, dtype=float) / max(1e-6, sum(weights))
    span = lambda k: max(1e-6, float(s[f"{k}1"]) - float(s[f"{k}0"]))
    np_, nr, nf = ((ident(c) - float(s[f"{k}0"])) / span(k) for k, c in (("p", profit), ("r", risk), ("f", fairness)))
    dist = F.sqrt(float(w[0]) * (1.0 - np_) * (1.0 - np_) + float(w[1]) * nr * nr + float(w[2]) * (1.0 - nf) * (1.0 - nf))
    x = frontier.withColumn("distance", dist)
    pick = x.agg(
        F.min(F.struct("distance", ident(name).alias("n"))).alias("knee"), F.min(F.struct((-ident(profit)).alias("v"), ident(name).alias("n"))).alias("p"),
        F.min(F.struct(ident(risk).alias("v"), ident(name).alias("n"))).alias("r"), F.min(F.struct((-ident(fairness)).alias("v"), ident(name).alias("n"))).alias("f"),
    ).first()
    if pick["knee"] is None:
        return x.withColumn("role", F.lit("PARETO_OPTIMAL"))
    n = ident(name)
    role = (
        F.when(n == pick["knee"]["n"], "BALANCED_KNEE").when(n == pick["p"]["n"], "MAX_PROFIT").when(n == pick["r"]["n"], "MIN_RISK")
        .when(n == pick["f"]["n"], "MAX_FAIRNESS").otherwise("PARETO_OPTIMAL")
    )
    return x.withColumn("role", role)


def _swept(u: np.ndarray, v: np.ndarray, w: np.ndarray, low_u: float, low_w: float) -> float:
    """Volume of boxes over a cell: levels from the top down, with the staircase of the points met so far."""
    us, vs, area, volume, level = [], [], 0.0, 0.0, None
    for i in np.argsort(-w, kind="stable"):
        x, y = u[i], v[i]
        if level is not None:
            volume += area * (level - w[i])
        level = w[i]
        right = bisect_left(us, x)
        if right < len(us) and vs[right] >= y:
            continue
        # steps that the new point covers give way to it; the last of them may reach beyond it
        first = right
        while first and vs[first - 1] <= y:
            first -= 1
        stop = right + (right < len(us) and us[right] == x)
        start = us[first - 1] if first else low_u
        ends = [start, *us[first:right], x]
        heights = [*vs[first:right], vs[right] if right < len(us) else 0.0]
        area += y * (x - start) - sum((b - a) * h for a, b, h in zip(ends, ends[1:], heights))
        us[first:stop], vs[first:stop] = [x], [y]
    return volume + area * (level - low_w) if level is not None else 0.0


def _stairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the points that no other point covers in both coordinates."""
    order = np.lexsort((-b, -a))
    best = np.maximum.accumulate(np.concatenate([[-np.inf], b[order][:-1]]))
    return order[b[order] > best]


def hypervolume(points: DataFrame, profit: str, risk: str, fairness: str, nadir: tuple[float, float, float], cell_rows: int = SWEEP_ROWS) -> DataFrame:
    """Volume of the union of boxes between the points and the nadir.

    Profit is cut into strips and fairness into slabs of about ``cell_rows`` points each, and every cell of the two is
    swept by itself. Points beyond a cell reach over it whole: what lies further along one axis comes as a staircase of
    its strip or slab, which merges with others, and what lies further along both as one number. Passing the frontier
    saves work; dominated points change nothing.
    """
    u, v, w = ident(profit) - nadir[0], nadir[1] - ident(risk), ident(fairness) - nadir[2]
    box = cut_lineage(points.select(u.cast("double").alias("u"), v.cast("double").alias("v"), w.cast("double").alias("w")).where("u > 0 and v > 0 and w > 0").distinct())
    n = box.count()
    parts = min(MAX_CUTS, max(1, math.ceil(n / cell_rows)))
    ends = box.agg(F.max("u"), F.max("w"), *[F.percentile_approx(c, [i / parts for i in range(1, parts)], 20 * parts) for c in ("u", "w") if parts > 1]).first()
    cuts = [sorted(set(ends[2 + i] or [])) if parts > 1 else [] for i in (0, 1)]
    edges = [F.array(*[F.lit(float(x)) for x in (0.0, *own, top or 0.0)]) for own, top in zip(cuts, ends)]
    placed = box.select("*", position(F.col("u"), cuts[0], inclusive=True).alias("i"), position(F.col("w"), cuts[1], inclusive=True).alias("j"))

    def stairs(by: str, keep: tuple[str, str]):
        def run(table: pa.Table) -> pa.Table:
            return table.take(pa.array(_stairs(*[table[c].to_numpy() for c in keep])))

        return placed.groupBy("i", "j").applyInArrow(run, placed.schema).where(f"{by} > 0")

    lower = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    aside = stairs("i", ("v", "w")).withColumn("i", lower("i")).withColumn("u", F.get(edges[0], F.col("i") + 1))
    over = stairs("j", ("u", "v")).withColumn("j", lower("j")).withColumn("w", F.get(edges[1], F.col("j") + 1))
    tops = placed.where("i > 0 and j > 0").groupBy("i", "j").agg(F.max("v").alias("v"))
    tops = tops.withColumn("j", lower("j")).groupBy("i", "j").agg(F.max("v").alias("v"))
    tops = tops.withColumn("i", lower("i")).groupBy("i", "j").agg(F.max("v").alias("v"))
    corner = tops.select(F.get(edges[0], F.col("i") + 1).alias("u"), "v", F.get(edges[1], F.col("j") + 1).alias("w"), "i", "j")
    low = [[0.0, *own] for own in cuts]

    def sweep(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        return pa.table({"volume": [_swept(*[table[c].to_numpy() for c in ("u", "v", "w")], low[0][i], low[1][j])]})

    cells = placed if parts == 1 else placed.unionByName(aside).unionByName(over).unionByName(corner)
    return cells.groupBy("i", "j").applyInArrow(sweep, "volume double").agg(F.coalesce(F.sum("volume"), F.lit(0.0)).alias("hypervolume"))


def group_accuracy(df: DataFrame, label: str, pred: str, columns: Sequence[str]) -> DataFrame:
    """Accuracy per group of each column, for groups above max(10, 5 %); alert when 15 points below overall."""
    hit = (ident(label) == ident(pred)).cast("double")
    entries = F.array(*[F.struct(F.lit(c).alias("column"), ident(c).cast("string").alias("grp")) for c in columns])
    per = df.select(hit.alias("hit"), F.explode(entries).alias("e")).select("hit", "e.*").where("grp is not null").groupBy("column", "grp").agg(
        F.count("*").alias("n"), F.avg("hit").alias("accuracy")
    )
    s = df.select(hit.alias("hit")).agg(F.avg("hit").alias("a"), F.count("*").alias("n"))
    overall, rows = s.select("a").scalar(), s.select("n").scalar()
    big = per.where(F.col("n") > F.greatest(F.lit(10.0), 0.05 * rows))
    # at most 19 groups per column can exceed 5 % of the rows, so the windows and joins below are tiny
    several = big.groupBy("column").agg(F.count("*").alias("_k")).where("_k > 1").drop("_k")
    return big.join(F.broadcast(several), "column").withColumn("overall", overall).withColumn(
        "alert", F.col("overall") - F.col("accuracy") > 0.15
    )


def uncertain_rows(df: DataFrame, probs: str, keys: Sequence[str], n: int = 10) -> DataFrame:
    """The ``n`` rows with the smallest margin between the two likeliest classes."""
    top = F.sort_array(ident(probs), asc=False)
    score = F.when(F.size(ident(probs)) > 1, 1.0 - (top[0] - top[1])).otherwise(1.0 - F.abs(top[0] - 0.5) * 2.0)
    best = F.array_max(F.transform(ident(probs), lambda p, i: F.struct(p.alias("p"), (-i).alias("i"))))
    out = df.select(*[ident(k) for k in keys], (-best["i"]).alias("predicted"), score.alias("uncertainty"))
    return out.orderBy(F.col("uncertainty").desc(), *[ident(k) for k in keys]).limit(n)


# ---- split conformal ----


def conformal_threshold(calibration: DataFrame, score: str, alpha: float = 0.10) -> float:
    """The score quantile at level min(ceil((n+1)(1-alpha))/n, 1)."""
    s = calibration.select(finite(score).alias("score")).where("score is not null")
    n = s.count()
    if n == 0:
        return 0.5
    level = min(float(np.ceil((n + 1) * (1.0 - alpha))) / n, 1.0)
    return quantile_map(s, ["score"], [level])["score"][0]


def class_score(label: str, probs: str, classes: Sequence) -> Column:
    """1 - probability of the true class (first class for an unknown label)."""
    out = ident(probs)[0]
    for i, c in enumerate(classes):
        out = F.when(ident(label) == F.lit(c), ident(probs)[i]).otherwise(out)
    return 1.0 - out


def residual_score(label: str, pred: str) -> Column:
    return F.abs(finite(label) - finite(pred))


def center_spread(calibration: DataFrame, features: Sequence[str]) -> tuple[list[float], list[float]]:
    x = [F.coalesce(finite(c), F.lit(0.0)) for c in features]
    s = calibration.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(x)]).first()
    k = range(len(x))
    return [float(s[f"m{i}"]) for i in k], [float(s[f"s{i}"]) if s[f"s{i}"] >= 1e-4 else 1.0 for i in k]


def distance_to_center(features: Sequence[str], mean: Sequence[float], std: Sequence[float]) -> Column:
    z = None
    for c, m, s in zip(features, mean, std):
        d = F.pow((F.coalesce(finite(c), F.lit(0.0)) - m) / s, 2)
        z = d if z is None else z + d
    return F.sqrt(z / float(len(features))) if z is not None else F.lit(0.0)


def conformal_sets(df: DataFrame, probs: str, classes: Sequence, q_hat: float, distance: Column, ood: float = 2.75) -> DataFrame:
    """Adds ``conformal_set, entropy, distance, verdict, needs_review`` to a table with class probabilities."""
    p = ident(probs)
    names = F.array(*[F.lit(c) for c in classes])
    inside = F.filter(F.arrays_zip(names.alias("c"), p.alias("p")), lambda z: 1.0 - z["p"] <= F.lit(q_hat))
    best = F.array_max(F.transform(p, lambda x, i: F.struct(x.alias("p"), (-i).alias("i"))))
    likeliest = F.get(names, -best["i"])
    chosen = F.when(F.size(inside) > 0, F.transform(inside, lambda z: z["c"])).otherwise(F.array(likeliest))
    entropy = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 1e-6, x * F.log2(x)).otherwise(0.0))
    out = df.withColumn("predicted", likeliest).withColumn("conformal_set", chosen).withColumn("entropy", entropy).withColumn("distance", distance)
    far = F.col("distance") > ood
    verdict = F.when(far, "EPISTEMIC_OOD_FLAG").when((F.size("conformal_set") > 1) | (F.col("entropy") > 0.85), "ALEATORIC_NOISE").otherwise("HIGH_CONFIDENCE")
    return out.withColumn("verdict", verdict).withColumn("needs_review", far)


def conformal_intervals(df: DataFrame, pred: str, q_hat: float, distance: Column, ood: float = 2.75) -> DataFrame:
    out = df.withColumn("lower", finite(pred) - q_hat).withColumn("upper", finite(pred) + q_hat).withColumn("distance", distance)
    far = F.col("distance") > ood
    return out.withColumn("verdict", F.when(far, "EPISTEMIC_OOD_FLAG").otherwise("HIGH_CONFIDENCE")).withColumn("needs_review", far)


def conformal_report(evaluated: DataFrame, label: str, q_hat: float, alpha: float = 0.10) -> DataFrame:
    """Coverage, mean set size (or width) and the share of far-off rows."""
    sets = "conformal_set" in evaluated.columns
    inside = F.array_contains("conformal_set", ident(label)) if sets else finite(label).between(F.col("lower"), F.col("upper"))
    size = F.size("conformal_set").cast("double") if sets else F.col("upper") - F.col("lower")
    return evaluated.agg(
        F.count("*").alias("rows"), F.lit(float(alpha)).alias("alpha"), F.lit(float(q_hat)).alias("q_hat"), F.avg(inside.cast("double")).alias("coverage"),
        F.avg(size).alias("mean_size"), F.sum(F.col("needs_review").cast("long")).alias("ood_rows"),
        (100.0 * F.avg(F.col("needs_review").cast("double"))).alias("ood_pct"),
    )
