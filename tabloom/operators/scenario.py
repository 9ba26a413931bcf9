"""Counterfactual search, actionable recourse and stress scenarios over whole tables.

``score`` is any function that adds a column ``p`` (probability of the wanted
class) to a table of features, so models and plain expressions both work.  A
:class:`RowScore` gives it as an expression of the features; a search then runs
inside each row, in one map stage, and no round shuffles anything.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import corr, finite, ident, let
from ..functions.hashing import normal
from ..functions.lineage import cut_lineage
from ..functions.linear import moments
from ..functions.quantiles import quantile_map

Score = Callable[[DataFrame], DataFrame]
# Preset shocks, matched against column names, and the noise level of each scenario.
SCENARIOS: dict[str, dict[str, float]] = {
    "SEVERE_RECESSION": {"income": -0.20, "savings": -0.35, "debt": 0.25, "unemployment": 0.50, "general_shock_std": 0.15},
    "INFLATION_SURGE": {"expenses": 0.25, "interest_rate": 0.40, "debt_service": 0.30, "general_shock_std": 0.10},
    "LIQUIDITY_CRUNCH": {"balance": -0.45, "credit_utilization": 0.35, "cash_ratio": -0.50, "general_shock_std": 0.12},
    "BLACK_SWAN_SHOCK": {"volatility_multiplier": 2.5, "general_shock_std": 0.30},
}
STEPS = [0.25, 0.5, 1.0, 1.5, 2.0, 3.0]
# Rounds of a search inside a row between two looks at which rows still move.
ROW_ROUNDS = 100


def feature_ranges(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """Standard deviation, minimum and maximum per feature."""
    s = df.agg(*[f(finite(c)).alias(f"{p}{i}") for i, c in enumerate(features) for f, p in ((F.stddev_pop, "s"), (F.min, "a"), (F.max, "b"))]).first()
    return {c: (float(s[f"s{i}"]) or 1.0, float(s[f"a{i}"]), float(s[f"b{i}"])) for i, c in enumerate(features)}


def _candidates(state: DataFrame, features: Sequence[str], moves: list[tuple[str, str, Column]]) -> DataFrame:
    """One row per (row, move): the move's feature replaced by its new value."""
    items = F.array(*[
        F.struct(F.lit(i).alias("move"), *[(new if c == f else ident(c).cast("double")).alias(c) for c in features]) for i, (_, f, new) in enumerate(moves)
    ])
    keep = [c for c in state.columns if c not in features]
    return state.select(*[ident(c) for c in keep], F.explode(items).alias("_m")).select(*[ident(c) for c in keep], "_m.*")


@dataclass(frozen=True)
class RowScore:
    """A score as a column expression of named features."""

    of: Callable[[Mapping[str, Column]], Column]
    features: Sequence[str]

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.withColumn("p", self.of({c: ident(c) for c in self.features}))


def _best(state: Column, cols: Sequence[str], moves: list[tuple[str, Callable[[Column], Column]]], score: RowScore, rank: Callable[[Column, Column, Column], Column]) -> Column:
    """The move of least ``rank(candidate, p, number)`` from ``state``: a struct with the features and ``p``."""
    options = F.array(*[F.struct(F.lit(i).alias("move"), *[(new(state[c]) if c == f else state[c]).alias(c) for c in cols]) for i, (f, new) in enumerate(moves)])
    scored = F.transform(options, lambda x: let(score.of({c: x[c] for c in cols}), lambda p: F.struct(rank(x, p, x["move"]).alias("rank"), *[x[c].alias(c) for c in cols], p.alias("p"))))
    return F.array_min(scored)


def _row_counterfactuals(start: DataFrame, cols: Sequence[str], key: str, score: RowScore, wanted: float, rng: dict, step: float) -> DataFrame:
    """The coordinate search inside each row, in runs of ``ROW_ROUNDS`` rounds, until no row moves any more.

    A row has ended when it reaches ``wanted`` or comes back to where it was: the place kept for that is renewed after
    1, 2, 4, 8 ... rounds, so a cycle of any length is noticed.
    """
    moves = []
    for c in cols:
        sd, lo, hi = rng[c]
        moves += [(c, lambda x, sd=sd, hi=hi: F.least(x + step * sd, F.lit(hi))), (c, lambda x, sd=sd, lo=lo: F.greatest(x - step * sd, F.lit(lo)))]

    def rank(x: Column, p: Column, move: Column) -> Column:
        dist = F.lit(0.0)
        for c in cols:
            dist = dist + F.pow((x[c] - ident(f"_o_{c}")) / rng[c][0], 2)
        hit = p >= wanted
        return F.struct((~hit).alias("miss"), F.when(hit, move.cast("double")).otherwise(1.0 - p + 0.05 * dist).alias("r"), move.alias("m"))

    def advance(s: Column, _: Column) -> Column:
        def moved(b: Column) -> Column:
            back = F.lit(True)
            for c in cols:
                back = back & (F.abs(b[c] - s["kept"][c]) <= 1e-9 * rng[c][0])
            renew = s["n"] + 1 >= s["due"]
            kept = F.struct(*[F.when(renew, b[c]).otherwise(s["kept"][c]).alias(c) for c in cols])
            return F.struct(*[b[c].alias(c) for c in cols], b["p"].alias("p"), kept.alias("kept"), (s["n"] + 1).alias("n"),
                            F.when(renew, s["due"] * 2).otherwise(s["due"]).alias("due"), back.alias("ended"))

        return F.when(s["ended"] | (s["p"] >= wanted), s).otherwise(let(_best(s, cols, moves, score, rank), moved))

    state = start.withColumn("_s", F.struct(*[ident(c).alias(c) for c in cols], F.col("p").cast("double").alias("p"), F.struct(*[ident(c).alias(c) for c in cols]).alias("kept"),
                                            F.lit(0).alias("n"), F.lit(1).alias("due"), F.lit(False).alias("ended"))).select(ident(key), *[ident(f"_o_{c}") for c in cols], "_s")
    done = None
    while True:
        state = cut_lineage(state.withColumn("_s", F.aggregate(F.sequence(F.lit(1), F.lit(ROW_ROUNDS)), F.col("_s"), advance)))
        over = F.col("_s.ended") | (F.col("_s.p") >= wanted) | F.col("_s.p").isNull()
        ended = state.where(over)
        done = ended if done is None else done.unionByName(ended)
        state = state.where(~over)
        if state.isEmpty():
            return done.select(ident(key), *[F.col("_s")[c].alias(c) for c in cols], *[ident(f"_o_{c}") for c in cols], F.col("_s.p").alias("p"), F.coalesce(F.col("_s.p") >= wanted, F.lit(False)).alias("found"))


def counterfactuals(
    rejected: DataFrame, reference: DataFrame, features: Sequence[str], key: str, score: Score, wanted: float = 0.5,
    step: float = 0.05, rounds: int = 200,
) -> DataFrame:
    """Coordinate search: every row moves one feature by ``step`` SD per round until p reaches ``wanted``.

    A round scores 2 x features candidates per row and keeps the first that flips, else the one with the lowest
    (1 - p) + .05 x squared distance. With a :class:`RowScore` the search runs inside the rows and ends when no row
    moves any more. An opaque score needs a table per round: all rows still below then advance together, for ``rounds``
    rounds at most. Rows with a missing feature have no score and aren't found.
    """
    cols = list(features)
    rng = feature_ranges(reference, cols)
    start = score(rejected.select(ident(key), *[finite(c).alias(c) for c in cols])).select(ident(key), *cols, "p")
    base = start.select(ident(key), *[ident(c).alias(c) for c in cols], *[ident(c).alias(f"_o_{c}") for c in cols], "p")
    if isinstance(score, RowScore):
        return _row_counterfactuals(base, cols, key, score, wanted, rng, step)
    state = cut_lineage(base)
    done = None
    for _ in range(rounds):
        reached, active = state.where(F.col("p") >= wanted), state.where(F.col("p") < wanted)
        done = reached if done is None else done.unionByName(reached)
        if active.isEmpty():
            state = active
            break
        moves = []
        for c in cols:
            sd, lo, hi = rng[c]
            moves += [("+", c, F.least(ident(c) + step * sd, F.lit(hi))), ("-", c, F.greatest(ident(c) - step * sd, F.lit(lo)))]
        cand = score(_candidates(active.drop("p"), cols, moves))
        dist = F.lit(0.0)
        for c in cols:
            dist = dist + F.pow((ident(c) - ident(f"_o_{c}")) / rng[c][0], 2)
        hit = F.col("p") >= wanted
        rank = F.struct((~hit).alias("miss"), F.when(hit, F.col("move").cast("double")).otherwise(1.0 - F.col("p") + 0.05 * dist).alias("r"), F.col("move").alias("m"))
        row = F.struct(*[ident(c) for c in cols], *[ident(f"_o_{c}") for c in cols], "p")
        state = cut_lineage(cand.groupBy(ident(key)).agg(F.min_by(row, rank).alias("b")).select(ident(key), "b.*"))
    out = done.withColumn("found", F.lit(True))
    return out.unionByName(state.withColumn("found", F.col("p") >= wanted))


def changes(found: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """``key, feature, original, proposed, delta, pct_change`` of every feature that moved."""
    items = F.array(*[F.struct(F.lit(c).alias("feature"), ident(f"_o_{c}").alias("original"), ident(c).alias("proposed")) for c in features])
    x = found.select(ident(key), F.explode(items).alias("e")).select(ident(key), "e.*").withColumn("delta", F.col("proposed") - F.col("original"))
    pct = F.when(F.abs("original") > 1e-4, 100.0 * F.col("delta") / F.abs("original")).otherwise(0.0)
    return x.where(F.abs("delta") > 1e-4).withColumn("pct_change", pct)


def spreads(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """Median absolute deviation (standard deviation when tiny) and the 1 % and 99 % bounds."""
    q = quantile_map(df, list(features), [0.01, 0.5, 0.99])
    away = df.select(*[F.abs(finite(c) - q[c][1]).alias(c) for c in features])
    mad = quantile_map(away, list(features), [0.5])
    sd = {c: v[0] for c, v in feature_ranges(df, features).items()}
    return {c: (mad[c][0] if mad[c][0] > 1e-4 else (sd[c] if sd[c] > 1e-4 else 1.0), q[c][0], q[c][2]) for c in features}


def recourse(
    rejected: DataFrame, reference: DataFrame, features: Sequence[str], key: str, score: Score, wanted: float = 0.55,
    immutable: Sequence[str] = (), directions: dict[str, str] | None = None,
) -> DataFrame:
    """Cheapest single-feature moves towards p >= ``wanted``, feature after feature, in MAD units.

    ``directions`` maps a feature to ``increasing`` or ``decreasing``.  Each
    round tries all ladder steps of all movable features: a row takes the
    cheapest move that suffices, else the one that helps most.
    """
    cols, directions = list(features), directions or {}
    s = spreads(reference, cols)
    start = score(rejected.select(ident(key), *[finite(c).alias(c) for c in cols])).select(ident(key), *cols, "p")
    state = cut_lineage(start.select(ident(key), *cols, *[ident(c).alias(f"_o_{c}") for c in cols], "p", F.col("p").alias("p_before")))
    movable = [c for c in cols if c not in set(immutable)]
    ladder: list[tuple[str, Callable[[Column, Column], Column]]] = []
    for c in movable:
        mad, lo, hi = s[c]
        for sign in {"increasing": [1], "decreasing": [-1]}.get(directions.get(c, ""), [1, -1]):
            for k in STEPS:
                def new(x: Column, o: Column, d=sign * k * mad, lo=lo, hi=hi, bound=(F.greatest if sign > 0 else F.least) if c in directions else None) -> Column:
                    y = F.least(F.greatest(x + d, F.lit(lo)), F.lit(hi))
                    return bound(y, o) if bound else y

                ladder.append((c, new))
    if isinstance(score, RowScore):
        def rank(x: Column, p: Column, move: Column) -> Column:
            cost = F.lit(0.0)
            for c in cols:
                cost = cost + F.abs(x[c] - ident(f"_o_{c}")) / s[c][0]
            hit = p >= wanted
            return F.struct((~hit).alias("miss"), F.when(hit, cost).otherwise(1.0 - p).alias("r"), move.alias("m"))

        stay = [(cols[0], lambda x: x)]
        own = stay + [(c, lambda x, c=c, new=new: new(x, ident(f"_o_{c}"))) for c, new in ladder]
        keep = lambda b: F.struct(*[b[c].alias(c) for c in cols], b["p"].alias("p"))
        first = F.struct(*[ident(c).alias(c) for c in cols], F.col("p").cast("double").alias("p"))
        last = F.aggregate(F.sequence(F.lit(1), F.lit(len(movable))), first, lambda st, _: F.when(st["p"] >= wanted, st).otherwise(let(_best(st, cols, own, score, rank), keep))) if movable else first
        rows = state.withColumn("_s", F.when(F.col("p").isNotNull(), last))
        state = rows.select(ident(key), *[F.coalesce(F.col("_s")[c], ident(c)).alias(c) for c in cols], *[ident(f"_o_{c}") for c in cols], F.col("_s.p").alias("p"), "p_before")
        movable = []
    done = None
    for _ in range(len(movable)):
        reached, active = state.where(F.col("p") >= wanted), state.where(F.col("p") < wanted)
        done = reached if done is None else done.unionByName(reached)
        state = active
        if active.isEmpty():
            break
        moves = [("stay", cols[0], ident(cols[0]).cast("double"))] + [("move", c, new(ident(c), ident(f"_o_{c}"))) for c, new in ladder]
        cand = score(_candidates(active.drop("p"), cols, moves))
        cost = F.lit(0.0)
        for c in cols:
            cost = cost + F.abs(ident(c) - ident(f"_o_{c}")) / s[c][0]
        hit = F.col("p") >= wanted
        rank = F.struct((~hit).alias("miss"), F.when(hit, cost).otherwise(1.0 - F.col("p")).alias("r"), F.col("move").alias("m"))
        row = F.struct(*[ident(c) for c in cols], *[ident(f"_o_{c}") for c in cols], "p", "p_before")
        state = cut_lineage(cand.groupBy(ident(key)).agg(F.min_by(row, rank).alias("b")).select(ident(key), "b.*"))
    out = done.unionByName(state) if done is not None else state
    total = F.lit(0.0)
    for c in cols:
        total = total + F.abs(ident(c) - ident(f"_o_{c}")) / s[c][0]
    moved = total > 1e-9
    verdict = F.when(F.col("p") >= wanted, "OPTIMAL_RECOURSE_FOUND").when(moved, "HIGH_COST_RECOURSE").otherwise("INFEASIBLE")
    return out.withColumn("cost", total).withColumn("feasibility", verdict)


def recourse_actions(found: DataFrame, reference: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """One row per proposed change with its cost in MAD units and difficulty."""
    s = spreads(reference, features)
    mad = F.create_map(*[x for c in features for x in (F.lit(c), F.lit(float(s[c][0])))])
    x = changes(found, key, features).where(F.abs("delta") > 1e-3).withColumn("cost", F.abs("delta") / mad[F.col("feature")])
    return x.withColumn("direction", F.when(F.col("delta") > 0, "INCREASE").otherwise("DECREASE")).withColumn(
        "difficulty", F.when(F.col("cost") < 0.8, "LOW").when(F.col("cost") < 2.0, "MEDIUM").otherwise("HIGH")
    )


# ---- stress ----


def noise_factor(df: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cholesky factor of the (positive-definite) correlation matrix and the standard deviations."""
    m = moments(df, features)
    std = m.std()
    std[std < 1e-6] = 1.0
    corr = np.nan_to_num(m.corr(), nan=0.0)
    np.fill_diagonal(corr, 1.0)
    lam, vec = np.linalg.eigh(corr)
    fixed = vec @ np.diag(np.maximum(lam, 1e-4)) @ vec.T
    np.fill_diagonal(fixed, 1.0)
    try:
        return np.linalg.cholesky(fixed), std
    except np.linalg.LinAlgError:
        return np.eye(len(std)), std


def _shock(column: str, shocks: dict[str, float]) -> float:
    return next((v for k, v in shocks.items() if k in column.lower()), 0.0)


def stress_replicates(
    df: DataFrame, features: Sequence[str], keys: Sequence[str], score: Score, replicates: int = 50, threshold: float = 0.5,
    custom: dict[str, float] | None = None, seed: int = 42,
) -> DataFrame:
    """``scenario, rep, adverse_rate, noise_<feature>``: shocked tables scored and averaged per replicate.

    Noise is a row-hash draw, so the result does not depend on partitioning;
    rows expand inside the scoring stage and only averages are shuffled.
    """
    cols = list(features)
    chol, std = noise_factor(df, cols)
    plans = dict(SCENARIOS)
    if custom:
        plans["CUSTOM_SHOCK_POLICY"] = custom
    items = F.array(*[
        F.struct(F.lit(n).alias("scenario"), F.lit(float(s.get("general_shock_std", 0.10))).alias("_g"), *[F.lit(1.0 + _shock(c, s)).alias(f"_f{i}") for i, c in enumerate(cols)])
        for n, s in plans.items()
    ])
    rows = df.dropna(subset=cols).select(*[ident(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[finite(c).alias(c) for c in cols])
    wide = rows.select("*", F.explode(items).alias("_s")).select(*rows.columns, "_s.*").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    ks = [f"_k{i}" for i in range(len(keys))]
    z = wide.withColumns({f"_z{i}": normal(*ks, "scenario", "rep", F.lit(i), seed=seed) for i in range(len(cols))})
    noise = {}
    for i in range(len(cols)):
        e = F.lit(0.0)
        for j in range(i + 1):
            if abs(chol[i, j]) > 0:
                e = e + float(chol[i, j]) * F.col(f"_z{j}")
        noise[f"_n{i}"] = e * F.col("_g")
    z = z.withColumns(noise)
    shocked = z.withColumns({c: ident(c) * F.col(f"_f{i}") + F.col(f"_n{i}") * float(std[i]) for i, c in enumerate(cols)})
    return score(shocked).groupBy("scenario", "rep").agg(
        F.avg((F.col("p") >= threshold).cast("double")).alias("adverse_rate"), *[F.avg(f"_n{i}").alias(f"noise_{c}") for i, c in enumerate(cols)]
    )


def stress_report(reps: DataFrame, baseline: float) -> DataFrame:
    """Mean stressed rate, VaR, CVaR, survival share and grade per scenario (replicates are few)."""
    q = F.percentile("adverse_rate", F.array(F.lit(0.95), F.lit(0.99)))
    s = reps.groupBy("scenario").agg(F.count("*").alias("replicates"), F.avg("adverse_rate").alias("stressed_rate"), q.alias("q"),
                                     F.avg((F.col("adverse_rate") <= max(baseline * 1.75, 0.40)).cast("double")).alias("survival"))
    tail = reps.join(F.broadcast(s.select("scenario", F.col("q")[0].alias("v"))), "scenario").where(F.col("adverse_rate") >= F.col("v"))
    cvar = tail.groupBy("scenario").agg(F.avg("adverse_rate").alias("cvar_95"))
    x = s.join(F.broadcast(cvar), "scenario").withColumn("baseline_rate", F.lit(float(baseline))).withColumn("rate_delta", F.col("stressed_rate") - F.col("baseline_rate"))
    d, v = F.col("rate_delta"), F.col("survival")
    grade = F.when((d <= 0.05) & (v >= 0.95), "AAA").when((d <= 0.15) & (v >= 0.80), "BBB").when((d <= 0.30) & (v >= 0.60), "CCC").otherwise("VULNERABLE")
    return x.select("scenario", "replicates", "baseline_rate", "stressed_rate", "rate_delta", F.col("q")[0].alias("var_95"), F.col("q")[1].alias("var_99"),
                    "cvar_95", "survival", grade.alias("grade"))


def overall_grade(report: DataFrame) -> DataFrame:
    """The worst scenario grade."""
    order = F.when(F.col("grade") == "VULNERABLE", 3).when(F.col("grade") == "CCC", 2).when(F.col("grade") == "BBB", 1).otherwise(0)
    return report.agg(F.max_by("grade", order).alias("grade"), F.max("rate_delta").alias("worst_delta"), F.max("cvar_95").alias("worst_cvar"))


def risk_drivers(reps: DataFrame, report: DataFrame, features: Sequence[str], top: int = 4) -> DataFrame:
    """Sensitivity |rate change| x (1 + |corr(noise, rate)|) of each feature, the largest ``top`` per scenario."""
    from pyspark.sql import Window as W

    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"noise_{c}").alias("x")) for c in features])
    s = reps.select("scenario", "adverse_rate", F.explode(items).alias("e")).select("scenario", "adverse_rate", "e.*").groupBy("scenario", "feature").agg(
        corr("x", "adverse_rate").alias("r"), F.var_pop("adverse_rate").alias("vr"), F.var_pop("x").alias("vx")
    )
    term = F.when((F.col("vr") > 1e-6) & (F.col("vx") > 1e-6), F.coalesce(F.nanvl(F.abs("r"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0)
    x = s.join(F.broadcast(report.select("scenario", "rate_delta")), "scenario").withColumn("sensitivity", F.abs("rate_delta") * (1.0 + term))
    w = W.partitionBy("scenario").orderBy(F.col("sensitivity").desc(), "feature")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("scenario", "rank", "feature", "sensitivity")
