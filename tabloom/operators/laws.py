"""Linear conservation laws: discovery, audit, projection, simplex and monotone fits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, ident, let, numeric_columns
from ..functions.lineage import cut_lineage
from ..functions.ordering import running_totals
from ..functions.skew import join_hot_keys

SINGULAR = 1e-4
TOLERANCE = 1e-6
#: Different x of a part that one task pools, and thresholds of a larger part at a time besides its mean.
POOL_ROWS, CUTS = 100_000, 7


@dataclass
class Law:
    """sum of coefficient x column = total, within tolerance."""

    name: str
    coefficients: dict[str, float]
    total: float = 0.0
    tolerance: float = TOLERANCE
    variance_explained: float = 1.0

    def residual(self) -> Column:
        out = F.lit(-float(self.total))
        for c, k in self.coefficients.items():
            out = out + F.lit(float(k)) * F.coalesce(finite(c), F.lit(0.0))
        return out


def _tidy(v: float) -> float:
    """Snap a coefficient to an integer, two or four decimals when it is that close."""
    v = round(v, 6)
    for digits, tol in ((0, 1e-4), (2, 1e-4), (4, 1e-5)):
        if abs(v - round(v, digits)) < tol:
            return float(round(v, digits))
    return v


def _echelon(a: np.ndarray, tol: float = 1e-9) -> np.ndarray:
    """Reduced row echelon form: one sparse relation per row."""
    a, row = a.astype(float).copy(), 0
    for col in range(a.shape[1]):
        if row == len(a):
            break
        best = row + int(np.abs(a[row:, col]).argmax())
        if abs(a[best, col]) < tol:
            continue
        a[[row, best]] = a[[best, row]]
        a[row] /= a[row, col]
        others = np.arange(len(a)) != row
        a[others] -= np.outer(a[others, col], a[row])
        row += 1
    return a


def discover(df: DataFrame, columns: Sequence[str] | None = None, max_features: int | None = None, r2: float = 0.9999) -> list[Law]:
    """Exact linear relations among the numeric columns (the ``max_features`` of highest variance if given).

    Pass one: norms and variances.  Pass two: the Gram matrix of unit-norm
    columns plus a constant (JVM tree aggregation), whose null space holds the
    candidates.  Pass three checks every candidate on the rows.
    """
    cols = list(columns or numeric_columns(df))
    if len(cols) < 2:
        return []
    s = df.agg(*[F.var_samp(finite(c)).alias(f"v{i}") for i, c in enumerate(cols)], *[F.count(finite(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    var = {c: float(s[f"v{i}"] or 0.0) for i, c in enumerate(cols) if s[f"n{i}"] > 2}
    live = [c for c in cols if var.get(c, 0.0) ** 0.5 > 1e-12]
    top = set(sorted(live, key=lambda c: -var[c])[:max_features])
    cols = [c for c in live if c in top]
    d = len(cols)
    if d < 2:
        return []
    rows = df.select(*[finite(c).alias(f"x{i}") for i, c in enumerate(cols)]).dropna()
    size = rows.agg(F.count("*").alias("n"), *[F.sqrt(F.sum(F.col(f"x{i}") * F.col(f"x{i}"))).alias(f"q{i}") for i in range(d)],
                    *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(d)]).first()
    n = size["n"]
    if n < max(3, d + 1):
        return []
    scale = np.array([size[f"q{i}"] if size[f"q{i}"] > 1e-12 else 1.0 for i in range(d)] + [float(n) ** 0.5])
    unit = rows.select(*[(F.col(f"x{i}") / float(scale[i])).alias(f"x{i}") for i in range(d)], F.lit(1.0 / float(scale[d])).alias(f"x{d}"))
    packed = VectorAssembler(inputCols=[f"x{i}" for i in range(d + 1)], outputCol="v").transform(unit).select("v")
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(packed, "v")).computeGramianMatrix().toArray()
    lam, vec = np.linalg.eigh(gram)
    null = vec[:, lam < SINGULAR**2].T / scale
    if not len(null):
        return []
    spread = np.array([float(size[f"s{i}"]) for i in range(d)])
    candidates = []
    for w in _echelon(null):
        w = np.where(np.abs(w[:d]) < 1e-5 * np.abs(w[:d]).max(initial=1e-300), 0.0, w[:d])
        on = np.flatnonzero(np.abs(w) > 1e-5)
        if len(on) < 2:
            continue
        w = w / np.abs(w[on]).min()
        w = w if w[on[0]] > 0 else -w
        coef = {cols[i]: _tidy(float(w[i])) for i in on}
        coef = {c: k for c, k in coef.items() if abs(k) > 1e-5}
        if len(coef) >= 2:
            candidates.append(coef)
    return _verified(rows, cols, candidates, spread, r2)


def _verified(rows: DataFrame, cols: list[str], candidates: list[dict], spread: np.ndarray, r2: float) -> list[Law]:
    if not candidates:
        return []
    at = {c: i for i, c in enumerate(cols)}
    exprs = []
    for j, coef in enumerate(candidates):
        y = None
        for c, k in coef.items():
            term = F.col(f"x{at[c]}") * F.lit(float(k))
            y = term if y is None else y + term
        exprs += [F.avg(y).alias(f"m{j}"), F.var_pop(y).alias(f"v{j}")]
    s = rows.agg(*exprs).first()
    laws = []
    for j, coef in enumerate(candidates):
        mean, var = float(s[f"m{j}"]), float(s[f"v{j}"])
        main = max(coef, key=lambda c: abs(coef[c]) * spread[at[c]])
        left = var / coef[main] ** 2
        explained = 1.0 - left / spread[at[main]] ** 2 if spread[at[main]] > 1e-6 else 1.0
        if explained < r2 or left / (spread[at[main]] ** 2 + 1e-12) > 1.0 - r2 + 1e-7:
            continue
        if abs(mean) < 1e-4 * var**0.5 or abs(mean) < 1e-5:
            mean = 0.0
        else:
            mean = float(round(mean)) if abs(mean - round(mean)) < 1e-4 else round(mean, 4)
        text = " ".join(f"{k:+g}*{c}" for c, k in coef.items())
        laws.append(Law(f"{text} = {mean:g}", coef, mean, TOLERANCE, explained))
    return laws


def law_table(df: DataFrame, laws: Sequence[Law]) -> DataFrame:
    rows = [(i, law.name, law.coefficients, float(law.total), float(law.variance_explained)) for i, law in enumerate(laws)]
    return df.sparkSession.createDataFrame(rows, "law_id int, law string, coefficients map<string,double>, total double, variance_explained double")


def audit(df: DataFrame, laws: Sequence[Law]) -> DataFrame:
    """``law, violations, rows, passed_rows, violation_rate`` (missing values count as 0), one aggregate."""
    bad = [F.abs(law.residual()) > float(law.tolerance) for law in laws]
    any_bad = F.lit(False)
    for b in bad:
        any_bad = any_bad | b
    s = df.agg(F.count("*").alias("rows"), F.count(F.when(any_bad, 1)).alias("failed"), *[F.count(F.when(b, 1)).alias(f"b{i}") for i, b in enumerate(bad)])
    items = F.array(*[F.struct(F.lit(law.name).alias("law"), F.col(f"b{i}").alias("violations")) for i, law in enumerate(laws)])
    return s.select("rows", (F.col("rows") - F.col("failed")).alias("passed_rows"),
                    F.coalesce(F.try_divide(F.col("failed").cast("double"), F.col("rows")), F.lit(0.0)).alias("violation_rate"), F.explode(items).alias("e")).select("e.*", "rows", "passed_rows", "violation_rate")


def violating_rows(df: DataFrame, laws: Sequence[Law]) -> DataFrame:
    bad = F.lit(False)
    for law in laws:
        bad = bad | (F.abs(law.residual()) > float(law.tolerance))
    return df.where(bad)


def _system(laws: Sequence[Law], cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.array([[law.coefficients.get(c, 0.0) for c in cols] for law in laws], dtype=float)
    b = np.array([law.total for law in laws], dtype=float)
    return a, b, a.T @ np.linalg.pinv(a @ a.T)


def project(df: DataFrame, laws: Sequence[Law], columns: Sequence[str], lower: float | None = None, upper: float | None = None) -> DataFrame:
    """Columns moved the shortest way onto all laws; with bounds, clipped and projected once more.

    The projector is a small matrix, so each new column is a linear expression.
    """
    cols = list(columns)
    a, b, p = _system(laws, cols)

    def once(x: list[Column]) -> list[Column]:
        res = []
        for row, t in zip(a, b):
            e = F.lit(-float(t))
            for k, c in zip(row, x):
                if k:
                    e = e + float(k) * c
            res.append(e)
        out = []
        for i, c in enumerate(x):
            e = c
            for k, r in zip(p[i], res):
                if k:
                    e = e - float(k) * r
            out.append(e)
        return out

    moved = df.withColumns(dict(zip(cols, once([finite(c) for c in cols]))))
    if lower is None and upper is None:
        return moved
    clipped = {}
    for c in cols:
        e = ident(c)
        e = F.greatest(e, F.lit(float(lower))) if lower is not None else e
        clipped[c] = F.least(e, F.lit(float(upper))) if upper is not None else e
    return moved.withColumns(clipped).withColumns(dict(zip(cols, once([ident(c) for c in cols]))))


def residuals(df: DataFrame, laws: Sequence[Law], keys: Sequence[str]) -> DataFrame:
    """``keys..., law, error, passed`` per row and law."""
    items = F.array(*[F.struct(F.lit(law.name).alias("law"), F.abs(law.residual()).alias("error"), (F.abs(law.residual()) <= float(law.tolerance)).alias("passed")) for law in laws])
    return df.select(*[ident(k) for k in keys], F.explode(items).alias("e")).select(*[ident(k) for k in keys], "e.*")


def project_nonnegative(df: DataFrame, laws: Sequence[Law], columns: Sequence[str], nonnegative: Sequence[str]) -> DataFrame:
    """Alternating projections between the laws and x >= 0 for the named columns, whole batches at a time.

    A row is done when it meets both, or when a round no longer moves it because both cannot be met.
    """
    cols = list(columns)
    a, b, p = _system(laws, cols)
    mask = np.array([c in set(nonnegative) for c in cols])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float)
            todo = (np.abs(x @ a.T - b) > TOLERANCE).any(1) | (x[:, mask] < 0).any(1)
            y = x[todo]
            live = np.ones(len(y), dtype=bool)
            while live.any():
                z = y[live]
                z[:, mask] = np.maximum(z[:, mask], 0.0)
                z = z - (z @ a.T - b) @ p.T
                still = np.abs(z - y[live]).max(1, initial=0.0) <= 1e-12 * np.maximum(1.0, np.abs(z).max(1, initial=0.0))
                y[live] = z
                ok = still | (z[:, mask] >= -1e-6).all(1) & (np.abs(z @ a.T - b).max(1, initial=0.0) < 1e-5)
                live[np.flatnonzero(live)[ok]] = False
            y[:, mask] = np.maximum(y[:, mask], 0.0)
            x[todo] = y
            yield pdf.assign(**{c: x[:, i] for i, c in enumerate(cols)})

    return df.withColumns({c: finite(c) for c in cols}).mapInPandas(solve, df.withColumns({c: finite(c) for c in cols}).schema)


def simplex(c: str | Column) -> Column:
    """Euclidean projection of an array onto the probability simplex, with higher-order functions."""
    v = ident(c) if isinstance(c, str) else c
    v = F.transform(v, lambda x: x.cast("double"))
    u = F.sort_array(v, asc=False)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k"), F.lit(0.0).alias("theta"))

    def step(acc, x):
        total, k = acc["sum"] + x, acc["k"] + 1
        theta = (total - 1.0) / k
        return F.struct(total.alias("sum"), k.alias("k"), F.when(x - theta > 0, theta).otherwise(acc["theta"]).alias("theta"))

    def shares(raw: Column) -> Column:
        total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
        return let(total, lambda t: F.transform(raw, lambda x: F.when(t > 0, x / t).otherwise(1.0 / F.size(raw))))

    theta = F.aggregate(u, start, step)["theta"]
    moved = let(theta, lambda th: let(F.transform(v, lambda x: F.greatest(x - th, F.lit(0.0))), shares))
    return F.when(F.size(v) == 1, F.array(F.lit(1.0))).otherwise(moved)


def _pooled(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Non-decreasing weighted least-squares fit of a short ordered sequence: adjacent violators are pooled."""
    means, weights, sizes = [], [], []
    for value, weight in zip(y.tolist(), w.tolist()):
        size = 1
        while means and means[-1] >= value:
            total = weights[-1] + weight
            value = (means.pop() * weights[-1] + value * weight) / total
            weights.pop()
            weight, size = total, size + sizes.pop()
        means.append(value)
        weights.append(weight)
        sizes.append(size)
    return np.repeat(means, sizes)


def monotone_fit(df: DataFrame, x: str, y: str, weight: str | None = None, increasing: bool = True, block: int = POOL_ROWS) -> DataFrame:
    """Isotonic (or antitonic) least-squares fit of ``y`` along ``x`` as a ``fitted`` column.

    Rows of one ``x`` get one value. A fit lies at or below a threshold t up to the place where the running sum of
    w (y - t) is least, and that place is one aggregate over all rows. So thresholds cut the axis into independent
    parts, again and again, until a part has at most ``block`` different ``x`` or is one pool (no running sum about its
    mean falls below 0). Only parts of bounded size are then pooled, each in its own task. Rows without finite ``x`` and
    ``y``, or with a weight that isn't above 0, are left out.
    """
    w = finite(weight) if weight else F.lit(1.0)
    rows = df.withColumns({"_x": finite(x), "_y": finite(y), "_w": w}).where("_x is not null and _y is not null and _w > 0")
    sign = 1.0 if increasing else -1.0
    points = rows.groupBy("_x").agg(F.sum("_w").alias("w"), (F.sum(F.col("_w") * F.col("_y")) * sign).alias("s"), F.count("*").alias("rows"))
    points = cut_lineage(running_totals(cut_lineage(points), "_x", ["w", "s"]).select("_x", "w", "s", "rows", "cum_w", "cum_s", F.lit(0).cast("long").alias("part"), F.lit(None).cast("double").alias("pool")))
    steps = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    while True:
        parts = points.where("pool is null").groupBy("part").agg(
            F.count("*").alias("n"), F.sum("w").alias("pw"), F.sum("s").alias("ps"), F.percentile_approx(F.col("s") / F.col("w"), steps, 1000).alias("q"),
            F.min_by(F.struct((F.col("cum_w") - F.col("w")).alias("w"), (F.col("cum_s") - F.col("s")).alias("s")), "_x").alias("base"))
        cuts = F.array_sort(F.array_union(F.col("q"), F.array(F.col("ps") / F.col("pw"))))
        # a sum this close to 0 is rounding
        least = -1e-13 * F.col("pw") * F.array_max(F.transform(cuts, lambda c: F.abs(c)))
        large = cut_lineage(parts.where(F.col("n") > block).select(F.col("part").alias("l_part"), (F.col("ps") / F.col("pw")).alias("mean"), "base", cuts.alias("cuts"), least.alias("least")))
        if large.isEmpty():
            break
        asked = points.where("pool is null").join(large, F.col("part") == F.col("l_part"))
        sums = lambda i: F.col("cum_s") - F.col("base.s") - F.get("cuts", F.lit(i)) * (F.col("cum_w") - F.col("base.w"))
        # for each threshold the last x of the rows below it; none where no running sum is below 0
        low = [F.min(F.struct(sums(i).alias("v"), "_x")) for i in range(CUTS + 1)]
        ends = F.array(*[F.when(c["v"] < F.max("least"), c["_x"]) for c in low])
        found = asked.groupBy("part").agg(F.array_compact(ends).alias("ends"), F.max("_x").alias("last"), F.max("mean").alias("mean"))
        found = cut_lineage(found.select(F.col("part").alias("f_part"), "mean", F.filter("ends", lambda e: e < F.col("last")).alias("ends")))
        moved = points.join(found, F.col("part") == F.col("f_part"), "left")
        among = F.size(F.filter("ends", lambda e: e < F.col("_x")))
        one = F.size("ends") == 0
        points = cut_lineage(moved.select(
            "_x", "w", "s", "rows", "cum_w", "cum_s", F.xxhash64("part", F.coalesce(among, F.lit(0))).alias("part"),
            F.coalesce("pool", F.when(one, F.col("mean"))).alias("pool")))

    def pool(table: pa.Table) -> pa.Table:
        order = np.argsort(table["x"].to_numpy())
        s, w, n = (table[c].to_numpy()[order] for c in ("s", "w", "rows"))
        return pa.table({"f_x": table["x"].to_numpy()[order], "value": _pooled(s / w, w), "rows": n})

    short = points.where("pool is null").select("part", F.col("_x").alias("x"), "s", "w", "rows")
    fit = short.groupBy("part").applyInArrow(pool, "f_x double, value double, rows long").unionByName(points.where("pool is not null").select(F.col("_x").alias("f_x"), F.col("pool").alias("value"), "rows"))
    fit = cut_lineage(fit.select(F.col("f_x").alias("_x"), (F.col("value") * sign).alias("fitted"), F.col("rows").alias("_n")))
    return join_hot_keys(rows, fit, ["_x"], "_n").select(*[ident(c) for c in df.columns], "fitted")
