"""Distribution drift between a reference table and a current table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import finite, ident, is_numeric, present, ratio
from ..functions.hashing import uniform
from ..functions.ordering import running_totals
from ..functions.pvalues import kolmogorov_p
from ..functions.quantiles import distinct_edges, left_closed_bin, quantile_map, right_closed_bin

EMPTY_BIN = 1e-4
FREQUENCIES = 128
TREE_ROWS, TREES = 256, 100


def shared_columns(ref: DataFrame, cur: DataFrame, target: str | None = None) -> tuple[list[str], list[str]]:
    """Numeric and other columns present in both tables."""
    both = [c for c in ref.columns if c in cur.columns and c != target]
    numeric = [c for c in both if is_numeric(ref.schema[c].dataType) and is_numeric(cur.schema[c].dataType)]
    return numeric, [c for c in both if c not in numeric]


def _sided(ref: DataFrame, cur: DataFrame, exprs: dict) -> DataFrame:
    """``column, x, side`` of both tables; side 0 is the reference."""
    def long(df, side):
        entries = F.array(*[F.struct(F.lit(c).alias("column"), e(df, c).alias("x")) for c, e in exprs.items()])
        return df.select(F.explode(entries).alias("e")).select("e.column", "e.x", F.lit(side).alias("side")).where("x is not null")
    return long(ref, 0).unionByName(long(cur, 1))


def _psi(counts: DataFrame) -> DataFrame:
    """``column, psi`` from ``column, x, r, c`` counts per bin; empty sides count as 1e-4."""
    totals = counts.groupBy("column").agg(F.sum("r").alias("_nr"), F.sum("c").alias("_nc"))
    share = lambda n, t: F.when(F.col(n) > 0, F.col(n) / F.col(t)).otherwise(EMPTY_BIN)
    e, a = share("r", "_nr"), share("c", "_nc")
    s = counts.join(F.broadcast(totals), "column").groupBy("column").agg(F.sum((a - e) * F.log(a / e)).alias("psi"))
    return s.select("column", F.greatest("psi", F.lit(0.0)).alias("psi"))


def _side_counts(long: DataFrame) -> DataFrame:
    return long.groupBy("column", "x").agg(
        F.sum((F.col("side") == 0).cast("long")).alias("r"), F.sum((F.col("side") == 1).cast("long")).alias("c")
    )


def numeric_psi(ref: DataFrame, cur: DataFrame, columns: Sequence[str], buckets: int = 10, right_closed: bool = True) -> DataFrame:
    """Population stability index on reference quantile bins; bins close on the right or on the left."""
    edges = {c: distinct_edges(v) for c, v in quantile_map(ref, list(columns), [i / buckets for i in range(buckets + 1)]).items()}
    place = right_closed_bin if right_closed else left_closed_bin
    flat = [c for c in columns if len(edges.get(c, [])) < 2]
    live = [c for c in columns if c not in flat]
    spark = ref.sparkSession
    zero = spark.createDataFrame([(c, 0.0) for c in flat], "column string, psi double")
    if not live:
        return zero
    binned = _sided(ref, cur, {c: (lambda df, c: place(finite(c), edges[c])) for c in live})
    return _psi(_side_counts(binned)).unionByName(zero)


def category_psi(ref: DataFrame, cur: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = _side_counts(_sided(ref, cur, {c: (lambda df, c: F.when(present(df, c), ident(c).cast("string"))) for c in columns}))
    return _psi(counts)


def distances(ref: DataFrame, cur: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two-sample KS statistic with p-value and Wasserstein-1 distance per column.

    Both samples collapse to value counts; the two distribution functions come
    from one bucketed running total per column.
    """
    counts = _side_counts(_sided(ref, cur, {c: (lambda df, c: finite(c)) for c in columns}))
    sizes = counts.groupBy("column").agg(F.sum("r").alias("ref_rows"), F.sum("c").alias("cur_rows"))
    run = running_totals(counts, "x", ["r", "c"], by=["column"]).join(F.broadcast(sizes), "column")
    gap = F.abs(ratio(F.col("cum_r"), F.col("ref_rows")) - ratio(F.col("cum_c"), F.col("cur_rows")))
    s = run.groupBy("column", "ref_rows", "cur_rows").agg(
        F.max(gap).alias("ks"), F.coalesce(F.sum(gap * (F.col("next_x") - F.col("x"))), F.lit(0.0)).alias("wasserstein")
    )
    return s.withColumn("p_value", kolmogorov_p(F.col("ks"), F.col("ref_rows"), F.col("cur_rows")))


def moments(ref: DataFrame, cur: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Means, spreads and the mean shift in percent, side by side."""
    long = _sided(ref, cur, {c: (lambda df, c: finite(c)) for c in columns})
    r, c = F.when(F.col("side") == 0, F.col("x")), F.when(F.col("side") == 1, F.col("x"))
    s = long.groupBy("column").agg(
        F.avg(r).alias("ref_mean"), F.avg(c).alias("cur_mean"), F.stddev_samp(r).alias("ref_std"), F.stddev_samp(c).alias("cur_std")
    )
    shift = F.when(F.abs("ref_mean") > 1e-4, 100.0 * (F.col("cur_mean") - F.col("ref_mean")) / F.col("ref_mean")).otherwise(0.0)
    return s.withColumn("mean_shift_pct", shift)


def report(ref: DataFrame, cur: DataFrame, target: str | None = None) -> DataFrame:
    """One row per shared column; numeric drift by p < .05 or PSI >= .2, categorical by PSI >= .2."""
    return _report(ref, cur, target, None, right_closed=True).withColumn(
        "drift_detected",
        F.when(F.col("kind") == "numeric", (F.col("p_value") < 0.05) | (F.col("psi") >= 0.2)).otherwise(F.col("psi") >= 0.2),
    )


def _report(ref, cur, target, columns, right_closed: bool) -> DataFrame:
    numeric, other = shared_columns(ref, cur, target)
    if columns is not None:
        numeric, other = [c for c in numeric if c in columns], [c for c in other if c in columns]
    parts = []
    if numeric:
        d = distances(ref, cur, numeric).where("ref_rows >= 5 and cur_rows >= 5")
        n = d.join(F.broadcast(numeric_psi(ref, cur, numeric, right_closed=right_closed)), "column").join(
            F.broadcast(moments(ref, cur, numeric)), "column"
        )
        parts.append(n.withColumn("kind", F.lit("numeric")))
    if other:
        counts = _side_counts(_sided(ref, cur, {c: (lambda df, c: F.when(present(df, c), ident(c).cast("string"))) for c in other}))
        s = counts.groupBy("column").agg(
            F.sum("r").alias("ref_rows"), F.sum("c").alias("cur_rows"),
            F.count(F.when(F.col("r") > 0, 1)).alias("ref_unique"), F.count(F.when(F.col("c") > 0, 1)).alias("cur_unique"),
        ).where("ref_rows >= 5 and cur_rows >= 5")
        parts.append(s.join(F.broadcast(_psi(counts)), "column").withColumn("kind", F.lit("categorical")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def sentinel(ref: DataFrame, cur: DataFrame, columns: Sequence[str] | None = None, p_cut: float = 0.01, psi_cut: float = 0.20) -> DataFrame:
    """One row per monitored column with status CRITICAL_DRIFT, MODERATE_SHIFT or HEALTHY."""
    r = _report(ref, cur, None, columns, right_closed=False)
    shifted, far = F.coalesce(F.col("p_value") < p_cut, F.lit(False)), F.col("psi") > psi_cut
    numeric = F.when(shifted & far, "CRITICAL_DRIFT").when(shifted | (F.col("psi") > 0.10), "MODERATE_SHIFT").otherwise("HEALTHY")
    text = F.when(far, "CRITICAL_DRIFT").when(F.col("psi") > 0.10, "MODERATE_SHIFT").otherwise("HEALTHY")
    return r.withColumn("status", F.when(F.col("kind") == "numeric", numeric).otherwise(text))


def frequencies(columns: int, seed: int = 42) -> np.ndarray:
    """Fixed random frequencies whose cosines and sines average to the kernel exp(-|x - y|^2 / columns)."""
    draws = np.random.default_rng(seed).standard_normal((FREQUENCIES, columns))
    return np.round(draws * np.sqrt(2.0 / max(1, columns)), 6)


def mmd(ref: DataFrame, cur: DataFrame, columns: Sequence[str], seed: int = 42) -> float:
    """RBF maximum mean discrepancy of all complete rows, on columns standardised by the reference.

    The kernel is expanded in fixed random Fourier features, so each side is one aggregate of mean cosines and sines.
    """
    cols = list(columns)
    whole, other = (df.select(*[finite(c).alias(f"x{i}") for i, c in enumerate(cols)]).dropna() for df in (ref, cur))
    s = whole.agg(*[f(f"x{i}").alias(f"{k}{i}") for i in range(len(cols)) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not cols or s["m0"] is None:
        return 0.0
    scale = [s[f"s{i}"] if s[f"s{i}"] >= 1e-4 else 1.0 for i in range(len(cols))]
    z = [(F.col(f"x{i}") - s[f"m{i}"]) / scale[i] for i in range(len(cols))]

    turns = frequencies(len(cols), seed)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, np.zeros((2, FREQUENCIES))
        for b in batches:
            angle = np.stack([c.to_numpy() for c in b.columns], axis=1) @ turns.T
            rows += b.num_rows
            total += np.stack([np.cos(angle).sum(0), np.sin(angle).sum(0)])
        if rows:
            yield pa.record_batch([pa.array(np.arange(FREQUENCIES)), pa.array(total[0]), pa.array(total[1]), pa.array(np.full(FREQUENCIES, rows))], names=["j", "c", "s", "n"])

    def embedding(df: DataFrame) -> np.ndarray:
        # a task hands on one sum per frequency, whatever its rows
        parts = df.select(*[x.alias(f"z{i}") for i, x in enumerate(z)]).mapInArrow(sums, "j long, c double, s double, n long")
        n = F.sum("n").cast("double")
        means = parts.groupBy("j").agg((F.sum("c") / n).alias("c"), (F.sum("s") / n).alias("s")).orderBy("j").collect()
        return np.array([[r["c"], r["s"]] for r in means])

    a, b = embedding(whole), embedding(other)
    return float(np.sqrt(((a - b) ** 2).sum() / FREQUENCIES)) if len(a) and len(b) else 0.0


def verdict(monitored: DataFrame, mmd_score: float) -> DataFrame:
    """Dataset status and governance action from the drifting share and the MMD."""
    s = monitored.agg(
        F.count("*").alias("columns"), F.sum((F.col("status") == "CRITICAL_DRIFT").cast("long")).alias("drifting")
    ).withColumn("drift_ratio", F.col("drifting") / F.greatest(F.col("columns"), F.lit(1))).withColumn("mmd", F.lit(float(mmd_score)))
    bad = (F.col("drift_ratio") >= 0.30) | (F.col("mmd") > 0.45)
    warn = (F.col("drift_ratio") >= 0.10) | (F.col("mmd") > 0.20)
    return s.withColumn("status", F.when(bad, "CRITICAL_DRIFT").when(warn, "WARN_MONITOR").otherwise("PASS_HEALTHY")).withColumn(
        "action", F.when(bad, "ACTIVATE_SAFE_FALLBACK").when(warn, "TRIGGER_RETRAIN").otherwise("PASS_HEALTHY")
    )


def summary(reported: DataFrame) -> DataFrame:
    """Mean PSI over the columns and its status."""
    s = reported.agg(F.count("*").alias("columns"), F.sum(F.col("drift_detected").cast("long")).alias("drifted"), F.avg("psi").alias("mean_psi"))
    return s.withColumn(
        "status",
        F.when(F.col("mean_psi") < 0.1, "NO DRIFT DETECTED").when(F.col("mean_psi") < 0.25, "MODERATE DRIFT").otherwise("SEVERE DRIFT"),
    )


def split_by_order(df: DataFrame, key: str, first_rows) -> tuple[DataFrame, DataFrame]:
    """Cut a table by an ordering column after ``first_rows(total)`` rows; equal keys stay together."""
    per = df.where(present(df, key)).groupBy(ident(key).alias("k")).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n")).first()[0] or 0
    keep = first_rows(total)
    cut = running_totals(per.withColumn("k", _axis(per)), "k", ["n"]).where(F.col("cum_n") <= keep).agg(F.max("k")).first()[0]
    axis = _axis(df.select(ident(key).alias("k")))
    if cut is None:
        return df.limit(0), df
    marked = df.withColumn("k", ident(key)) if key != "k" else df
    first = axis <= F.lit(cut)
    return marked.where(first).select(*df.columns), marked.where(~first).select(*df.columns)


def _axis(df: DataFrame):
    kind = df.schema["k"].dataType
    if isinstance(kind, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return F.unix_micros(F.col("k").cast("timestamp"))
    return F.col("k")


def halves(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return split_by_order(df, key, lambda n: max(1, n // 2))


def tail(df: DataFrame, key: str, fraction: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Last ``fraction`` of the rows (at least 20) as the current table."""
    return split_by_order(df, key, lambda n: n - max(int(n * fraction), 20))


# ---- isolation forest ----


def _grow(rows: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes ``(node, left, right, feature, cut, size)`` of one isolation tree over at most 256 rows."""
    nodes: list[list] = []
    stack = [(np.arange(len(rows)), 0, -1, 0)]
    while stack:
        idx, depth, parent, side = stack.pop()
        me = len(nodes)
        nodes.append([me, -1, -1, -1, 0.0, len(idx)])
        if parent >= 0:
            nodes[parent][1 + side] = me
        part = rows[idx]
        lo, hi = part.min(0), part.max(0)
        wide = np.flatnonzero(hi > lo)
        if depth >= limit or len(idx) <= 1 or not len(wide):
            continue
        f = int(rng.choice(wide))
        cut = float(rng.uniform(lo[f], hi[f]))
        nodes[me][3], nodes[me][4] = f, cut
        goes = part[:, f] <= cut
        stack += [(idx[goes], depth + 1, me, 0), (idx[~goes], depth + 1, me, 1)]
    return [tuple(n) for n in nodes]


def _mean_path(n):
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n - 1.0, 1.0)
    return np.where(n > 2, 2.0 * (np.log(safe) + np.euler_gamma) - 2.0 * (n - 1.0) / np.maximum(n, 1.0), np.where(n == 2, 1.0, 0.0))


def filled_with(df: DataFrame, cols: Sequence[str], medians: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.coalesce(finite(c), F.lit(medians[c])) for c in cols})


def isolation_forest(ref: DataFrame, cols: Sequence[str], trees: int = TREES, seed: int = 42) -> DataFrame:
    """``tree, node, lft, rgt, feature, cut, size`` of trees grown in parallel on disjoint 256-row samples.

    Every row draws by its place in the scan, so equal rows are sampled one by one.
    """
    cols = list(cols)
    placed = ref.select(*cols, F.monotonically_increasing_id().alias("_row"))
    sample = placed.select(*cols, uniform("_row", seed=seed).alias("_u")).orderBy("_u").limit(trees * TREE_ROWS)
    spread = sample.withColumn("tree", F.pmod(F.xxhash64("_u", F.lit(seed)), F.lit(trees)).cast("int"))
    limit = int(np.ceil(np.log2(TREE_ROWS)))

    def grow(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_u")
        made = _grow(pdf[cols].to_numpy(dtype=float), np.random.default_rng(seed + int(key[0])), limit)
        out = pd.DataFrame(made, columns=["node", "lft", "rgt", "feature", "cut", "size"])
        out.insert(0, "tree", int(key[0]))
        return out

    return spread.groupBy("tree").applyInPandas(grow, "tree int, node int, lft int, rgt int, feature int, cut double, size int")


def _flat_tree(lft: np.ndarray, rgt: np.ndarray, feature: np.ndarray, cut: np.ndarray, size: np.ndarray) -> tuple:
    """``steps, feature, cut, next, mean path of all rows, path at each node``; a leaf is its own next node, so rows walk without masks."""
    leaf, depth = feature < 0, np.zeros(len(feature))
    for i in np.flatnonzero(~leaf):  # a parent comes before its children
        depth[[lft[i], rgt[i]]] = depth[i] + 1
    own = np.arange(len(feature))
    after = np.stack([np.where(leaf, own, rgt), np.where(leaf, own, lft)], axis=1).ravel()
    return int(depth.max()), np.where(leaf, 0, feature).astype(np.intp), cut.astype(float), after.astype(np.intp), float(_mean_path(size[0])), depth + _mean_path(size)


#: Rows that walk through all trees together, few enough to stay in a core's cache.
WALK = 4096


def _path_lengths(m: np.ndarray, trees: Sequence[tuple]) -> np.ndarray:
    """The sum over trees of each row's path."""
    total = np.zeros(len(m))
    for i in range(0, len(m), WALK):
        rows = np.ascontiguousarray(m[i:i + WALK])
        flat, base, part = rows.ravel(), np.arange(len(rows)) * m.shape[1], total[i:i + WALK]
        for steps, feature, cut, after, _, path in trees:
            at = np.zeros(len(rows), np.intp)
            for _ in range(steps):
                at = after.take(2 * at + (flat.take(base + feature.take(at)) <= cut.take(at)))
            part += path.take(at)
    return total


def isolation_scores(df: DataFrame, forest: DataFrame, cols: Sequence[str], name: str = "anomaly_score") -> DataFrame:
    """Anomaly score 2^(-mean depth / c) per row; the forest (bounded: trees x 511 nodes) travels in the closure."""
    nodes = forest.toPandas().sort_values(["tree", "node"])
    trees = [_flat_tree(*(g[c].to_numpy() for c in ("lft", "rgt", "feature", "cut", "size"))) for _, g in nodes.groupby("tree")]
    norm = float(np.mean([t[4] for t in trees])) if trees else 1.0
    cols = list(cols)

    @F.pandas_udf("double")
    def score(x: pd.DataFrame) -> pd.Series:
        return pd.Series(2.0 ** (-(_path_lengths(x.to_numpy(dtype=float), trees) / len(trees)) / max(norm, 1e-9)))

    return df.withColumn(name, score(F.struct(*[finite(c).alias(c) for c in cols])))


def outlier_rate(ref: DataFrame, cur: DataFrame, target: str | None = None, contamination: float = 0.05) -> DataFrame:
    """Share of current rows scoring above the reference's (1 - contamination) score quantile."""
    cols = [c for c in shared_columns(ref, cur, target)[0]]
    med = {c: v[0] for c, v in quantile_map(ref, cols, [0.5]).items()}
    r, c = filled_with(ref.select(*cols), cols, med), filled_with(cur.select(*cols), cols, med)
    forest = isolation_forest(r, cols)
    scored = isolation_scores(r, forest, cols)
    cut = quantile_map(scored, ["anomaly_score"], [1.0 - contamination])["anomaly_score"][0]
    s = isolation_scores(c, forest, cols).agg(
        F.count("*").alias("rows"), F.sum((F.col("anomaly_score") > cut).cast("long")).alias("anomalies")
    )
    return s.withColumn("anomaly_pct", 100.0 * F.col("anomalies") / F.greatest(F.col("rows"), F.lit(1)))
