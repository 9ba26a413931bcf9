"""Dependence measures between columns, all from counts and group moments.

Every function takes a long table with a bounded ``column`` key and returns one
row per column, so a whole table of features is measured in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut_lineage
from .ordering import running_totals
from .skew import join_hot_keys


def _n_log_n(n: str) -> Column:
    return F.sum(F.col(n) * F.log(F.col(n).cast("double")))


def entropy(counts: DataFrame, n: str = "n") -> DataFrame:
    """Shannon entropy (nats) per ``column`` of a table of value counts."""
    s = counts.groupBy("column").agg(F.sum(n).cast("double").alias("_t"), _n_log_n(n).alias("_s"))
    h = F.log("_t") - F.col("_s") / F.col("_t")
    return s.select("column", F.greatest(h, F.lit(0.0)).alias("entropy"))


def contingency(long: DataFrame) -> DataFrame:
    """``column, x, y, n`` counts of a long table ``column, x, y`` (rows missing either are dropped)."""
    return long.where("x is not null and y is not null").groupBy("column", "x", "y").agg(F.count("*").alias("n"))


def mutual_information(table: DataFrame) -> DataFrame:
    """``column, rows, mi, h_y`` from contingency counts.

    With S = sum of n ln n over cells, rows and columns of the table, the mutual
    information is (S_xy - S_x - S_y) / N + ln N: no join with the marginals.
    """
    x = table.groupBy("column", "x").agg(F.sum("n").alias("n")).groupBy("column").agg(_n_log_n("n").alias("sx"))
    y = table.groupBy("column", "y").agg(F.sum("n").alias("n")).groupBy("column").agg(_n_log_n("n").alias("sy"))
    xy = table.groupBy("column").agg(_n_log_n("n").alias("sxy"), F.sum("n").cast("double").alias("rows"))
    mi = (F.col("sxy") - F.col("sx") - F.col("sy")) / F.col("rows") + F.log("rows")
    h = F.log("rows") - F.col("sy") / F.col("rows")
    return xy.join(F.broadcast(x), "column").join(F.broadcast(y), "column").select(
        "column", F.col("rows").cast("long").alias("rows"), F.greatest(mi, F.lit(0.0)).alias("mi"),
        F.greatest(h, F.lit(0.0)).alias("h_y"),
    )


def cramers_v(table: DataFrame) -> DataFrame:
    """``column, cramers_v`` (no corrections); 0 below three rows or with a single row or column."""
    n_y = table.groupBy("column", "y").agg(F.sum("n").alias("ny"), F.count("*").alias("cells"))
    cells = join_hot_keys(table, n_y, ["column", "y"], "cells")
    per_x = cells.groupBy("column", "x").agg(
        F.sum(F.col("n") * F.col("n") / F.col("ny").cast("double")).alias("q"), F.sum("n").alias("nx")
    )
    s = per_x.groupBy("column").agg(
        F.sum(F.col("q") / F.col("nx")).alias("phi"), F.sum("nx").alias("rows"), F.count("*").alias("r")
    ).join(F.broadcast(n_y.groupBy("column").agg(F.count("*").alias("c"))), "column")
    small = F.least("r", "c") - 1
    v = F.sqrt(F.least(F.greatest((F.col("phi") - 1.0) / small, F.lit(0.0)), F.lit(1.0)))
    return s.select("column", F.when((F.col("rows") < 3) | (small < 1), 0.0).otherwise(v).alias("cramers_v"))


def correlation_ratio(long: DataFrame) -> DataFrame:
    """``column, eta`` of a long table ``column, g, v``: spread between groups over total spread."""
    rows = long.where("g is not null and v is not null")
    groups = rows.groupBy("column", "g").agg(
        F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s")
    )
    center = groups.groupBy("column").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("c"))
    s = groups.join(F.broadcast(center), "column").groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("c"), 2)).alias("between"),
        F.sum(F.col("n") * F.col("s")).alias("within"),
    )
    whole = F.col("between") + F.col("within")
    eta = F.sqrt(F.least(F.greatest(F.col("between") / whole, F.lit(0.0)), F.lit(1.0)))
    return s.select("column", F.when((F.col("rows") < 3) | (whole <= 1e-12), 0.0).otherwise(eta).alias("eta"))


def spearman(long: DataFrame) -> DataFrame:
    """``column, n, spearman`` of a long table ``column, x, y`` (mean ranks for ties).

    Rows collapse to distinct pairs with a weight; ranks come from bucketed
    running totals of each margin and are attached by a skew-safe join.
    """
    joint = long.where("x is not null and y is not null").groupBy("column", "x", "y").agg(F.count("*").alias("w"))
    joint = cut_lineage(joint)  # read about eight times below: written once instead of re-aggregated
    out = joint
    for c in ("x", "y"):
        margin = joint.groupBy("column", c).agg(F.sum("w").alias("n"), F.count("*").alias("pairs"))
        run = running_totals(margin, c, ["n"], by=["column"])
        ranks = run.select("column", c, "pairs", (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias(f"r{c}"))
        out = join_hot_keys(out, ranks, ["column", c], "pairs", sizes=margin).drop("pairs")
    return weighted_corr(out, "rx", "ry", "w", "spearman")


def weighted_corr(df: DataFrame, a: str, b: str, w: str, name: str) -> DataFrame:
    """Correlation per ``column`` where each row stands for ``w`` rows (centred in a second pass)."""
    mean = df.groupBy("column").agg(
        (F.sum(F.col(a) * F.col(w)) / F.sum(w)).alias("_ma"), (F.sum(F.col(b) * F.col(w)) / F.sum(w)).alias("_mb")
    )
    da, db, n = F.col(a) - F.col("_ma"), F.col(b) - F.col("_mb"), F.col(w)
    s = df.join(F.broadcast(mean), "column").groupBy("column").agg(
        F.sum(w).alias("n"), F.sum(n * da * db).alias("_ab"), F.sum(n * da * da).alias("_aa"), F.sum(n * db * db).alias("_bb")
    )
    return s.select("column", "n", F.try_divide(F.col("_ab"), F.sqrt(F.col("_aa") * F.col("_bb"))).alias(name))
