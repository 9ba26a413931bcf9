"""Analytical questions over one table: segments, outliers, contributors, relations, distributions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import association
from ..functions.columns import corr, finite, ident, is_numeric, long_form, numeric_columns, present
from ..functions.pvalues import f_upper_col, pearson_p, t_two_sided_col
from ..functions.quantiles import column_quantiles, long_quantiles

# The closed set of aggregates a question may ask for.
AGGREGATES = {
    "mean": F.avg,
    "median": None,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "count": F.count,
}


class ProtectedColumn(ValueError):
    """Raised when a question would reveal values of a personal-data column."""


def _pairs(df: DataFrame, group: str, metric: str) -> DataFrame:
    return df.select(ident(group).alias("segment"), finite(metric).alias("value")).where(
        present(df, group) & finite(metric).isNotNull()
    )


def segment_comparison(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Count, mean, spread, quartiles and a 95 % interval of ``metric`` per segment.

    The number of segments is data, so quartiles use the skew-safe route.
    """
    rows = _pairs(df, group, metric)
    moments = rows.groupBy("segment").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
    )
    quarts = long_quantiles(rows, [0.25, 0.5, 0.75], ["segment"], few_groups=False)
    sem = F.col("std") / F.sqrt(F.greatest(F.col("n"), F.lit(1)))
    return (
        moments.join(quarts.drop("n"), "segment")
        .select(
            "segment", "n", "mean", "std", F.col("quantiles")[1].alias("median"),
            F.col("quantiles")[0].alias("q25"), F.col("quantiles")[2].alias("q75"), sem.alias("sem"),
        )
        .withColumn("iqr", F.col("q75") - F.col("q25"))
        .withColumn("ci95_lower", F.col("mean") - 1.96 * F.col("sem"))
        .withColumn("ci95_upper", F.col("mean") + 1.96 * F.col("sem"))
        .orderBy(F.col("mean").desc(), "segment")
    )


def _group_moments(df: DataFrame, group: str, metric: str) -> DataFrame:
    return (
        _pairs(df, group, metric).groupBy("segment")
        .agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
        .where("n >= 2")
    )


def welch_test(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Welch's t-test and Cohen's d; one row when exactly two groups have two rows or more."""
    m = _group_moments(df, group, metric)

    def side(fn, name):
        return fn(F.struct("segment", "n", "mean", "var")).alias(name)

    both = m.agg(F.count("*").alias("groups"), side(F.min, "a"), side(F.max, "b")).where("groups = 2")
    va, vb = F.col("a.var") / F.col("a.n"), F.col("b.var") / F.col("b.n")
    out = both.select(
        F.col("a.segment").alias("segment_a"), F.col("b.segment").alias("segment_b"),
        F.try_divide(F.col("a.mean") - F.col("b.mean"), F.sqrt(va + vb)).alias("t"),
        F.try_divide(
            (va + vb) * (va + vb), va * va / (F.col("a.n") - 1) + vb * vb / (F.col("b.n") - 1)
        ).alias("dof"),
        (
            F.abs(F.col("a.mean") - F.col("b.mean")) / F.sqrt((F.col("a.var") + F.col("b.var")) / 2.0 + 1e-12)
        ).alias("cohen_d"),
    )
    return out.withColumn("p_value", t_two_sided_col("t", "dof"))


def anova(df: DataFrame, group: str, metric: str) -> DataFrame:
    """One-way ANOVA from group moments; one row when three groups or more have two rows."""
    m = _group_moments(df, group, metric)
    s = m.agg(
        F.count("*").alias("groups"), F.sum("n").alias("rows"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("ss_within"),
    ).where("groups >= 3")
    grand = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    center = m.agg(grand.alias("g")).scalar()
    between = m.agg(F.sum(F.col("n") * F.pow(F.col("mean") - center, 2)).alias("b")).scalar()
    out = s.select(
        "groups", "rows", between.alias("ss_between"), "ss_within",
        (F.col("groups") - 1).cast("double").alias("dof_between"),
        (F.col("rows") - F.col("groups")).cast("double").alias("dof_within"),
    ).withColumn(
        "f", F.try_divide(F.col("ss_between") / F.col("dof_between"), F.col("ss_within") / F.col("dof_within"))
    )
    return out.withColumn("p_value", f_upper_col("f", "dof_between", "dof_within"))


def outlier_summary(df: DataFrame, column: str) -> DataFrame:
    """Tukey fences at 1.5 and 3 IQR, three-sigma count and skewness in one row (needs 5 values)."""
    rows = df.select(finite(column).alias("value")).where("value is not null").withColumn("column", F.lit(column))
    quarts = long_quantiles(rows, [0.25, 0.75])
    stats = rows.groupBy("column").agg(
        F.count("value").alias("rows"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("_std"),
        F.skewness("value").alias("skewness"),
    )
    fences = F.broadcast(
        stats.join(F.broadcast(quarts.drop("n")), "column").where("rows >= 5").select(
            "column", "rows", "mean", F.when(F.col("_std") > 1e-8, F.col("_std")).otherwise(1.0).alias("std"),
            "skewness", F.col("quantiles")[0].alias("q25"), F.col("quantiles")[1].alias("q75"),
        ).withColumn("iqr", F.col("q75") - F.col("q25"))
    )
    v = F.col("value")

    def outside(k: float) -> Column:
        return F.sum(((v < F.col("q25") - k * F.col("iqr")) | (v > F.col("q75") + k * F.col("iqr"))).cast("long"))

    return (
        rows.join(fences, "column")
        .groupBy("column", "rows", "mean", "std", "skewness", "q25", "q75", "iqr")
        .agg(
            outside(1.5).alias("n_outliers"), outside(3.0).alias("n_extreme"),
            F.sum((F.abs((v - F.col("mean")) / F.col("std")) > 3.0).cast("long")).alias("n_z_over_3"),
        )
        .withColumn("lower_fence", F.col("q25") - 1.5 * F.col("iqr"))
        .withColumn("upper_fence", F.col("q75") + 1.5 * F.col("iqr"))
        .withColumn("outlier_pct", 100.0 * F.col("n_outliers") / F.col("rows"))
    )


def outlier_rows(df: DataFrame, column: str, keys: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` rows outside the 1.5 IQR fences with the largest absolute z-score."""
    s = outlier_summary(df, column).select("mean", "std", "lower_fence", "upper_fence")
    one = F.broadcast(s.withColumn("_one", F.lit(1)))
    rows = df.select(*[ident(c) for c in keys], finite(column).alias("value"), F.lit(1).alias("_one"))
    return (
        rows.join(one, "_one")
        .where((F.col("value") < F.col("lower_fence")) | (F.col("value") > F.col("upper_fence")))
        .withColumn("z_score", (F.col("value") - F.col("mean")) / F.col("std"))
        .orderBy(F.abs("z_score").desc(), *[ident(c) for c in keys])
        .limit(k)
        .select(*[ident(c) for c in keys], "value", "z_score")
    )


def contributors(df: DataFrame, dimension: str, metric: str, k: int = 5, ascending: bool = False) -> DataFrame:
    """Top (or bottom) ``k`` segments by summed metric with share and running share.

    Only the ``k`` leading segments are ranked, so the ordered window sees ``k`` rows.
    """
    sums = (
        _pairs(df, dimension, metric).groupBy("segment").agg(F.sum("value").alias("total"))
    )
    grand = sums.agg(F.sum("total")).scalar()
    order = F.col("total").asc() if ascending else F.col("total").desc()
    lead = sums.orderBy(order, "segment").limit(k).withColumn("share_pct", 100.0 * F.col("total") / (grand + 1e-12))
    w = W.orderBy(order, "segment")
    return lead.select(
        F.row_number().over(w).alias("rank"), "segment", "total", "share_pct",
        F.sum("share_pct").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("cumulative_pct"),
    )


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``n, spearman`` over rows where both values are finite."""
    pair = df.select(F.lit("pair").alias("column"), finite(x).alias("x"), finite(y).alias("y"))
    return association.spearman(pair).drop("column")


def bivariate(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson with its Fisher interval, Spearman and the least-squares line (needs 5 rows)."""
    pair = df.select(finite(x).alias("x"), finite(y).alias("y")).where("x is not null and y is not null")
    s = pair.agg(
        F.count("*").alias("n"), corr("x", "y").alias("pearson"), F.stddev_samp("x").alias("sx"),
        F.stddev_samp("y").alias("sy"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
    ).where("n >= 5")
    rho = spearman(df, x, y).select("spearman").scalar()
    z = F.atanh(F.least(F.greatest(F.col("pearson"), F.lit(-0.999999)), F.lit(0.999999)))
    half = 1.96 / F.sqrt(F.greatest(F.col("n") - 3, F.lit(1)))
    out = s.select(
        "n", "pearson", rho.alias("spearman"), F.tanh(z - half).alias("ci_lower"), F.tanh(z + half).alias("ci_upper"),
        (F.col("pearson") * F.col("sy") / (F.col("sx") + 1e-12)).alias("slope"), "mx", "my",
    )
    return out.select(
        "n", "pearson", "spearman", "ci_lower", "ci_upper", "slope",
        (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"),
        (F.col("pearson") * F.col("pearson")).alias("r2"),
        pearson_p(F.col("pearson"), F.col("n")).alias("pearson_p"),
        pearson_p(F.col("spearman"), F.col("n")).alias("spearman_p"),
    )


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column_a, column_b, r, n`` for every unordered pair, from one aggregate (pairwise complete)."""
    cols = list(columns)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, r double, n long")
    names = F.array(*[F.lit(c) for c in cols])
    first = df.select(F.array(*[finite(c) for c in cols]).alias("v")).select("v", F.posexplode("v").alias("i", "x"))
    pairs = first.where((F.col("i") < len(cols) - 1) & F.col("x").isNotNull()).select(
        "i", "x", F.posexplode(F.slice("v", F.col("i") + 2, F.lit(len(cols)))).alias("k", "y")
    )
    return (
        pairs.groupBy("i", "k")
        .agg(corr("x", "y").alias("r"), F.count("y").alias("n"))
        .select(
            F.element_at(names, F.col("i") + 1).alias("column_a"),
            F.element_at(names, F.col("i") + F.col("k") + 2).alias("column_b"), "r", "n",
        )
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Long correlation matrix, both triangles and the diagonal."""
    cols = list(columns or numeric_columns(df))
    half = correlation_pairs(df, cols).drop("n")
    mirrored = half.select(F.explode(F.array(
        F.struct(F.col("column_a").alias("a"), F.col("column_b").alias("b"), "r"),
        F.struct(F.col("column_b").alias("a"), F.col("column_a").alias("b"), "r"),
    )).alias("p")).select(F.col("p.a").alias("column_a"), F.col("p.b").alias("column_b"), "p.r")
    ones = df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "column_a string, column_b string, r double")
    return mirrored.unionByName(ones)


def numeric_distribution(df: DataFrame, column: str) -> DataFrame:
    """Centre, spread, range and shape of a numeric column, with D'Agostino's K2 from 20 rows on."""
    rows = df.select(finite(column).alias("value")).where("value is not null").withColumn("column", F.lit(column))
    stats = rows.groupBy("column").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"),
    )
    quarts = long_quantiles(rows, [0.25, 0.5, 0.75]).drop("n")
    out = stats.join(F.broadcast(quarts), "column").select(
        "column", "n", "mean", "std", (F.col("std") / F.sqrt("n")).alias("sem"), "min",
        F.col("quantiles")[0].alias("q25"), F.col("quantiles")[1].alias("median"), F.col("quantiles")[2].alias("q75"),
        "max", "skewness", "kurtosis",
    )
    k2 = _dagostino_k2(F.col("n").cast("double"), F.col("skewness"), F.col("kurtosis"))
    return (
        out.withColumn("iqr", F.col("q75") - F.col("q25"))
        .withColumn("ci95_lower", F.col("mean") - 1.96 * F.col("sem"))
        .withColumn("ci95_upper", F.col("mean") + 1.96 * F.col("sem"))
        .withColumn("normality_k2", F.when(F.col("n") >= 20, k2))
        .withColumn("normality_p", F.exp(-F.col("normality_k2") / 2.0))
    )


def _dagostino_k2(n: Column, g1: Column, g2: Column) -> Column:
    """Omnibus statistic: squared normalised skewness plus squared normalised kurtosis (excess g2)."""
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2.0 * (beta2 - 1)) - 1.0
    a = F.sqrt(2.0 / (w2 - 1))
    z_skew = F.asinh(y / a) / F.sqrt(0.5 * F.log(w2))
    mean_b2 = 3.0 * (n - 1) / (n + 1)
    var_b2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3.0 - mean_b2) / F.sqrt(var_b2)
    root = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    big = 6.0 + 8.0 / root * (2.0 / root + F.sqrt(1.0 + 4.0 / (root * root)))
    den = 1.0 + x * F.sqrt(2.0 / (big - 4.0))
    term = F.signum(den) * F.cbrt((1.0 - 2.0 / big) / F.abs(den))
    z_kurt = (1.0 - 2.0 / (9.0 * big) - term) / F.sqrt(2.0 / (9.0 * big))
    return z_skew * z_skew + z_kurt * z_kurt


def categorical_distribution(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values with their share of non-missing rows."""
    counts = df.where(present(df, column)).groupBy(ident(column).alias("value")).agg(F.count("*").alias("n"))
    rows = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", 100.0 * F.col("n") / rows).orderBy(F.col("n").desc(), "value").limit(k)


def snapshot(df: DataFrame) -> DataFrame:
    """Rows, columns and missing cells in one row."""
    missing = [F.count(F.when(~present(df, c), 1)) for c in df.columns]
    cells = missing[0]
    for m in missing[1:]:
        cells = cells + m
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"), cells.alias("missing_cells"))


def _guard(column: str, protected: Iterable[str]) -> None:
    if column in set(protected):
        raise ProtectedColumn(f"column {column!r} holds personal data; only counts may be asked")


def describe_column(df: DataFrame, column: str, protected: Iterable[str] = ()) -> DataFrame:
    """Numeric statistics, or mode and distinct count, as ``statistic, value`` rows."""
    _guard(column, protected)
    if is_numeric(df.schema[column].dataType):
        d = numeric_distribution(df, column)
        names = ["n", "mean", "std", "min", "q25", "median", "q75", "max"]
        stats = F.array(*[F.struct(F.lit(c).alias("statistic"), F.col(c).cast("string").alias("value")) for c in names])
        return d.select(F.explode(stats).alias("s")).select("s.*")
    counts = df.where(present(df, column)).groupBy(ident(column).alias("value")).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.col("n").desc(), "value").limit(1).select(
        F.lit("mode").alias("statistic"), F.col("value").cast("string").alias("value")
    )
    rest = counts.agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).select(F.explode(F.array(
        F.struct(F.lit("n").alias("statistic"), F.col("n").cast("string").alias("value")),
        F.struct(F.lit("distinct").alias("statistic"), F.col("distinct").cast("string").alias("value")),
    )).alias("s")).select("s.*")
    return top.unionByName(rest)


def value_counts(df: DataFrame, column: str, top_n: int = 10, protected: Iterable[str] = ()) -> DataFrame:
    _guard(column, protected)
    return (
        df.where(present(df, column)).groupBy(ident(column).alias("value")).agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "value").limit(max(1, int(top_n)))
    )


def groupby_agg(
    df: DataFrame, group: str, metric: str, agg: str = "mean", top_n: int = 10, protected: Iterable[str] = (),
) -> DataFrame:
    """One allowed aggregate per group, largest first."""
    _guard(group, protected)
    _guard(metric, protected)
    if agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}; choose one of {sorted(AGGREGATES)}")
    if agg == "median":
        rows = _pairs(df, group, metric)
        out = long_quantiles(rows, [0.5], ["segment"], few_groups=False).select(
            "segment", F.col("quantiles")[0].alias("value")
        )
    else:
        kept = df.where(present(df, group)).select(ident(group).alias("segment"), ident(metric).alias("_m"))
        measure = F.col("_m") if agg == "count" else finite("_m")
        out = kept.groupBy("segment").agg(AGGREGATES[agg](measure).cast("double").alias("value"))
    return out.orderBy(F.col("value").desc_nulls_last(), "segment").limit(max(1, int(top_n)))


def correlation_of(df: DataFrame, x: str, y: str, protected: Iterable[str] = ()) -> DataFrame:
    _guard(x, protected)
    _guard(y, protected)
    return correlation_pairs(df, [x, y])


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))


def null_count(df: DataFrame, column: str) -> DataFrame:
    """Missing cells of one column; allowed on personal-data columns too."""
    return df.agg(F.lit(column).alias("column"), F.count(F.when(~present(df, column), 1)).alias("nulls"))


def column_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column."""
    cols = list(columns or numeric_columns(df))
    moments = long_form(df, cols).groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quarts = column_quantiles(df, cols, [0.25, 0.5, 0.75]).drop("n")
    return moments.join(F.broadcast(quarts), "column").select(
        "column", "count", "mean", "std", "min", F.col("quantiles")[0].alias("q25"),
        F.col("quantiles")[1].alias("q50"), F.col("quantiles")[2].alias("q75"), "max",
    )
