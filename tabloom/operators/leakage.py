"""Target leakage and label integrity audit."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import association as assoc
from ..functions.columns import corr, finite, ident, is_numeric, is_string, is_temporal, kind_of, present
from ..functions.quantiles import distinct_edges, quantile_map, right_closed_bin
from .profile import cell_counts

# Names that mark identifiers and events after the outcome.
ID_NAME = re.compile(
    r"(^id$|_id$|^id_|^uuid$|_uuid$|^guid$|_guid$|^hash$|_hash$|^token$|_token$|^key$|_key$|account_num|cust_id"
    r"|customer_id|ssn|serial_no|record_id|client_id)", re.I,
)
FUTURE_NAME = re.compile(
    r"(future_|next_|post_|after_|churn_date|discharge_date|cancellation_date|post_event|termination_date)", re.I
)
MI_CRITICAL, MI_WARNING = 0.85, 0.70
CORR_CRITICAL, CORR_WARNING = 0.95, 0.85
FEATURE_BINS = 10


def target_entropy(df: DataFrame, target: str) -> DataFrame:
    counts = df.where(present(df, target)).groupBy(ident(target).cast("string").alias("v")).agg(F.count("*").alias("n"))
    return assoc.entropy(counts.withColumn("column", F.lit(target)))


def is_discrete(df: DataFrame, target: str, task: str = "classification") -> bool:
    """Classification, text or boolean target, or few distinct values (at most 5 or 5 % of the rows)."""
    if task == "classification" or kind_of(df.schema[target].dataType) in ("string", "bool"):
        return True
    s = df.agg(F.count("*").alias("n"), F.count_distinct(ident(target)).alias("d")).first()
    return s["d"] <= max(5, int(0.05 * s["n"]))


def quantile_bin(df: DataFrame, column: str, bins: int) -> Column:
    """Equal-frequency bin number with repeated edges merged."""
    q = quantile_map(df, [column], [i / bins for i in range(bins + 1)])
    return right_closed_bin(finite(column), distinct_edges(q.get(column, [])))


def target_code(df: DataFrame, target: str, task: str = "classification") -> Column:
    """The target as text classes; a continuous target becomes equal-frequency bins."""
    if is_discrete(df, target, task):
        return F.when(present(df, target), ident(target).cast("string"))
    rows = df.count()
    return quantile_bin(df, target, min(10, max(2, rows // 5))).cast("string")


def feature_codes(df: DataFrame, features: Sequence[str], bins: int = FEATURE_BINS) -> dict[str, Column]:
    """Each feature as text codes: numbers by quantile bin, everything else by value."""
    numeric = [c for c in features if is_numeric(df.schema[c].dataType)]
    q = quantile_map(df, numeric, [i / bins for i in range(bins + 1)])
    codes = {}
    for c in features:
        if c in numeric:
            codes[c] = right_closed_bin(finite(c), distinct_edges(q.get(c, []))).cast("string")
        else:
            codes[c] = ident(c).cast("string")
    return codes


def coded_long(df: DataFrame, codes: dict[str, Column], y: Column) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(c).alias("column"), x.alias("x")) for c, x in codes.items()])
    return df.select(y.alias("y"), F.explode(entries).alias("e")).select("e.column", "e.x", "y")


def information_ratios(df: DataFrame, target: str, features: Sequence[str], task: str = "classification") -> DataFrame:
    """``column, rows, mi, mi_ratio``: mutual information with the target over the target entropy."""
    y = target_code(df, target, task)
    table = assoc.contingency(coded_long(df, feature_codes(df, features), y))
    h = assoc.entropy(df.select(y.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n")).withColumn("column", F.lit("y")))
    hy = h.select("entropy").scalar()
    m = assoc.mutual_information(table)
    ratio = F.when(hy > 1e-7, F.least(F.greatest(F.col("mi") / hy, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return m.select("column", "rows", "mi", ratio.alias("mi_ratio"))


def _pairs_long(df: DataFrame, cols: Sequence[str], value, other: Column, value_name: str, other_name: str) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias(value_name)) for c in cols])
    return df.select(other.alias(other_name), F.explode(entries).alias("e")).select("e.column", f"e.{value_name}", other_name)


def strengths(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """``column, measure, strength``: max(|Pearson|, |Spearman|), eta or Cramer's V by the two dtypes."""
    numeric = [c for c in features if is_numeric(df.schema[c].dataType)]
    other = [c for c in features if c not in numeric]
    y_num = is_numeric(df.schema[target].dataType)
    parts = []
    if numeric and y_num:
        long = _pairs_long(df, numeric, finite, finite(target), "x", "y")
        pear = long.groupBy("column").agg(corr("x", "y").alias("r"))
        rank = assoc.spearman(long)
        best = F.greatest(F.coalesce(F.nanvl(F.abs("r"), F.lit(0.0)), F.lit(0.0)), F.coalesce(F.abs("spearman"), F.lit(0.0)))
        parts.append(pear.join(F.broadcast(rank), "column", "left").select("column", F.lit("correlation").alias("measure"), best.alias("strength")))
    if numeric and not y_num:
        long = _pairs_long(df, numeric, finite, ident(target).cast("string"), "v", "g")
        parts.append(assoc.correlation_ratio(long).select("column", F.lit("eta").alias("measure"), F.col("eta").alias("strength")))
    if other and y_num:
        long = _pairs_long(df, other, lambda c: ident(c).cast("string"), finite(target), "g", "v")
        parts.append(assoc.correlation_ratio(long).select("column", F.lit("eta").alias("measure"), F.col("eta").alias("strength")))
    if other and not y_num:
        long = _pairs_long(df, other, lambda c: ident(c).cast("string"), ident(target).cast("string"), "x", "y")
        parts.append(assoc.cramers_v(assoc.contingency(long)).select("column", F.lit("cramers_v").alias("measure"), F.col("cramers_v").alias("strength")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def unique_ratios(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``column, distinct, unique_ratio, id_name, id_like``."""
    rows = df.agg(F.count("*")).scalar()
    d = cell_counts(df, features).groupBy("column").agg(F.count("*").alias("distinct"))
    meta = df.sparkSession.createDataFrame(
        [(c, bool(ID_NAME.search(c)), kind_of(df.schema[c].dataType) in ("string", "int")) for c in features],
        "column string, id_name boolean, countable boolean",
    )
    x = meta.join(F.broadcast(d), "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)))
    x = x.withColumn("_rows", rows).withColumn("unique_ratio", F.col("distinct") / F.greatest(F.col("_rows"), F.lit(1)))
    like = (F.col("id_name") & (F.col("unique_ratio") > 0.5)) | (
        (F.col("unique_ratio") > 0.9) & (F.col("_rows") >= 10) & F.col("countable")
    )
    return x.select("column", "distinct", "unique_ratio", "id_name", like.alias("id_like"))


def temporal_inversions(df: DataFrame, reference: str, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, rows, future_ratio, inverted``: share of rows where a time lies after the reference time."""
    if columns is None:
        columns = [
            f.name for f in df.schema.fields
            if is_temporal(f.dataType) or (is_string(f.dataType) and re.search("date|time", f.name, re.I))
        ]
    cols = [c for c in columns if c != reference]
    def stamp(c):
        return F.try_to_timestamp(ident(c)) if is_string(df.schema[c].dataType) else ident(c).cast("timestamp")
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, rows long, future_ratio double, inverted boolean")
    ref = stamp(reference)
    aggs, items = [], []
    for i, c in enumerate(cols):
        aggs += [F.count(stamp(c) > ref).alias(f"n{i}"), F.avg((stamp(c) > ref).cast("double")).alias(f"f{i}")]
        items.append(F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("rows"), F.col(f"f{i}").alias("future_ratio")))
    long = df.agg(*aggs).select(F.explode(F.array(*items)).alias("e")).select("e.*")
    hit = (F.col("rows") >= 3) & F.coalesce(F.col("future_ratio") > 0.05, F.lit(False))
    return long.withColumn("inverted", hit)


def contradictions(df: DataFrame, target: str, features: Sequence[str] | None = None) -> DataFrame:
    """One row: clusters of equal features with several labels, labels and rows in them, ratio, suspicion.

    ``label_ratio`` sums distinct labels over the table rows; ``rows_affected``
    counts the rows themselves.  Clusters with a missing feature are left out.
    """
    cols = list(features or [c for c in df.columns if c != target])
    whole = F.lit(True)
    for c in cols:
        whole = whole & present(df, c)
    total = df.agg(F.count("*")).scalar()
    label = F.when(present(df, target), ident(target).cast("string"))
    per_label = df.where(whole).groupBy(*[ident(c) for c in cols], label.alias("_y")).agg(F.count("*").alias("_n"))
    clusters = per_label.groupBy(*[ident(c) for c in cols]).agg(
        F.count("_y").alias("labels"), F.sum("_n").alias("rows")
    ).where("labels > 1")
    s = clusters.agg(
        F.count("*").alias("conflict_count"), F.coalesce(F.sum("labels"), F.lit(0)).alias("conflict_labels"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_affected"),
    )
    ratio = F.coalesce(F.least(F.lit(1.0), F.try_divide(F.col("conflict_labels").cast("double"), total)), F.lit(0.0))
    out = s.withColumn("label_ratio", ratio)
    return out.withColumn(
        "suspicion",
        F.when(F.col("conflict_count") > 0, F.least(F.lit(100.0), F.col("label_ratio") * 400.0 + F.col("conflict_count") * 10.0)).otherwise(0.0),
    )


def audit(df: DataFrame, target: str, task: str = "classification", time_column: str | None = None) -> DataFrame:
    """One row per feature: mi_ratio, strength, id flag, future flags, severity and action."""
    features = [c for c in df.columns if c != target]
    mi = information_ratios(df, target, features, task).select("column", "mi_ratio")
    st = strengths(df, target, features)
    ids = unique_ratios(df, features)
    x = ids.join(F.broadcast(mi), "column", "left").join(F.broadcast(st), "column", "left")
    if time_column:
        inv = temporal_inversions(df, time_column).select("column", "inverted")
        x = x.join(F.broadcast(inv), "column", "left")
    else:
        x = x.withColumn("inverted", F.lit(False))
    future = F.lit(False)
    for c in features:
        if FUTURE_NAME.search(c):
            future = future | (F.col("column") == c)
    flat = F.col("distinct") <= 1
    mi_ratio = F.when(flat, 0.0).otherwise(F.coalesce("mi_ratio", F.lit(0.0)))
    strength = F.when(flat, 0.0).otherwise(F.coalesce("strength", F.lit(0.0)))
    x = x.select(
        "column", "unique_ratio", (F.col("id_like") & ~flat).alias("id_like"), mi_ratio.alias("mi_ratio"), "measure",
        strength.alias("strength"), (F.coalesce("inverted", F.lit(False)) | future).alias("temporal"),
    )
    critical = (F.col("strength") >= CORR_CRITICAL) | (F.col("mi_ratio") >= MI_CRITICAL) | F.col("temporal")
    warning = (F.col("strength") >= CORR_WARNING) | (F.col("mi_ratio") >= MI_WARNING) | F.col("id_like")
    x = x.withColumn("severity", F.when(critical, "CRITICAL").when(warning, "WARNING").otherwise("CLEAN"))
    score = F.greatest("mi_ratio", "strength", F.when(F.col("id_like"), 0.75).otherwise(0.0))
    return x.withColumn("leakage_score", score).withColumn(
        "action", F.when(F.col("severity") == "CRITICAL", "DROP").when(F.col("severity") == "WARNING", "REVIEW").otherwise("KEEP")
    )


def overall_risk(assessed: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Risk score 0-100 from the feature severities and the contradictory labels."""
    s = assessed.agg(
        F.sum((F.col("severity") == "CRITICAL").cast("int")).alias("critical"),
        F.sum((F.col("severity") == "WARNING").cast("int")).alias("warning"),
        F.max("temporal").alias("temporal"),
    )
    suspicion = conflicts.select("suspicion").scalar()
    score = (
        35.0 * F.col("critical") + 15.0 * F.col("warning") + F.when(F.col("temporal"), 25.0).otherwise(0.0)
        + F.least(F.lit(30.0), 0.3 * suspicion)
    )
    score = F.least(F.lit(100.0), F.round(score, 1))
    return s.select("critical", "warning", "temporal", score.alias("risk_score"),
                    ((F.col("critical") > 0) | (F.col("warning") > 0) | F.col("temporal") | (suspicion > 0)).alias("has_leakage"))


def quarantine(df: DataFrame, assessed: DataFrame | Iterable, critical_only: bool = False) -> DataFrame:
    """``df`` without the flagged columns (one report row per column reaches the driver)."""
    levels = ["CRITICAL"] if critical_only else ["CRITICAL", "WARNING"]
    flagged = [r["column"] for r in assessed.where(F.col("severity").isin(levels)).select("column").collect()]
    return df.drop(*flagged)
