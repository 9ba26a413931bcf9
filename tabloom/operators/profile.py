"""Column profiles, role inference, target task detection and readiness scores."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import ident, is_string, is_temporal, kind_of, name_tokens, numeric_columns, present
from .query import correlation_pairs

# Name tokens and thresholds of the role rules.
ID_TOKENS = {"id", "key", "uuid", "guid", "ssn", "hash", "token", "ref"}
DATE_TOKENS = {"date", "time", "at", "on", "created", "updated", "timestamp", "dt", "year", "month", "day"}
DURATION_TOKENS = {"tenure", "duration", "age", "days", "weeks", "months", "years", "length", "period", "elapsed"}
TARGET_TOKENS = {
    "churn", "fraud", "label", "target", "class", "output", "result", "status", "flag", "default", "survived",
    "outcome", "y", "price", "cost", "revenue", "salary", "sales", "score", "demand",
}

_PREVIEW = 64


def _cell_key(df: DataFrame, name: str) -> Column:
    """Cell as text; long cells become a preview plus the hash of the whole text."""
    text = F.when(present(df, name), ident(name).cast("string"))
    return F.when(F.length(text) <= _PREVIEW, text).otherwise(
        F.concat(F.substring(text, 1, _PREVIEW), F.lit("…"), F.sha2(text, 256))
    )


def cell_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, value, n`` for every distinct non-missing cell (long cells hashed)."""
    cols = list(columns or df.columns)
    entries = F.array(*[F.struct(F.lit(c).alias("column"), _cell_key(df, c).alias("value")) for c in cols])
    return (
        df.select(F.explode(entries).alias("e")).select("e.column", "e.value").where("value is not null")
        .groupBy("column", "value").agg(F.count("*").alias("n"))
    )


def _schema_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = []
    for i, c in enumerate(columns):
        t = name_tokens(c)
        rows.append((
            i, c, kind_of(df.schema[c].dataType), bool(t & ID_TOKENS), bool(t & DATE_TOKENS),
            bool(t & DURATION_TOKENS), bool(t & TARGET_TOKENS),
        ))
    return df.sparkSession.createDataFrame(
        rows, "position int, column string, dtype string, id_name boolean, date_name boolean, "
        "duration_name boolean, target_name boolean",
    )


def profile(df: DataFrame, columns: Sequence[str] | None = None, samples: int = 3) -> DataFrame:
    """One row per column: dtype family, missing and distinct counts and the first distinct values.

    Distinct counting is two-level over (column, value) pairs, which map-side
    combining keeps small for repeated values; sample values are the smallest
    ones, so the report does not depend on row order.
    """
    cols = list(columns or df.columns)
    rows = df.agg(F.count("*")).scalar()
    counts = cell_counts(df, cols)
    w = W.partitionBy("column").orderBy("value")
    ahead = counts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= samples)
    shown = F.regexp_replace("value", "…[0-9a-f]{64}$", "…")
    picked = ahead.groupBy("column").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rn", shown.alias("v")))), lambda s: s["v"]), ", ")
        .alias("sample_values")
    )
    stats = counts.groupBy("column").agg(F.sum("n").alias("_filled"), F.count("*").alias("_distinct"))
    base = _schema_table(df, cols).select("position", "column", "dtype")
    joined = base.join(F.broadcast(stats), "column", "left").join(F.broadcast(picked), "column", "left")
    filled, distinct = F.coalesce("_filled", F.lit(0)), F.coalesce("_distinct", F.lit(0))
    return joined.select(
        "column", "position", "dtype", rows.alias("rows"), (rows - filled).alias("null_count"),
        F.coalesce(F.round(F.try_divide(100.0 * (rows - filled), rows), 1), F.lit(0.0)).alias("null_pct"),
        distinct.alias("unique_count"),
        F.coalesce(F.round(F.try_divide(distinct.cast("double"), rows), 4), F.lit(0.0)).alias("unique_ratio"),
        F.coalesce("sample_values", F.lit("")).alias("sample_values"),
    )


def text_shape(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, avg_length, date_rate``: mean text length and the share of values that read as dates."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, avg_length double, date_rate double")
    aggs, items = [], []
    for i, c in enumerate(columns):
        aggs += [
            F.avg(F.length(ident(c))).alias(f"l{i}"),
            F.avg(F.try_to_timestamp(ident(c)).isNotNull().cast("double") + F.when(ident(c).isNull(), None).otherwise(0.0))
            .alias(f"d{i}"),
        ]
        items.append(F.struct(F.lit(c).alias("column"), F.col(f"l{i}").alias("avg_length"), F.col(f"d{i}").alias("date_rate")))
    return df.agg(*aggs).select(F.explode(F.array(*items)).alias("e")).select("e.*")


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.85, "High").when(score >= 0.60, "Medium").otherwise("Low")


def roles(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Profile plus inferred role, confidence and label; the first matching rule wins."""
    cols = list(columns or df.columns)
    strings = [c for c in cols if is_string(df.schema[c].dataType)]
    p = profile(df, cols)
    names = _schema_table(df, cols).drop("position", "dtype")
    x = p.join(F.broadcast(names), "column").join(F.broadcast(text_shape(df, strings)), "column", "left")
    is_float, is_text = F.col("dtype") == "float", F.col("dtype") == "string"
    ratio = F.col("unique_ratio")
    rules = [
        (F.col("unique_count") <= 1, "constant (useless)", 0.99),
        ((F.col("unique_count") == 2) & F.col("target_name"), "target candidate", 0.88),
        (F.col("unique_count") == 2, "binary flag", 0.80),
        (~is_float & F.col("id_name") & (ratio > 0.90), "identifier", 0.92),
        (~is_float & (ratio >= 0.99) & (F.col("rows") >= 100), "identifier", 0.85),
        (is_float & (ratio > 0.80), "numeric feature", 0.85),
        (F.col("date_name"), "date / time", 0.82),
        (F.col("dtype") == "datetime", "date / time", 0.95),
        (is_text & (F.col("date_rate") >= 1.0), "date / time", 0.70),
        (F.col("duration_name"), "duration / tenure", 0.80),
        (F.col("target_name"), "target candidate", 0.78),
        (is_text & (ratio > 0.50), "high-cardinality categorical", 0.75),
        (is_text & (F.col("avg_length") > 40), "free text", 0.72),
        (is_text, "categorical feature", 0.70),
        (F.col("dtype").isin("int", "float"), "numeric feature", 0.75),
    ]
    role = F.lit("categorical feature")
    conf = F.lit(0.50)
    for cond, name, score in reversed(rules):
        hit = F.coalesce(cond, F.lit(False))
        role, conf = F.when(hit, name).otherwise(role), F.when(hit, score).otherwise(conf)
    return x.select(*p.columns, role.alias("role"), conf.alias("confidence"), confidence_label(conf).alias("confidence_label"))


def target_task(df: DataFrame, target: str) -> DataFrame:
    """Classification or regression, from the dtype family and the distinct counts of the target."""
    kind = kind_of(df.schema[target].dataType)
    keyed = df.where(present(df, target)).groupBy(ident(target).alias("v")).agg(F.count("*").alias("n"))
    s = keyed.agg(F.count("*").alias("unique_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    ratio = F.coalesce(F.try_divide(F.col("unique_count").cast("double"), F.col("rows")), F.lit(0.0))
    if kind in ("string", "bool"):
        task = F.lit("classification")
    elif kind == "int":
        task = F.when(F.col("unique_count") <= 20, "classification").when(ratio > 0.05, "regression").otherwise("classification")
    elif kind == "float":
        task = F.lit("regression")
    else:
        task = F.when(ratio > 0.05, "regression").otherwise("classification")
    return s.select(
        F.lit(target).alias("target"), task.alias("task_type"), "unique_count", ratio.alias("unique_ratio"),
        F.when(task == "classification", F.col("unique_count")).alias("n_classes"),
    )


def readiness(df: DataFrame, target: str) -> DataFrame:
    """Readiness verdict from the role table: penalties for gaps, few rows and few features."""
    r = roles(df)
    feature = F.col("column") != target
    useful = F.col("role").isin("numeric feature", "duration / tenure", "binary flag", "categorical feature")
    risky = F.col("role").isin("identifier", "high-cardinality categorical", "constant (useless)", "date / time")
    s = r.agg(
        F.max("rows").alias("rows"), F.sum((feature & useful).cast("int")).alias("useful_features"),
        F.sum((feature & risky).cast("int")).alias("leakage_risk_features"),
        F.sum((feature & (F.col("null_pct") > 50)).cast("int")).alias("mostly_null"),
        F.max(F.when(~feature, F.col("null_pct"))).alias("target_null_pct"),
    )
    score = (
        F.lit(100) - 5 * F.col("mostly_null")
        - F.when(F.col("rows") < 100, 20).when(F.col("rows") < 500, 10).otherwise(0)
        - F.when(F.col("target_null_pct") > 10, 15).otherwise(0)
        - F.when(F.col("useful_features") == 0, 20).when(F.col("useful_features") < 3, 5).otherwise(0)
    )
    score = F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")
    return s.select("*", score.alias("score")).withColumn(
        "verdict", F.when(F.col("score") >= 75, "Ready").when(F.col("score") >= 45, "Partially Ready").otherwise("Not Ready")
    )


def readiness_audit(df: DataFrame) -> DataFrame:
    """Five-pillar audit: missing cells, rows, cardinality and collinearity, clamped to 40-100."""
    p = profile(df)
    text = (F.col("dtype") == "string") & (F.col("unique_count") > 50) & (F.col("unique_count") / F.col("rows") > 0.4)
    s = p.agg(
        F.max("rows").alias("rows"), F.sum("null_count").alias("_nulls"), F.count("*").alias("_cols"),
        F.sum(text.cast("int")).alias("high_cardinality_columns"),
    )
    pairs = correlation_pairs(df, numeric_columns(df)).agg(F.coalesce(F.sum((F.abs("r") > 0.85).cast("int")), F.lit(0))).scalar()
    null_pct = 100.0 * F.col("_nulls") / (F.col("rows") * F.col("_cols"))
    out = s.select("rows", null_pct.alias("null_pct"), "high_cardinality_columns", pairs.alias("collinear_pairs"))
    score = (
        F.lit(100) - F.when(F.col("null_pct") >= 10, 20).otherwise(0) - F.when(F.col("rows") < 100, 25).otherwise(0)
        - F.when(F.col("high_cardinality_columns") > 0, 15).otherwise(0)
    )
    out = out.withColumn("score", F.greatest(F.lit(40), F.least(F.lit(100), score)).cast("int"))
    return out.withColumn(
        "verdict",
        F.when(F.col("score") >= 85, "READY FOR ENTERPRISE PRODUCTION").when(F.col("score") >= 70, "CONDITIONAL READINESS")
        .otherwise("REMEDIATION RECOMMENDED"),
    )


def simple_roles(df: DataFrame) -> DataFrame:
    """Six coarse roles by dtype, name, distinct count and mean text length."""
    strings = [f.name for f in df.schema.fields if is_string(f.dataType)]
    x = profile(df).join(F.broadcast(text_shape(df, strings)), "column", "left")
    low = F.lower("column")

    def mentions(*terms: str) -> Column:
        out = F.lit(False)
        for t in terms:
            out = out | low.contains(t)
        return out

    role = (
        F.when(F.col("dtype").isin("int", "float", "bool"), "numeric")
        .when(mentions("date", "time") | (F.col("dtype") == "datetime"), "datetime")
        .when(mentions("id", "uuid", "key", "account_num"), "id_entity")
        .when(F.col("unique_count") < 12, "categorical_low")
        .when(F.col("avg_length") > 30, "text")
        .otherwise("categorical_high")
    )
    return x.select("column", "dtype", "null_count", F.round(100.0 * F.col("null_count") / F.col("rows"), 2).alias("null_pct"),
                    "unique_count", role.alias("role"))


def top_correlations(df: DataFrame, columns: Sequence[str] | None = None, k: int = 20) -> DataFrame:
    """The ``k`` strongest pairwise correlations by absolute value."""
    return (
        correlation_pairs(df, list(columns or numeric_columns(df))).where(F.col("r").isNotNull() & ~F.isnan("r"))
        .orderBy(F.abs("r").desc(), "column_a", "column_b").limit(k)
    )


def capabilities(df: DataFrame) -> DataFrame:
    """Which table jobs make sense: dates present, long text present, at least two string columns."""
    strings = [f.name for f in df.schema.fields if is_string(f.dataType)]
    dates = any(is_temporal(f.dataType) or "date" in f.name.lower() or "time" in f.name.lower() for f in df.schema.fields)
    long_text = F.lit(False)
    for i in range(len(strings)):
        long_text = long_text | F.coalesce(F.col(f"l{i}") > 25, F.lit(False))
    lengths = [F.avg(F.length(ident(c))).alias(f"l{i}") for i, c in enumerate(strings)]
    return df.agg(F.count("*").alias("rows"), *lengths).select(
        "rows", F.lit(dates).alias("has_dates"), long_text.alias("has_text"), F.lit(len(strings) >= 2).alias("has_entities")
    )


def fingerprint(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Order-insensitive 16-hex fingerprint of all rows: count, sum and xor of row hashes."""
    cols = list(columns or df.columns)
    h = F.xxhash64(*[F.coalesce(ident(c).cast("string"), F.lit("\u0000")) for c in cols])
    s = df.select(h.alias("h")).agg(
        F.count("*").alias("rows"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.bit_xor("h").alias("x")
    )
    joined = F.concat_ws("|", F.col("rows").cast("string"), F.col("s").cast("string"), F.col("x").cast("string"))
    return s.select("rows", F.substring(F.sha2(joined, 256), 1, 16).alias("fingerprint"))


