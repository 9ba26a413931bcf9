"""Data contracts: rules learned from one table, checked on another in a single scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.columns import finite, ident, is_numeric, is_string, present

RULES = "rule_id int, rule string, column string, min_value double, max_value double, mostly double, " \
        "value_set array<string>, type string"
SET_LIMIT = 20


def _small_sets(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Value sets of string columns with fewer than SET_LIMIT distinct values.

    The first SET_LIMIT values per column are enough to tell, so at most that
    many rows per column reach the driver.
    """
    if not columns:
        return {}
    from pyspark.sql import Window as W

    entries = F.array(*[F.struct(F.lit(c).alias("column"), ident(c).cast("string").alias("value")) for c in columns])
    distinct = (
        df.select(F.explode(entries).alias("e")).select("e.column", "e.value").where("value is not null").distinct()
    )
    w = W.partitionBy("column").orderBy("value")
    head = distinct.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= SET_LIMIT).collect()
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in head:
        out[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items() if len(v) < SET_LIMIT}


def learn(df: DataFrame, target: str) -> DataFrame:
    """The contract of ``df`` as a rule table (one row per rule)."""
    features = [c for c in df.columns if c != target]
    numeric = [c for c in features if is_numeric(df.schema[c].dataType)]
    text = [c for c in features if is_string(df.schema[c].dataType)]
    stats: Row = df.agg(
        F.count("*").alias("rows"),
        *[F.count(F.when(present(df, c), 1)).alias(f"n_{i}") for i, c in enumerate(features)],
        *[f(finite(c)).alias(f"{p}_{i}") for i, c in enumerate(numeric) for f, p in ((F.min, "lo"), (F.max, "hi"))],
    ).first()
    sets = _small_sets(df, text)
    rows: list[tuple] = []

    def rule(kind, column=None, lo=None, hi=None, mostly=None, values=None, dtype=None):
        rows.append((len(rows), kind, column, lo, hi, mostly, values, dtype))

    rule("columns_match_set", values=list(df.columns))
    rule("column_exists", target)
    rule("not_null", target, mostly=1.0)
    n = stats["rows"]
    for i, c in enumerate(features):
        missing = 1.0 - stats[f"n_{i}"] / n if n else 0.0
        if missing == 0:
            rule("not_null", c, mostly=1.0)
        elif missing < 1:
            rule("not_null", c, mostly=max(0.01, round(1.0 - missing - 0.05, 2)))
        dtype = df.schema[c].dataType.simpleString()
        if c in numeric:
            k = numeric.index(c)
            if stats[f"lo_{k}"] is not None:
                rule("between", c, lo=float(stats[f"lo_{k}"]), hi=float(stats[f"hi_{k}"]))
            rule("of_type", c, dtype=dtype)
        elif c in text:
            if c in sets:
                rule("in_set", c, values=sets[c])
            rule("of_type", c, dtype=dtype)
    return df.sparkSession.createDataFrame(rows, RULES)


def check(df: DataFrame, contract: DataFrame | Sequence[Row]) -> DataFrame:
    """``rule_id, rule, column, success, observed`` for every rule; one aggregate over ``df``."""
    rules = contract.collect() if isinstance(contract, DataFrame) else list(contract)
    have = set(df.columns)
    aggs = [F.count("*").alias("rows")]
    for r in rules:
        c, i = r["column"], r["rule_id"]
        if c is not None and c not in have:
            continue
        if r["rule"] == "not_null":
            aggs.append(F.avg(present(df, c).cast("double")).alias(f"a{i}"))
        elif r["rule"] == "between":
            aggs += [F.min(finite(c)).alias(f"a{i}"), F.max(finite(c)).alias(f"b{i}")]
        elif r["rule"] == "in_set":
            stray = present(df, c) & ~ident(c).cast("string").isin(list(r["value_set"]))
            aggs += [
                F.count(F.when(stray, 1)).alias(f"a{i}"),
                F.min(F.when(stray, ident(c).cast("string"))).alias(f"b{i}"),
            ]
    seen = df.agg(*aggs).first()
    out = []
    for r in rules:
        c, i, kind = r["column"], r["rule_id"], r["rule"]
        ok, note = True, None
        if kind == "columns_match_set":
            want = set(r["value_set"])
            ok = want == have
            note = None if ok else f"missing {sorted(want - have)[:5]}, extra {sorted(have - want)[:5]}"
        elif c not in have:
            ok, note = False, f"column {c} missing"
        elif kind == "not_null":
            rate = 1.0 if seen[f"a{i}"] is None else float(seen[f"a{i}"])
            ok = rate >= r["mostly"] - 1e-5
            note = f"non-null rate {rate:.6f}"
        elif kind == "between" and seen[f"a{i}"] is not None:
            lo, hi = float(seen[f"a{i}"]), float(seen[f"b{i}"])
            ok = lo >= r["min_value"] - 1e-4 and hi <= r["max_value"] + 1e-4
            note = f"range [{lo:.4f}, {hi:.4f}]"
        elif kind == "in_set":
            ok = seen[f"a{i}"] == 0
            note = f"{seen[f'a{i}']} unexpected values" + ("" if ok else f", e.g. {seen[f'b{i}']}")
        elif kind == "of_type":
            actual = df.schema[c].dataType.simpleString()
            ok = actual == r["type"]
            note = actual
        out.append((i, kind, c or "table", ok, note))
    return df.sparkSession.createDataFrame(out, "rule_id int, rule string, column string, success boolean, observed string")


def unexpected_values(df: DataFrame, column: str, allowed: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values of ``column`` outside the ``allowed.value`` table."""
    counts = df.where(present(df, column)).groupBy(ident(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return counts.join(allowed.select("value"), "value", "left_anti").orderBy(F.col("n").desc(), "value").limit(k)


def summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("n_rules"), F.sum(F.col("success").cast("int")).alias("n_passed"),
        F.sum((~F.col("success")).cast("int")).alias("n_failed"),
        F.round(F.avg(F.col("success").cast("double")), 4).alias("pass_rate"), F.bool_and("success").alias("success"),
    )
