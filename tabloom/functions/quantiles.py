"""Exact linear-interpolated quantiles that never gather a column in one task.

Spark's ``percentile`` keeps every distinct value of a group in one buffer.
Here a bounded sketch (``percentile_approx``) first brackets each requested
rank. While a bracket may hold more than ``KEPT`` rows, the rows inside it are
sketched again and the bracket shrinks about 200-fold. A last scan counts what
lies below and above each bracket and keeps only the values inside; the wanted
order statistics are then picked by a running count over those few.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import finite, ident, long_form
from .lineage import cut_lineage
from .skew import join_hot_keys

ACCURACY = 10000
#: Rows of a group that may lie in the bracket of one quantile, and so the most that one task orders.
KEPT = 1_000_000
#: Steps of the sketch inside a bracket.
GRID = 1000


def _narrowed(long: DataFrame, sketch: DataFrame, by: list[str], probs: list[float], accuracy: int, kept: int, few_groups: bool) -> DataFrame:
    """``by, _n, _b``: brackets shrunk until each holds at most ``kept`` rows or a single value.

    The brackets of all probabilities are the lower ends, then the upper ends, in ``_b``.
    """
    k = len(probs)
    grid = [i / GRID for i in range(GRID + 1)]
    prob = F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_t.i") + 1)
    while True:
        marked = long.join(F.broadcast(sketch), by) if few_groups else join_hot_keys(long, sketch, by, "_n")
        tags = F.array(*[F.struct(F.lit(i).alias("i"), F.col("_b")[i].alias("lo"), F.col("_b")[k + i].alias("hi")) for i in range(k)])
        rows = marked.where("value is not null").select(*by, "_n", "value", F.explode(tags).alias("_t"))
        inside = F.when(F.col("value").between(F.col("_t.lo"), F.col("_t.hi")), F.col("value"))
        counted = cut_lineage(rows.groupBy(*by, "_n", "_t").agg(
            F.count_if(F.col("value") < F.col("_t.lo")).alias("below"), F.count(inside).alias("here"), F.percentile_approx(inside, grid, max(accuracy, 10 * GRID)).alias("q")))
        open_ = (F.col("here") > kept) & (F.col("_t.lo") < F.col("_t.hi"))
        # the wanted ranks among the rows inside, and two steps around them
        first, last = F.floor((F.col("_n") - 1) * prob) - F.col("below"), F.ceil((F.col("_n") - 1) * prob) - F.col("below")
        at = lambda rank, step: F.get("q", F.least(F.greatest((rank * GRID / F.col("here")).cast("int") + step, F.lit(0)), F.lit(GRID)))
        lo, hi = F.when(open_, at(first, -2)).otherwise(F.col("_t.lo")), F.when(open_, at(last + 1, 2)).otherwise(F.col("_t.hi"))
        ends = F.array_sort(F.collect_list(F.struct(F.col("_t.i").alias("i"), lo.alias("lo"), hi.alias("hi"))))
        moved = F.max((open_ & ((lo > F.col("_t.lo")) | (hi < F.col("_t.hi")))).cast("int"))
        shrunk = counted.groupBy(*by, "_n").agg(ends.alias("e"), moved.alias("_moved"))
        sketch = cut_lineage(shrunk.select(*by, "_n", F.concat(F.transform("e", lambda x: x["lo"]), F.transform("e", lambda x: x["hi"])).alias("_b"), "_moved"))
        again = sketch.agg(F.max("_moved")).first()[0]
        sketch = sketch.drop("_moved")
        if not again:
            return sketch


def long_quantiles(
    long: DataFrame, probs: Sequence[float], by: Sequence[str] = ("column",), accuracy: int = ACCURACY,
    few_groups: bool = True, kept: int = KEPT,
) -> DataFrame:
    """Quantiles of ``value`` per ``by`` of a long table.

    Returns ``by..., n, quantiles`` with one array entry per probability.
    ``few_groups`` says that the number of groups is bounded by the schema (so
    the sketches can be broadcast); pass False for data-dependent groups.
    """
    by, probs = list(by), [float(p) for p in probs]
    slack = 2.0 / accuracy
    lows = [max(p - slack, 0.0) for p in probs]
    highs = [min(p + slack, 1.0) for p in probs]
    sketch = long.groupBy(*by).agg(
        F.count("value").alias("_n"),
        F.percentile_approx("value", lows + highs, accuracy).alias("_b"),
    )
    if few_groups:
        # one row per group, so a local table; otherwise stored, as it is read several times
        sketch = long.sparkSession.createDataFrame(sketch.collect(), sketch.schema)
    else:
        sketch = cut_lineage(sketch)
    if (sketch.agg(F.max("_n")).first()[0] or 0) * 3 * slack > kept:
        sketch = _narrowed(long, sketch, by, probs, accuracy, kept, few_groups)
    if few_groups:
        marked = long.join(F.broadcast(sketch), by)
    else:
        marked = join_hot_keys(long, sketch, by, "_n")
    k = len(probs)
    tagged = []
    for i in range(k):
        side = (
            F.when(F.col("value") < F.col("_b")[i], -1)
            .when(F.col("value") > F.col("_b")[k + i], 1)
            .otherwise(0)
        )
        tagged.append(
            F.struct(
                F.lit(i).alias("i"), side.alias("side"), F.when(side == 0, F.col("value")).alias("v"),
            )
        )
    counted = (
        marked.select(*by, "_n", "value", F.explode(F.array(*tagged)).alias("_t"))
        .groupBy(*by, "_n", F.col("_t.i").alias("_i"), F.col("_t.side").alias("_side"), F.col("_t.v").alias("_v"))
        .agg(F.count("*").alias("_c"), F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    )
    order = W.partitionBy(*by, "_i").orderBy("_side", "_v").rowsBetween(W.unboundedPreceding, 0)
    prob = F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1)
    ranked = (
        counted.withColumn("_end", F.sum("_c").over(order))
        .withColumn("_start", F.col("_end") - F.col("_c"))
        .withColumn("_h", (F.col("_n") - 1) * prob)
        .withColumn("_x", F.when(F.col("_side") < 0, F.col("_hi")).when(F.col("_side") > 0, F.col("_lo")).otherwise(F.col("_v")))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_x")))

    floor, ceil, part = F.floor("_h"), F.ceil("_h"), F.col("_h") - F.floor("_h")
    picked = ranked.groupBy(*by, "_i").agg(
        F.max("_n").alias("n"), at(floor).alias("_a"), at(ceil).alias("_z"), F.max(part).alias("_f")
    )
    value = F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f")
    return picked.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("_i", value.alias("q")))), lambda s: s["q"]).alias("quantiles"),
    )


#: Columns whose sketches and brackets one wide aggregate takes together.
WIDE = 16


def wide_quantiles(df: DataFrame, values: Sequence[Column], probs: Sequence[float], accuracy: int = ACCURACY, kept: int = KEPT) -> list[tuple[int, list[float]]] | None:
    """``(n, quantiles)`` of each double column of ``values`` (``(0, [])`` if all are null), or None if a bracket may hold too many rows.

    One aggregate sketches all columns side by side; a second counts the values in the brackets one by one and the
    stretches around them as wholes.
    """
    out, probs, slack = [], [float(p) for p in probs], 2.0 / accuracy
    ends = [max(p - slack, 0.0) for p in probs] + [min(p + slack, 1.0) for p in probs]
    for start in range(0, len(values), WIDE):
        names = [f"_q{i}" for i in range(len(values[start: start + WIDE]))]
        rows = df.select(*[v.alias(c) for c, v in zip(names, values[start:])])
        s = rows.agg(*[x for c in names for x in (F.count(c).alias(f"n{c}"), F.percentile_approx(c, ends, accuracy).alias(f"b{c}"))]).first()
        if max(s[f"n{c}"] for c in names) * 3 * slack > kept:
            return None
        spans = {c: sorted(zip(s[f"b{c}"], s[f"b{c}"][len(probs):])) for c in names if s[f"n{c}"]}
        heights = {c: [(s[f"n{c}"] - 1) * p for p in probs] for c in spans}
        at = _order_statistics(rows, spans, {c: {k for x in h for k in (math.floor(x), math.ceil(x))} for c, h in heights.items()})
        for c in names:
            ends_of = [(x, at[c, math.floor(x)], at[c, math.ceil(x)]) for x in heights.get(c, [])]
            out.append((s[f"n{c}"], [lo + (hi - lo) * (x - math.floor(x)) for x, lo, hi in ends_of]))
    return out


def _order_statistics(rows: DataFrame, spans: dict[str, list[tuple[float, float]]], ranks: dict[str, set[int]]) -> dict[tuple[str, int], float]:
    """The values of the wanted ``ranks`` of each column, which lie in its brackets or next to them."""
    if not spans:
        return {}
    parts = []
    for i, (c, found) in enumerate(spans.items()):
        apart = []
        for lo, hi in found:
            if apart and lo <= apart[-1][1]:
                apart[-1][1] = max(hi, apart[-1][1])
            else:
                apart.append([lo, hi])
        # odd places are brackets, even ones the stretches around them
        place = sum(((F.col(c) >= lo).cast("int") + (F.col(c) > hi).cast("int") for lo, hi in apart), F.lit(0))
        parts += [F.lit(i), place, F.when(place % 2 == 1, F.col(c)), F.col(c)]
    long = rows.select(F.stack(F.lit(len(spans)), *parts).alias("i", "place", "v", "x")).where("x is not null")
    counts = long.groupBy("i", "place", "v").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    end = F.sum("n").over(W.partitionBy("i").orderBy("place", "v").rowsBetween(W.unboundedPreceding, 0))
    names = list(spans)
    wanted = rows.sparkSession.createDataFrame([(i, k) for i, c in enumerate(names) for k in ranks[c]], "i int, k long")
    hit = counts.withColumn("end", end).join(F.broadcast(wanted), "i").where((F.col("end") - F.col("n") <= F.col("k")) & (F.col("k") < F.col("end")))
    value = F.when(F.col("k") == F.col("end") - F.col("n"), F.col("lo")).otherwise(F.col("hi"))
    return {(names[r["i"]], r["k"]): r["value"] for r in hit.select("i", "k", value.alias("value")).collect()}


def column_quantiles(
    df: DataFrame, columns: Iterable[str], probs: Sequence[float], by: Sequence[str] = (), value=finite,
) -> DataFrame:
    """``by..., column, n, quantiles`` for several columns in two scans."""
    columns = list(columns)
    if columns and not by:
        found = _wide(df, columns, probs, value)
        if found is not None:
            return df.sparkSession.createDataFrame([(c, n, q) for c, (n, q) in found.items()], "column string, n long, quantiles array<double>")
    long = long_form(df, columns, by, value)
    return long_quantiles(long, probs, [*by, "column"], few_groups=not by)


def _wide(df: DataFrame, columns: Sequence[str], probs: Sequence[float], value) -> dict[str, tuple[int, list[float]]] | None:
    values = [value(c) for c in columns]
    if any(f.dataType != T.DoubleType() for f in df.select(*values).schema):
        return None
    found = wide_quantiles(df, values, probs)
    return found and {c: x for c, x in zip(columns, found) if x[0]}


def quantile_map(df: DataFrame, columns: Sequence[str], probs: Sequence[float], value=finite) -> dict[str, list[float]]:
    """Quantiles as driver numbers: one bounded row per column."""
    if not columns:
        return {}
    found = _wide(df, list(columns), probs, value)
    if found is not None:
        return {c: q for c, (_, q) in found.items()}
    rows = column_quantiles(df, columns, probs, value=value).collect()
    return {r["column"]: list(r["quantiles"]) for r in rows}


def quantile_columns(names: Sequence[str], array: str = "quantiles") -> list[Column]:
    return [F.col(array)[i].alias(n) for i, n in enumerate(names)]


def right_closed_bin(value: Column, edges: Sequence[float]) -> Column:
    """Bin number for bins (e0, e1], (e1, e2] ... with both outer edges open-ended."""
    out = F.lit(0)
    for e in edges[1:-1]:
        out = out + (value > F.lit(float(e))).cast("int")
    return F.when(value.isNotNull(), out)


def left_closed_bin(value: Column, edges: Sequence[float]) -> Column:
    """Bin number for bins [e0, e1), [e1, e2) ... with both outer edges open-ended."""
    out = F.lit(0)
    for e in edges[1:-1]:
        out = out + (value >= F.lit(float(e))).cast("int")
    return F.when(value.isNotNull(), out)


def distinct_edges(values: Iterable[float]) -> list[float]:
    return sorted(set(values))


__all__ = [
    "column_quantiles", "distinct_edges", "ident", "left_closed_bin", "long_quantiles",
    "quantile_columns", "quantile_map", "right_closed_bin", "wide_quantiles",
]
