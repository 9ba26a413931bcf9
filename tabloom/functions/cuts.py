"""Cut points on an ordered axis and the place of a value among them.

An axis is cut by a tree: at most ``MAX_CUTS`` parts at the top, chosen by one bounded sketch, and each part that still
holds too many rows again in as many. So the number of buckets follows the rows, and no sketch or list of cuts does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut_lineage

MAX_CUTS = 1024
FLAT = 32
#: Levels of a tree at most: enough for a million million buckets. A part of one repeated value can't be cut.
LEVELS = 4


def probabilities(count: int = MAX_CUTS) -> list[float]:
    return [i / count for i in range(1, count)]


def thinned(cuts: Sequence, rows: int, per_part: int, most: int = MAX_CUTS) -> list:
    """Evenly chosen distinct cuts giving about ``per_part`` rows between neighbours, at most ``most`` parts."""
    cuts = sorted(set(cuts))
    want = min(most, max(1, -(-rows // max(1, per_part)))) - 1
    if want <= 0 or not cuts:
        return []
    if len(cuts) <= want:
        return cuts
    return [cuts[(i + 1) * len(cuts) // (want + 1)] for i in range(want)]


def position(value: Column, cuts: Sequence, inclusive: bool = False) -> Column:
    """How many cuts lie below ``value`` (or at it, when inclusive).

    Up to FLAT cuts are compared one by one in generated code; more are looked
    up in two steps of about the square root of their number.
    """
    def above(c):
        return value >= c if inclusive else value > c

    def count(items) -> Column:
        out = F.lit(0)
        for c in items:
            out = out + above(F.lit(c)).cast("int")
        return out

    if len(cuts) <= FLAT:
        return count(cuts)
    width = int(len(cuts) ** 0.5) + 1
    chunks = [list(cuts[i: i + width]) for i in range(0, len(cuts), width)]
    coarse = count([c[0] for c in chunks])
    nested = F.array(*[F.array(*[F.lit(c) for c in chunk]) for chunk in chunks])
    fine = F.size(F.filter(F.get(nested, coarse - 1), above_item(value, inclusive)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * width + fine)


def above_item(value: Column, inclusive: bool):
    return (lambda c: c <= value) if inclusive else (lambda c: c < value)


def place(df: DataFrame, axis: Column, by: Sequence[str], name: str, small: int, fanout: int = MAX_CUTS) -> tuple[DataFrame, bool]:
    """``df`` with bucket numbers ``name`` that rise with ``axis`` in each group, and whether anything was cut.

    A bucket gets about ``small`` rows, whatever their number, in up to ``LEVELS`` levels of ``fanout`` parts each.
    ``by`` must be bounded by the schema (column names), not by the data. Nulls come first.
    """
    by, small = list(by), max(1, small)
    sizes = df.groupBy(*by).agg(F.count(axis).alias("n"), F.percentile_approx(axis, probabilities(fanout), 20 * fanout).alias("cuts")).collect()
    split = [(r, thinned(r["cuts"] or [], r["n"], small, fanout)) for r in sizes if r["n"] > small]
    at = F.lit(0)
    for r, cuts in split:
        mine = F.lit(True)
        for b in by:
            mine = mine & F.col(b).eqNullSafe(F.lit(r[b]))
        at = F.when(mine, F.coalesce(position(axis, cuts), F.lit(0))).otherwise(at)
    placed = df.withColumn(name, at.cast("long"))
    # a group of more rows than one level can part goes on to the next
    if not any(r["n"] > small * fanout for r, _ in split):
        return placed, bool(split)
    for _ in range(LEVELS - 1):
        keys = [*by, name]
        large = placed.groupBy(*keys).agg(F.count(axis).alias("_n"), F.percentile_approx(axis, probabilities(fanout), 20 * fanout).alias("_all")).where(F.col("_n") > 2 * small)
        parts = F.least(F.ceil(F.col("_n") / small), F.lit(fanout)).cast("int")
        chosen = F.array_distinct(F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.get("_all", (i * fanout / parts).cast("int") - 1)))
        large = cut_lineage(large.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], chosen.alias("_cuts")))
        if large.isEmpty():
            break
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_g{i}"))
        # cuts of a part in chunks, so that a value is compared with few of them
        width = int(fanout**0.5) + 1
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_cuts") - 1) / width)), lambda i: F.slice("_cuts", (i * width + 1).cast("int"), width))
        large = large.withColumn("_cuts", F.when(F.size("_cuts") > 0, chunks))
        coarse = F.size(F.filter("_cuts", lambda c: c[0] < axis))
        fine = F.when(coarse > 0, (coarse - 1) * width + F.size(F.filter(F.get("_cuts", coarse - 1), lambda c: c < axis))).otherwise(0)
        joined = placed.join(large, same, "left")
        placed = joined.withColumn(name, F.col(name) * (fanout + 1) + F.when(F.col("_cuts").isNotNull() & axis.isNotNull(), fine).otherwise(0)).select(*df.columns, name)
    return placed, True
