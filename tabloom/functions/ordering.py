"""Running totals over a global order, split over many tasks.

A window ordered without a partition key runs in one task.  Here the ordered
values are cut into buckets by a tree of approximate quantiles, the running
total is taken inside each bucket and shifted by the totals of the buckets
before it.  Those are summed in two steps of bounded windows, as buckets grow
with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cuts import place
from .lineage import cut_lineage

BUCKETS = 1024
SMALL = 100_000


def running_totals(
    df: DataFrame, order: str, sums: Sequence[str], by: Sequence[str] = (), buckets: int = BUCKETS, small: int = SMALL,
) -> DataFrame:
    """Add ``cum_<s>`` (running sum up to and including the row) and ``next_<order>``.

    ``df`` holds one row per (by, order); ``by`` must be bounded by the schema
    (column names, model names), not by the data.  Keys with at most ``small``
    rows keep a single bucket; larger ones get about ``small`` rows per bucket.
    """
    by, sums = list(by), list(sums)
    df = df.select(*by, order, *sums, *[c for c in df.columns if c not in {*by, order, *sums}])
    placed, split = place(df, F.col(order), by, "_bucket", small, buckets)
    inside = W.partitionBy(*by, "_bucket").orderBy(order)
    run = inside.rowsBetween(W.unboundedPreceding, 0)
    if not split:
        return placed.select(
            *df.columns, *[F.sum(s).over(run).alias(f"cum_{s}") for s in sums],
            F.lead(order).over(inside).alias(f"next_{order}"),
        )
    offsets = _bucket_offsets(placed, order, sums, by, buckets)
    same = placed["_bucket"] == offsets["_o_bucket"]
    for b in by:
        same = same & placed[b].eqNullSafe(offsets[f"_o_{b}"])
    return placed.join(offsets, same).select(
        *[placed[c] for c in df.columns], *[(F.sum(s).over(run) + F.col(f"_t_{s}")).alias(f"cum_{s}") for s in sums],
        F.coalesce(F.lead(order).over(inside), F.col("_next_first")).alias(f"next_{order}"),
    )


def _bucket_offsets(placed: DataFrame, order: str, sums: list[str], by: list[str], chunk: int) -> DataFrame:
    """Totals of all earlier buckets and the first value of the next one, per bucket, in columns ``_o_``, ``_t_``.

    Buckets are numbered and gathered in runs of ``chunk``: totals inside a run and totals of the runs before it.
    """
    rows = cut_lineage(placed.groupBy(*by, "_bucket").agg(F.min(order).alias("_first"), *[F.sum(s).alias(f"_s_{s}") for s in sums]))
    rows = rows.withColumn("_run", F.floor(F.col("_bucket") / chunk))
    own, runs = W.partitionBy(*by, "_run").orderBy("_bucket"), W.partitionBy(*by).orderBy("_run")
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    whole = rows.groupBy(*by, "_run").agg(F.min(F.struct("_bucket", "_first"))["_first"].alias("_run_first"), *[F.sum(f"_s_{s}").alias(f"_r_{s}") for s in sums])
    whole = whole.select(
        *[F.col(b).alias(f"_w_{b}") for b in by], F.col("_run").alias("_w_run"), F.lead("_run_first").over(runs).alias("_after"),
        *[before(f"_r_{s}", runs).alias(f"_b_{s}") for s in sums])
    inside = rows.select(*by, "_bucket", "_run", F.lead("_first").over(own).alias("_next"), *[before(f"_s_{s}", own).alias(f"_i_{s}") for s in sums])
    same = F.col("_run") == F.col("_w_run")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_w_{b}"))
    return inside.join(whole, same).select(
        *[F.col(b).alias(f"_o_{b}") for b in by], F.col("_bucket").alias("_o_bucket"), F.coalesce("_next", "_after").alias("_next_first"),
        *[(F.col(f"_i_{s}") + F.col(f"_b_{s}")).alias(f"_t_{s}") for s in sums])
