"""Point-in-time join: each event takes the latest feature row at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.blocks import BLOCKS, SMALL, micros
from ..functions.columns import ident
from ..functions.cuts import place


def asof_join(
    events: DataFrame, features: DataFrame, entity: str, event_time: str, feature_time: str,
    ttl_seconds: float | None = None, blocks: int = BLOCKS, small: int = SMALL,
) -> DataFrame:
    """Backward, inclusive as-of join per entity; events without a match keep NULL features.

    Both sides are stacked and one window per (entity, time block) carries the
    latest feature forward.  What a block inherits comes from a carry table with
    one row per (entity, block), so a hot entity is never one long window.
    """
    extra = [c for c in features.columns if c != entity]
    clash = set(extra) & set(events.columns)
    if clash:
        raise ValueError(f"feature columns clash with event columns: {sorted(clash)}")
    left = events.select(
        ident(entity).alias("_k"), ident(event_time).cast("timestamp").alias("_t"), F.lit(1).alias("_side"),
        F.struct(*[ident(c) for c in events.columns]).alias("_e"),
    )
    right = features.where(ident(entity).isNotNull() & ident(feature_time).isNotNull()).select(
        ident(entity).alias("_k"), ident(feature_time).cast("timestamp").alias("_t"), F.lit(0).alias("_side"),
        F.struct(*[ident(c) for c in extra]).alias("_f"),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    axis = micros(F.col("_t"))
    both, _ = place(both, axis, (), "_b", small, blocks)
    order = W.partitionBy("_k", "_b").orderBy("_t", "_side", "_f").rowsBetween(W.unboundedPreceding, 0)
    local = both.withColumn("_m", F.last("_f", ignorenulls=True).over(order)).where("_side = 1")
    latest = both.groupBy("_k", "_b").agg(F.max(F.when(F.col("_side") == 0, F.struct("_t", "_f"))).alias("_last"))
    earlier = W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = latest.select("_k", "_b", F.last("_last", ignorenulls=True).over(earlier)["_f"].alias("_c"))
    found = local.join(carry, ["_k", "_b"], "left").withColumn("_m", F.coalesce("_m", "_c"))
    match = F.col("_m")
    if ttl_seconds is not None:
        age = (micros(F.col("_t")) - micros(match[feature_time])) / 1e6
        match = F.when(age <= ttl_seconds, match)
    return found.select("_e.*", match.alias("_m")).select(*[ident(c) for c in events.columns], "_m.*")
