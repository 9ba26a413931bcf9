"""Equi-joins that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it carries more than 1/HOT_PARTS of the total weight, so at
# most HOT_PARTS keys can be hot: the broadcast side is bounded whatever the data.
HOT_PARTS = 1000
# Whatever the total, a key with more rows than a task should hold is hot as well; there are at most rows / HOT_ROWS.
HOT_ROWS = 10_000_000


def join_hot_keys(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    weight: str,
    hot_parts: int = HOT_PARTS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Inner join ``left`` with ``right`` (one row per key) without a hot shuffle partition.

    ``weight`` is a column of ``right`` holding how many left rows share the key.
    Up to ``hot_parts`` keys in all: one broadcast join.  Otherwise hot keys
    (fewer than ``hot_parts``, by counting) are joined by broadcast where they
    lie and the others through a shuffled join.  Without hot keys it is the
    plain shuffled join.  ``sizes`` may name a cheaper table with the same keys
    and weights to look for hot keys in.
    """
    keys = list(keys)
    size = (right if sizes is None else sizes).agg(F.count("*").alias("keys"), F.sum(weight).alias("rows"), F.max(weight).alias("top")).first()
    if size["keys"] <= hot_parts:
        return left.join(F.broadcast(right), keys)
    cutoff = min(float(size["rows"]) / hot_parts, float(HOT_ROWS))
    if size["top"] <= cutoff:
        return left.join(right, keys)
    hot = right.where(F.col(weight) > cutoff)
    cold = right.where(F.col(weight) <= cutoff)
    on_hot = left.join(F.broadcast(hot), keys)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return on_hot.unionByName(rest.join(cold, keys))


def spread(weight: str, per_slot: float):
    """Number of slots a key of the given weight is split into (at least one)."""
    return F.greatest(F.ceil(F.col(weight) / F.lit(float(per_slot))), F.lit(1)).cast("int")
