"""Ordered row blocks: windows over a long series without one task per series.

The order axis is cut at approximate quantiles of the whole table, so a series
holding a third of all rows is spread over about a third of the blocks, and the
number of blocks grows with the rows.  Rows
just before a block travel along as halo rows, which makes frames that look
back a fixed number of rows exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cuts import place

BLOCKS = 1024
SMALL = 100_000


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def with_halo(
    df: DataFrame, axis: Column, order: Sequence[str], by: Sequence[str], back: int,
    blocks: int = BLOCKS, small: int = SMALL,
) -> DataFrame:
    """``df`` plus ``_block`` and ``_halo``: each block is preceded by the ``back`` rows before it."""
    by = list(by)
    placed, split = place(df, axis, (), "_block", small, blocks)
    if not split:
        return placed.withColumn("_halo", F.lit(False))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    latest = W.partitionBy(*by, "_block").orderBy(*[F.col(f"`{c}`").desc() for c in order])
    tails = (
        placed.select(*by, "_block", row.alias("_row"), F.row_number().over(latest).alias("_rn"))
        .where(F.col("_rn") <= back)
        .groupBy(*by, "_block")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_rn")).alias("k"), "_row"))), lambda s: s["_row"]).alias("_rows"))
    )
    # every block named here has a row, so the last `back` blocks before one hold its halo
    before = W.partitionBy(*by).orderBy("_block").rowsBetween(-back, -1)
    halo = (
        tails.select("_block", F.flatten(F.collect_list("_rows").over(before)).alias("_all"))
        .select("_block", F.explode(F.slice("_all", F.greatest(F.size("_all") - back + 1, F.lit(1)), F.lit(back))).alias("_row"))
        .select("_row.*", "_block", F.lit(True).alias("_halo"))
    )
    return placed.withColumn("_halo", F.lit(False)).unionByName(halo)
