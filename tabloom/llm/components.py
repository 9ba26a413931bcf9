"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.lineage import cut_lineage
from tabloom.functions.skew import join_hot_keys


#: Edges of a partition of a checkpoint: a small table isn't written as hundreds of tiny files, round after round.
EDGES_PER_FILE = 200_000


def _cut(df: DataFrame, files: int) -> DataFrame:
    return cut_lineage(df.coalesce(files))


def _large_star(edges: DataFrame, files: int) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _cut(both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")).withColumn("low", F.least("a", "low")), files)
    return join_hot_keys(both, least, ["a"], "n").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame, files: int) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them (``edges`` go from large to small)."""
    least = _cut(edges.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")), files)
    moved = join_hot_keys(edges, least, ["a"], "n").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionAll(least.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``edges(a, b)``; the component is its smallest node.

    Runs until a round changes nothing. Hubs are aggregated map-side, and the edges of a hub stay where they lie: the
    smallest node around it travels to them. Each round ends in a reliable checkpoint. Self loops and nulls are ignored;
    an empty edge table gives an empty result.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    e, seen = cut_lineage(e), None
    # rounds never add edges
    files = max(1, -(-e.count() // EDGES_PER_FILE))
    e = e.coalesce(files)
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            break
        seen = now
        e = _cut(_small_star(_cut(_large_star(e, files), files), files), files)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
