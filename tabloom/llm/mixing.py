"""Mixing sources to target weights by hierarchical budgeting over a domain, language, source tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import SPACES, stored

LEVELS = ("domain", "lang", "source")
#: Documents of a leaf are ordered by a hash; equal ranges of the hash hold about this many rows each.
ROWS_PER_RANGE = 5_000


def word_count(text: Column) -> Column:
    """Words of a text (null: 0), runs of anything but the ASCII white-space characters."""
    spaced = F.trim(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)))
    return F.when(spaced == "", 0).otherwise(F.size(F.split(spaced, " +"))).cast("long")


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Fill ``given``, the parent's budget, into its children by ``weight``, each up to ``room``; adds ``budget``.

    In order of room per weight, children that cannot take their share get their room; the others divide the rest by
    weight, in whole tokens.
    """
    w = Window.partitionBy(*parent)
    before = w.orderBy(F.col("room") / F.col("weight"), "name").rowsBetween(Window.unboundedPreceding, -1)
    ranked = nodes.withColumns({
        "room_before": F.coalesce(F.sum("room").over(before), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "weights": F.sum("weight").over(w)})
    full = F.col("room") * (F.col("weights") - F.col("weight_before")) <= F.col("weight") * (F.col("given") - F.col("room_before"))
    marked = ranked.withColumn("full", full)
    filled = marked.withColumns({
        "room_full": F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(w), F.lit(0)),
        "weight_open": F.sum(F.when(~F.col("full"), F.col("weight"))).over(w)})
    part = F.floor((F.col("given") - F.col("room_full")) * F.col("weight") / F.col("weight_open"))
    return filled.withColumn("budget", F.when(F.col("full"), F.col("room")).otherwise(F.least("room", F.greatest(part, F.lit(0)))).cast("long"))


def leaf_budgets(leaves: DataFrame, total: int, weights: dict[tuple, float], epochs: int) -> DataFrame:
    """``(domain, lang, source, budget)`` from ``leaves(domain, lang, source, tokens)``.

    ``weights`` maps a path ``(domain,)``, ``(domain, lang)`` or ``(domain, lang, source)`` to its weight among its
    siblings (1 if absent; above 0). A node's room is ``epochs`` times the tokens below it, so a shortage is made up
    by siblings first and reaches other branches only when the whole branch is full.
    """
    if any(x <= 0 for x in weights.values()):
        raise ValueError("weights must be above 0")
    spark, up = leaves.sparkSession, None
    for depth, level in enumerate(LEVELS, 1):
        path = list(LEVELS[:depth])
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * epochs).alias("room")).withColumn("name", F.col(level))
        own = [(*k, float(x)) for k, x in weights.items() if len(k) == depth]
        if own:
            given = spark.createDataFrame(own, ", ".join(f"w_{p} string" for p in path) + ", w double")
            nodes = nodes.join(given, [nodes[p].eqNullSafe(given[f"w_{p}"]) for p in path], "left").select(nodes["*"], F.coalesce("w", F.lit(1.0)).alias("weight"))
        else:
            nodes = nodes.withColumn("weight", F.lit(1.0))
        if up is None:
            nodes = nodes.withColumn("given", F.lit(total).cast("long"))
        else:
            back = up.select(*[F.col(p).alias(f"u_{p}") for p in path[:-1]], F.col("budget").alias("given"))
            nodes = nodes.join(back, [nodes[p].eqNullSafe(back[f"u_{p}"]) for p in path[:-1]]).drop(*[f"u_{p}" for p in path[:-1]])
        up = _share(nodes, path[:-1]).select(*path, "budget")
    return up


def mix(docs: DataFrame, tokens: Column, domain: Column, weights: dict[tuple, float], fraction: float, epochs: int, seed: int,
        id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(row, domain, lang, source, epoch)``: each selected document once per epoch, ``row`` being all its columns.

    The whole budget is ``fraction`` of all tokens. A leaf with budget ``b`` and ``t`` tokens takes all its documents
    in ``b div t`` epochs, and in the next epoch the longest prefix of its documents, in the order of a hash of seed,
    epoch and id, whose tokens fit in the rest. Nulls in lang, source or domain are values of their own; a leaf
    without tokens gives its documents in every epoch that it is granted, which is all of them. Repeated rows count
    and are drawn row by row. Leaves are cut into hash ranges: only the range in which a budget ends is sorted.
    """
    path = list(LEVELS)
    small = stored(docs.select(F.col(id_col).cast("string").alias("id"), domain.alias("domain"), F.col(lang_col).alias("lang"),
                               F.col(source_col).alias("source"), tokens.cast("long").alias("tokens")), "mix-tokens")
    leaves = stored(small.groupBy(*path).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "mix-leaves")
    whole = leaves.agg(F.sum("tokens")).first()[0] or 0
    budgets = leaf_budgets(leaves, int(fraction * whole), weights, epochs).withColumnsRenamed({p: f"b_{p}" for p in path})
    plan = leaves.join(budgets, [leaves[p].eqNullSafe(budgets[f"b_{p}"]) for p in path]).select(
        *[F.col(p).alias(f"l_{p}") for p in path], "budget",
        F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(epochs).alias("whole_epochs"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).alias("rest"),
        F.ceil(F.col("n") / ROWS_PER_RANGE).alias("ranges"))
    plan = stored(plan, "mix-plan")

    def ranged(df: DataFrame) -> DataFrame:
        """Add the leaf's plan, the document's place in the partial epoch and the hash range of that place."""
        with_plan = df.join(plan, [df[p].eqNullSafe(plan[f"l_{p}"]) for p in path])
        place = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole_epochs").cast("string"), F.coalesce("id", F.lit("null"))))
        return with_plan.withColumn("place", place).withColumn(
            "range", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(1 << 32)))

    held = ranged(small).groupBy(*path, "range").agg(F.sum("tokens").alias("held"), F.first("rest").alias("rest"))
    w = Window.partitionBy(*path).orderBy("range")
    ends = held.withColumn("upto", F.sum("held").over(w)).select(
        *[F.col(p).alias(f"r_{p}") for p in path], F.col("range").alias("r_range"), (F.col("upto") - F.col("held")).alias("before"), "upto")
    ends = stored(ends, "mix-ranges")

    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("string").alias("id"), domain.alias("domain"),
                       F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), tokens.cast("long").alias("tokens"))
    placed = ranged(rows)
    same = [placed[p].eqNullSafe(ends[f"r_{p}"]) for p in path] + [placed["range"] == ends["r_range"]]
    placed = placed.join(ends, same)
    keep = [*path, "row", "whole_epochs"]
    before = Window.partitionBy(*path, "range").orderBy("place", "id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.where((F.col("upto") <= F.col("rest")) & (F.col("rest") > 0)).select(*keep)
    border = (
        placed.where((F.col("before") <= F.col("rest")) & (F.col("upto") > F.col("rest")) & (F.col("rest") > 0))
        .withColumn("run", F.sum("tokens").over(before) + F.col("before")).where(F.col("run") <= F.col("rest")).select(*keep)
    )
    every = placed.where("whole_epochs > 0").select(*keep, F.explode(F.sequence(F.lit(0), F.col("whole_epochs").cast("int") - 1)).alias("epoch"))
    partial = inside.unionAll(border).select(*keep, F.col("whole_epochs").cast("int").alias("epoch"))
    return every.unionAll(partial).select("row", *path, "epoch")
