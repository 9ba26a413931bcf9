"""Entity graphs from two columns: degrees, PageRank, components, betweenness and clustering.

Iterative jobs hold one small state table per round and cut its lineage with a
reliable checkpoint.  Edges of a hub are spread over slots, so no round sends a
hub's whole neighbourhood to one task.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import finite, ident
from ..functions.hashing import uniform
from ..functions.lineage import cut_lineage
from ..functions.skew import join_hot_keys, spread

SLOT_EDGES = 50_000
#: Rows of state of a batch of sources, and out-neighbours of a slot.
STATE_ROWS, WEDGE_ENDS = 50_000_000, 2_000


def edges(df: DataFrame, source: str, target: str, weight: str | None = None) -> DataFrame:
    """``u, v, weight`` with u <= v, one row per unordered pair, weights summed (missing weight = 1)."""
    a, b = ident(source).cast("string"), ident(target).cast("string")
    w = F.coalesce(finite(weight), F.lit(1.0)) if weight else F.lit(1.0)
    rows = df.select(a.alias("a"), b.alias("b"), w.alias("w")).where("a is not null and b is not null")
    return rows.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("w").alias("weight"))


def both_ways(e: DataFrame) -> DataFrame:
    """``src, dst, weight``: each edge in both directions, loops once."""
    pairs = F.when(F.col("u") == F.col("v"), F.array(F.struct(F.col("u").alias("s"), F.col("v").alias("d")))).otherwise(
        F.array(F.struct(F.col("u").alias("s"), F.col("v").alias("d")), F.struct(F.col("v").alias("s"), F.col("u").alias("d")))
    )
    return e.select(F.explode(pairs).alias("p"), "weight").select(F.col("p.s").alias("src"), F.col("p.d").alias("dst"), "weight")


def degrees(e: DataFrame) -> DataFrame:
    """``node, degree, degree_centrality``; a loop counts twice."""
    ends = e.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    n = ends.agg(F.count("*")).scalar()
    return ends.select("node", "degree", F.coalesce(F.try_divide(F.col("degree").cast("double"), n - 1), F.lit(0.0)).alias("degree_centrality"))


def summary(e: DataFrame, components_of: DataFrame) -> DataFrame:
    """Nodes, edges, density, number of components and whether there is only one."""
    s = components_of.agg(F.count("*").alias("nodes"), F.count_distinct("component").alias("components"))
    m = e.agg(F.count("*")).scalar()
    density = F.coalesce(F.try_divide(2.0 * m, F.col("nodes").cast("double") * (F.col("nodes") - 1)), F.lit(0.0))
    return s.select("nodes", m.alias("edges"), density.alias("density"), "components", (F.col("components") == 1).alias("connected"))


def pagerank(e: DataFrame, damping: float = 0.85, tol: float = 1e-6) -> DataFrame:
    """``node, pagerank``: weighted power iteration until the summed change falls below nodes x tol."""
    out = both_ways(e)
    nodes = out.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("strength"), F.count("*").alias("deg")).withColumn(
        "slots", spread("deg", SLOT_EDGES)
    )
    nodes = cut_lineage(nodes)
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("pagerank"))
    share = join_hot_keys(out.withColumnRenamed("src", "node"), nodes, ["node"], "deg").select(
        "node", F.pmod(F.xxhash64("dst"), F.col("slots")).cast("int").alias("slot"), "dst", (F.col("weight") / F.col("strength")).alias("share")
    )
    links = share.repartition("node", "slot").persist(StorageLevel.MEMORY_AND_DISK)
    rank = nodes.select("node", "slots", F.lit(1.0 / n).alias("rank"))
    base = (1.0 - damping) / n
    while True:
        sent = rank.select("node", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), "rank")
        got = links.join(sent, ["node", "slot"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        step = rank.join(got, "node", "left").select(
            "node", "slots", F.col("rank").alias("old"), (F.lit(base) + damping * F.coalesce("in", F.lit(0.0))).alias("rank")
        )
        # the change is summed by the job that writes the round, so a round is one job
        seen = Observation()
        rank = cut_lineage(step.observe(seen, F.sum(F.abs(F.col("rank") - F.col("old"))).alias("change"))).drop("old")
        if seen.get["change"] < n * tol:
            break
    links.unpersist()
    return rank.select("node", F.col("rank").alias("pagerank"))


def components(e: DataFrame) -> DataFrame:
    """``node, component``: smallest node name of each connected component.

    Alternating large-star and small-star rounds: the number of rounds grows
    with the logarithm of the component size, not with its diameter.
    """
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = cut_lineage(e.where("u <> v").select(F.col("v").alias("a"), F.col("u").alias("b")).distinct())
    seen = None
    while True:
        links = _star(_star(links, large=True), large=False)
        links = cut_lineage(links)
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    return nodes.join(links.select(F.col("a").alias("node"), "b"), "node", "left").select("node", F.coalesce("b", "node").alias("component"))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star round over pairs a > b: attach neighbours (larger, or smaller ones) to the smallest neighbour."""
    if large:
        around = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = links
    low = around.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("deg")).withColumn("m", F.least("a", "m"))
    x = join_hot_keys(around, low, ["a"], "deg")
    if large:
        return x.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    moved = x.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def communities(components_of: DataFrame, top: int = 5, samples: int = 5) -> DataFrame:
    """The largest components with a few member names."""
    sizes = components_of.groupBy("component").agg(F.count("*").alias("members")).orderBy(F.col("members").desc(), "component").limit(top)
    w = W.partitionBy("component").orderBy("node")
    # only the chosen components are ranked, and each task keeps no more than `samples` rows per component
    few = components_of.join(F.broadcast(sizes.select("component")), "component").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= samples)
    names = few.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("sample"))
    return sizes.join(names, "component")


# ---- betweenness ----


def betweenness(e: DataFrame, pivots: int | None = None, seed: int = 42, state_rows: int = STATE_ROWS) -> DataFrame:
    """``node, betweenness`` (normalised) with weights as distances.

    Exact, or from a seeded hash sample of ``pivots`` source nodes. Weights must be above 0: edges without length
    would make the shortest paths a cycle. Sources go in batches, so that a batch holds about ``state_rows`` rows of
    (source, node) at most, and only the sum per node outlives it. Edges of a hub are spread over slots.
    """
    if not e.where("u <> v and weight <= 0").isEmpty():
        raise ValueError("betweenness needs weights above 0")
    ends = e.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("deg"))
    nodes = cut_lineage(ends.withColumn("slots", spread("deg", SLOT_EDGES)))
    n = nodes.count()
    if n <= 2:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    far = nodes.select(F.col("node").alias("dst"), F.col("slots").alias("dst_slots"), F.col("deg").alias("dst_deg"))
    near = nodes.select(F.col("node").alias("src"), "slots", F.col("deg").alias("src_deg"))
    links = join_hot_keys(join_hot_keys(both_ways(e).where("src <> dst"), far, ["dst"], "dst_deg"), near, ["src"], "src_deg")
    links = cut_lineage(links.select("src", F.pmod(F.xxhash64("dst"), "slots").cast("int").alias("slot"), "dst", "dst_slots", "weight"))
    k = n if pivots is None else min(pivots, n)
    chosen = nodes.orderBy(uniform("node", seed=seed), "node").limit(k) if k < n else nodes
    chosen = cut_lineage(chosen.select(F.col("node").alias("s"), "node", "slots"))
    batches, total = max(1, -(-k * n // state_rows)), None
    for i in range(batches):
        part = _dependencies(links, chosen.where(F.pmod(F.xxhash64("s", F.lit(seed)), F.lit(batches)) == i))
        total = part if total is None else cut_lineage(total.unionByName(part).groupBy("node").agg(F.sum("b").alias("b")))
    scale = 1.0 / ((n - 1.0) * (n - 2.0)) * (n / k if k < n else 1.0)
    return nodes.select("node").join(total, "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def _dependencies(links: DataFrame, sources: DataFrame) -> DataFrame:
    """``node, b``: dependencies of all ``sources(s, node, slots)`` on each other node, summed.

    The sources advance together: distances by relaxation rounds, then path counts forward and dependencies backward
    over the shortest-path edges.
    """
    dist = cut_lineage(sources.select("s", "node", "slots", F.lit(0.0).alias("d")))
    active = dist
    while True:
        sent = active.select("s", F.col("node").alias("src"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), "d")
        step = sent.join(links, ["src", "slot"]).select("s", F.col("dst").alias("node"), F.col("dst_slots").alias("slots"), (F.col("d") + F.col("weight")).alias("d"))
        best = dist.withColumn("old", F.lit(True)).unionByName(step.withColumn("old", F.lit(False))).groupBy("s", "node").agg(
            F.max("slots").alias("slots"), F.min("d").alias("d"), F.min(F.when(F.col("old"), F.col("d"))).alias("was")
        )
        best = cut_lineage(best.withColumn("moved", F.col("was").isNull() | (F.col("d") < F.col("was"))))
        active, dist = best.where("moved").select("s", "node", "slots", "d"), best.select("s", "node", "slots", "d")
        if active.isEmpty():
            break
    near = dist.select("s", F.col("node").alias("src"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.col("d").alias("ds"))
    dag = links.join(near, ["src", "slot"]).join(dist.select("s", F.col("node").alias("dst"), F.col("d").alias("dd")), ["s", "dst"]).where(
        F.col("ds") + F.col("weight") == F.col("dd")
    ).select("s", "src", "dst")
    dag = cut_lineage(dag)
    paths = _walk(dag, sources.select("s", "node", F.lit(1.0).alias("x")), "src", "dst")
    ratio = dag.join(paths.select("s", F.col("node").alias("src"), F.col("x").alias("ps")), ["s", "src"]).join(
        paths.select("s", F.col("node").alias("dst"), F.col("x").alias("pd")), ["s", "dst"]
    ).select("s", "src", "dst", (F.col("ps") / F.col("pd")).alias("share"))
    ratio = cut_lineage(ratio)
    first = ratio.groupBy("s", F.col("src").alias("node")).agg(F.sum("share").alias("x"))
    dep = _walk(ratio, first, "dst", "src", "share")
    return dep.where("s <> node").groupBy("node").agg(F.sum("x").alias("b"))


def _walk(dag: DataFrame, start: DataFrame, here: str, there: str, share: str | None = None) -> DataFrame:
    """Sum over all walks of a DAG: ``start`` pushed along the edges round after round until nothing is left."""
    wave = cut_lineage(start.select("s", "node", "x"))
    total = wave
    while True:
        factor = F.col("x") * F.col(share) if share else F.col("x")
        wave = cut_lineage(
            wave.join(dag, (wave["s"] == dag["s"]) & (wave["node"] == dag[here])).select(wave["s"], F.col(there).alias("node"), factor.alias("x"))
            .groupBy("s", "node").agg(F.sum("x").alias("x"))
        )
        if wave.isEmpty():
            break
        total = cut_lineage(total.unionByName(wave).groupBy("s", "node").agg(F.sum("x").alias("x")))
    return total


# ---- clustering ----


def triangles(e: DataFrame) -> DataFrame:
    """``node, triangles``: each edge points to its end of higher degree, so no neighbour list exceeds sqrt(2m)."""
    plain = e.where("u <> v").select("u", "v")
    deg = plain.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("deg"))
    with_u = join_hot_keys(plain.withColumnRenamed("u", "node"), deg, ["node"], "deg").select(F.col("node").alias("u"), F.col("deg").alias("du"), "v")
    ends = join_hot_keys(with_u.withColumnRenamed("v", "node"), deg, ["node"], "deg").select("u", "du", F.col("node").alias("v"), F.col("deg").alias("dv"))
    up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    arcs = cut_lineage(ends.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("b")))
    # each pair of a node's out-neighbours is a wedge; those of a heavy node are dealt over slots by their first end
    heads = cut_lineage(arcs.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").withColumn("slots", spread("n", WEDGE_ENDS)))
    fan = join_hot_keys(arcs, heads, ["a"], "n")
    one = fan.select("a", F.pmod(F.xxhash64("b"), "slots").cast("int").alias("slot"), "b")
    other = fan.select("a", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.col("b").alias("c"))
    wedges = one.join(other, ["a", "slot"]).where("b < c").select("a", "b", "c")
    ends = arcs.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("c"))
    closed = wedges.join(ends, ["b", "c"], "left_semi")
    return closed.select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))


def clustering(e: DataFrame) -> DataFrame:
    """``node, degree, clustering``: closed share of neighbour pairs; degree with loops counted twice."""
    d = degrees(e).select("node", "degree")
    plain = e.where("u <> v").select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("k"))
    x = d.join(plain, "node", "left").join(triangles(e), "node", "left")
    c = F.coalesce(F.try_divide(2.0 * F.col("triangles"), F.col("k").cast("double") * (F.col("k") - 1)), F.lit(0.0))
    return x.select("node", "degree", F.coalesce(c, F.lit(0.0)).alias("clustering"))


def dense_nodes(e: DataFrame, top: int = 10) -> DataFrame:
    """Nodes of degree 2 or more with the largest clustering x degree."""
    c = clustering(e)
    return c.orderBy((F.col("clustering") * F.col("degree")).desc(), "node").limit(top).where("degree >= 2")


def influencers(e: DataFrame, top: int = 15, pivots: int | None = None, seed: int = 42) -> DataFrame:
    """Top nodes by PageRank with degree, centrality and betweenness."""
    lead = pagerank(e).orderBy(F.col("pagerank").desc(), "node").limit(top)
    few = F.broadcast(lead)
    return few.join(degrees(e), "node").join(betweenness(e, pivots, seed), "node").orderBy(F.col("pagerank").desc(), "node")
