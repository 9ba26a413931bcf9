"""Entity graphs (GRF) on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from .registry import query, rounded


def trade(t):
    """Customers' nations linked to the suppliers' nations they buy from, weighted by quantity."""
    li = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        t.supplier, F.col("l_suppkey") == F.col("s_suppkey")
    )
    pairs = li.select(F.concat(F.lit("c"), "c_nationkey").alias("a"), F.concat(F.lit("s"), "s_nationkey").alias("b"), F.col("l_quantity").alias("w"))
    return graph.edges(pairs, "a", "b", "w")


TRADE = """(SELECT least(a, b) AS u, greatest(a, b) AS v, sum(w) AS weight FROM (SELECT 'c' || c_nationkey AS a, 's' || s_nationkey AS b, l_quantity AS w
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1, 2)"""


def homes(t):
    """Customers and suppliers linked to their nation: one component per nation."""
    c = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("n"), "c_nationkey").alias("b"))
    s = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("a"), F.concat(F.lit("n"), "s_nationkey").alias("b"))
    return graph.edges(c.unionByName(s), "a", "b")


HOMES = """(SELECT DISTINCT least(a, b) AS u, greatest(a, b) AS v, 1.0::DOUBLE AS weight FROM (SELECT 'c' || c_custkey AS a, 'n' || c_nationkey AS b FROM customer
 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier))"""


def bought(t):
    """Part and supplier keys on one number line, so that triangles exist."""
    return graph.edges(t.lineitem.select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 97).alias("b"), "l_quantity"), "a", "b", "l_quantity")


BOUGHT = """(SELECT least(a, b) AS u, greatest(a, b) AS v, sum(w) AS weight FROM (SELECT l_suppkey::VARCHAR AS a, (l_partkey % 97)::VARCHAR AS b, l_quantity AS w FROM lineitem)
 GROUP BY 1, 2)"""
DEG = "(SELECT node, count(*) AS degree FROM (SELECT u AS node FROM {e} UNION ALL SELECT v FROM {e}) GROUP BY node)"


@query("grf_01_edges", f"SELECT u, v, round(weight, 4) + 0.0 AS weight FROM {BOUGHT}")
def edges(t):
    return rounded(bought(t), 4)


@query("grf_02_summary", f"""
WITH n AS (SELECT count(*) AS nodes FROM {DEG.format(e=HOMES)}), m AS (SELECT count(*) AS edges FROM {HOMES}),
c AS (SELECT count(DISTINCT v) AS components FROM (SELECT 'n' || c_nationkey AS v FROM customer UNION SELECT 'n' || s_nationkey FROM supplier))
SELECT nodes, edges, round(2.0 * edges / (nodes * (nodes - 1.0)), 10) + 0.0 AS density, components, components = 1 AS connected FROM n, m, c""")
def summary(t):
    e = homes(t)
    return rounded(graph.summary(e, graph.components(e)), 10)


@query("grf_03_degrees", f"""
SELECT node, degree, round(degree / ((SELECT count(*) FROM {DEG.format(e=BOUGHT)}) - 1)::DOUBLE, 8) + 0.0 AS degree_centrality FROM {DEG.format(e=BOUGHT)}""")
def degrees(t):
    return rounded(graph.degrees(bought(t)), 8)


# power iteration until the summed change falls below nodes x 1e-6
@query("grf_04_pagerank", f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT u AS src, v AS dst, weight FROM {BOUGHT} UNION ALL SELECT v, u, weight FROM {BOUGHT} WHERE u <> v),
k AS MATERIALIZED (SELECT src AS node, sum(weight) AS strength FROM e GROUP BY 1), n AS MATERIALIZED (SELECT count(*) AS n FROM k),
l AS MATERIALIZED (SELECT src, dst, weight / strength AS share FROM e JOIN k ON src = node),
r(node, rank, i) AS (
  SELECT node, 1.0::DOUBLE / n, 0 FROM k, n
  UNION ALL SELECT dst, (1.0 - 0.85::DOUBLE) / any_value(n) + 0.85::DOUBLE * sum(rank * share), i + 1 FROM r JOIN l ON node = src, n WHERE i < 150 GROUP BY dst, i),
c AS (SELECT b.i, sum(abs(b.rank - a.rank)) AS change FROM r a JOIN r b ON a.node = b.node AND b.i = a.i + 1 GROUP BY b.i),
stop AS (SELECT min(i) AS i FROM c, n WHERE change < n * 1e-6)
SELECT node, round(rank, 8) + 0.0 AS pagerank FROM r JOIN stop USING (i)""")
def pagerank(t):
    return rounded(graph.pagerank(bought(t)), 8)


@query("grf_05_components", f"""
WITH d AS (SELECT u AS a, v AS n FROM {HOMES} WHERE v LIKE 'n%' UNION ALL SELECT v, u FROM {HOMES} WHERE u LIKE 'n%'),
m AS (SELECT n, least(n, min(a)) AS component FROM d GROUP BY n)
SELECT a AS node, component FROM d JOIN m USING (n) UNION SELECT n, component FROM m""")
def components(t):
    return graph.components(homes(t))


@query("grf_05_communities", f"""
WITH d AS (SELECT u AS a, v AS n FROM {HOMES} WHERE v LIKE 'n%' UNION ALL SELECT v, u FROM {HOMES} WHERE u LIKE 'n%'),
m AS (SELECT n, least(n, min(a)) AS component, count(*) + 1 AS members FROM d GROUP BY n)
SELECT component, members FROM m ORDER BY members DESC, component LIMIT 5""")
def communities(t):
    return graph.communities(graph.components(homes(t))).select("component", "members")


@query("grf_06_betweenness")
def betweenness(t):
    return graph.betweenness(trade(t))


CLUSTERING = f"""
WITH e AS MATERIALIZED (SELECT u, v FROM {BOUGHT} WHERE u <> v), b AS MATERIALIZED (SELECT u AS x, v AS y FROM e UNION ALL SELECT v, u FROM e),
t AS (SELECT p.x AS node, count(*) AS t FROM b p JOIN b q ON p.y = q.x JOIN b r ON q.y = r.x AND r.y = p.x GROUP BY p.x),
k AS (SELECT x AS node, count(*) AS k FROM b GROUP BY x)
SELECT d.node, degree, round(coalesce(t, 0) / greatest(k * (k - 1), 1)::DOUBLE, 8) + 0.0 AS clustering FROM {DEG.format(e=BOUGHT)} d LEFT JOIN k USING (node) LEFT JOIN t USING (node)"""


@query("grf_07_clustering", CLUSTERING)
def clustering(t):
    return rounded(graph.clustering(bought(t)), 8)


@query("grf_07_dense_nodes")
def dense(t):
    return graph.dense_nodes(bought(t))


@query("grf_08_influencers")
def influencers(t):
    return graph.influencers(trade(t))
