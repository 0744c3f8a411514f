"""Registered queries: graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources import fixtures as fx
from .fixture_sql import with_views
from .registry import register

REACH_SQL = """
WITH RECURSIVE reach(src, dst) AS (
    SELECT src, dst FROM edges_g
    UNION SELECT r.src, e.dst FROM reach r JOIN edges_g e ON r.dst = e.src)
"""


@register("find_cycles", with_views(REACH_SQL + "SELECT DISTINCT src AS node FROM reach WHERE src = dst",
                                    "edges_g"), "G1")
def q_find_cycles(spark, sf):
    return G.find_cycles(fx.edges_g(spark, sf))


@register("unguarded_loops", with_views(REACH_SQL + """,
comp AS (SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src
    GROUP BY a.src),
guarded AS (SELECT DISTINCT c.component FROM comp c JOIN nodes_g n ON c.node = n.id WHERE n.max_iterations IS NOT NULL)
SELECT * FROM comp WHERE component NOT IN (SELECT component FROM guarded)""", "edges_g", "nodes_g"), "G2")
def q_unguarded_loops(spark, sf):
    return G.unguarded_loops(fx.edges_g(spark, sf), fx.nodes_g(spark, sf))


@register("sink_nodes", with_views("""
SELECT id FROM nodes_g WHERE NOT (id % 4 = 0) AND id NOT IN (SELECT src FROM edges_g)""", "nodes_g", "edges_g"), "G3")
def q_sink_nodes(spark, sf):
    n = fx.nodes_g(spark, sf).select("id", (F.col("id") % 4 == 0).alias("is_branch"))
    return G.sink_nodes(n, fx.edges_g(spark, sf)).select("id")


@register("failure_route", with_views("""
WITH e AS (SELECT src, dst, 'normal' AS kind FROM edges_g
    UNION ALL SELECT id, id + 1, 'on_error' FROM nodes_g WHERE id % 7 = 0),
n AS (SELECT id, id % 6 = 0 AS is_merge FROM nodes_g),
f AS (SELECT DISTINCT id AS src FROM nodes_g WHERE id % 3 = 0),
fe AS (SELECT f.src, e.dst, e.kind, coalesce(n.is_merge, false) AS is_merge
    FROM f LEFT JOIN e ON f.src = e.src LEFT JOIN n ON e.dst = n.id),
s AS (SELECT src, sum(CASE WHEN kind = 'on_error' THEN 1 ELSE 0 END) AS ne,
    sum(CASE WHEN kind = 'normal' THEN 1 ELSE 0 END) AS nn,
    sum(CASE WHEN kind = 'normal' AND is_merge THEN 1 ELSE 0 END) AS nm FROM fe GROUP BY src)
SELECT fe.src AS node, 'on_error' AS outcome, fe.dst FROM fe JOIN s ON fe.src = s.src WHERE ne > 0 AND kind = 'on_error'
UNION ALL SELECT fe.src, 'tolerated', fe.dst FROM fe JOIN s ON fe.src = s.src
    WHERE ne = 0 AND nm > 0 AND nm = nn AND kind = 'normal'
UNION ALL SELECT src, 'fatal', NULL FROM s WHERE ne = 0 AND NOT (nm > 0 AND nm = nn)""", "nodes_g", "edges_g"), "G5")
def q_failure_route(spark, sf):
    n = fx.nodes_g(spark, sf)
    edges = fx.edges_g(spark, sf).withColumn("kind", F.lit("normal")).unionByName(
        n.where(F.col("id") % 7 == 0).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"),
                                            F.lit("on_error").alias("kind")))
    nodes = n.select("id", (F.col("id") % 6 == 0).alias("is_merge"))
    failed = n.where(F.col("id") % 3 == 0).select("id")
    return G.failure_route(failed, edges, nodes)
