"""Graph operators over edge tables.

Cycles are found without a transitive closure.  Chains of nodes with one in- and
one out-edge become single edges first, by pointer doubling, so a long chain or
a long simple cycle costs rounds by the logarithm of its length.  Of the rest, nodes that
cannot lie on a cycle are peeled off (and new chains contracted), then the smallest
id that reaches each remaining node colours the graph, and the nodes of a colour
that reach its root are one strongly connected component.  Every round is a join
and an aggregate over the edge table, whose size bounds all tables in between,
and the driver reads only counts and check sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.broadcast import bounded_broadcast
from ..session import cut_lineage

ROUNDS_PER_TABLE = 2


PEELS_PER_CONTRACTION = 4


def peel(edges: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """Edges left when nodes without an in-edge or without an out-edge are taken away, at most ``rounds`` times, and
    whether none was left to take."""
    e, n = edges, edges.count()
    for _ in range(rounds):
        leads_on = e.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        e = cut_lineage(leads_on.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
                        .select("src", "dst"))
        m = e.count()
        if m == n:
            return e, True
        n = m
    return e, False


def _contract(e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Chains as single edges: (edges, chains, rings), or None where there is no chain.

    ``chains`` (node, tail, head) names the nodes outside a chain that its edge now joins; ``rings`` (node, component)
    are cycles of which no node has another edge.  A pointer doubles its length every round.
    """
    out = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("to")).where("n = 1")
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("node")
    ptr = cut_lineage(out.join(into, "node", "left_semi").select(
        "node", "to", F.col("node").alias("last"), F.col("node").alias("low")))
    if ptr.isEmpty():
        return None
    inner = cut_lineage(ptr.select("node"))
    mark = None
    while True:
        ahead = ptr.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("last").alias("last2"), F.col("low").alias("low2"))
        j = ptr.join(ahead, "to", "left")
        ptr = cut_lineage(j.select("node", F.coalesce("to2", "to").alias("to"), F.coalesce("last2", "last").alias("last"),
                                   F.least("low", "low2").alias("low"), F.col("to2").isNotNull().alias("inside")))
        seen = ptr.where("inside").agg(F.count(F.lit(1)), F.sum(F.col("low").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == mark:
            break
        mark = seen
    # pointers that never leave the chain's nodes run round a ring; a jump may have landed on a node outside just now
    rings = ptr.join(inner.select(F.col("node").alias("to")), "to", "left_semi").select("node", F.col("low").alias("component"))
    ends = ptr.join(inner.select(F.col("node").alias("to")), "to", "left_anti")
    ids = inner.select(F.col("node").alias("id"))
    outer = e.join(ids, F.col("src") == F.col("id"), "left_anti")
    direct = outer.join(ids, F.col("dst") == F.col("id"), "left_anti").select("src", "dst")
    entered = outer.join(ends, F.col("dst") == F.col("node")).select(F.col("src").alias("tail"), "last", F.col("to").alias("head"))
    entered = cut_lineage(entered)
    edges = cut_lineage(direct.union(entered.select("tail", "head")).distinct())
    # chains that nothing enters start at a ring-free node without in-edge, which has been an outer node: all are entered
    chains = cut_lineage(ends.select("node", "last").join(entered, "last").select("node", "tail", "head"))
    return edges, chains, rings


def _colours(e: DataFrame) -> DataFrame:
    """(id, colour): the smallest id that reaches each node, itself included."""
    lab = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("colour", F.col("id"))
    mark = None
    while True:
        for _ in range(ROUNDS_PER_TABLE):
            come = e.join(lab, e["src"] == lab["id"]).select(F.col("dst").alias("id"), "colour")
            lab = lab.union(come).groupBy("id").agg(F.min("colour").alias("colour"))
        lab = cut_lineage(lab)
        seen = lab.agg(F.sum(F.xxhash64("id", "colour").cast("decimal(38,0)"))).first()[0]
        if seen == mark:
            return lab
        mark = seen


def _roots_reached(e: DataFrame, lab: DataFrame) -> DataFrame:
    """(id, colour) of the nodes that reach the root of their colour inside the colour."""
    inside = e.join(lab.select(F.col("id").alias("src"), F.col("colour").alias("cs")), "src") \
        .join(lab.select(F.col("id").alias("dst"), F.col("colour").alias("cd")), "dst") \
        .where(F.col("cs") == F.col("cd")).select("src", "dst", F.col("cs").alias("colour"))
    inside = cut_lineage(inside)
    got = lab.where(F.col("id") == F.col("colour"))
    n = -1
    while True:
        for _ in range(ROUNDS_PER_TABLE):
            back = inside.join(got.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "colour")
            got = got.union(back).distinct()
        got = cut_lineage(got)
        m = got.count()
        if m == n:
            return got
        n = m


def cycle_components(edges: DataFrame) -> DataFrame:
    """(node, component): every node on a cycle with the smallest node of its strongly connected component."""
    loops = edges.where(F.col("src") == F.col("dst")).select(F.col("src").alias("node")).distinct()
    found = loops.select("node", F.col("node").alias("component"))
    e = cut_lineage(edges.where(F.col("src") != F.col("dst")).select("src", "dst").distinct())
    contracted: list[DataFrame] = []
    while not e.isEmpty():
        e, settled = peel(e, PEELS_PER_CONTRACTION)
        made = _contract(e)
        if made is not None:
            e, chains, rings = made
            contracted.append(chains)
            around = e.where(F.col("src") == F.col("dst")).select(F.col("src").alias("node"), F.col("src").alias("component"))
            found = cut_lineage(found.unionByName(rings).unionByName(around))
            e = cut_lineage(e.where(F.col("src") != F.col("dst")))
            continue
        if not settled:
            continue
        done = _roots_reached(e, _colours(e))
        parts = done.groupBy("colour").agg(F.count(F.lit(1)).alias("n"))
        big = done.join(parts.where("n > 1"), "colour").select(F.col("id").alias("node"), F.col("colour").alias("component"))
        found = cut_lineage(found.unionByName(big))
        ids = done.select("id")
        e = cut_lineage(e.join(ids, e["src"] == ids["id"], "left_anti").join(ids, F.col("dst") == ids["id"], "left_anti"))
    # a self-loop inside a larger component belongs to that component
    found = found.groupBy("node").agg(F.min("component").alias("component"))
    # a chain lies on a cycle when both its ends lie in one component; the last ones made are resolved first
    for chains in reversed(contracted):
        ends = chains.join(found.select(F.col("node").alias("tail"), F.col("component").alias("ct")), "tail") \
            .join(found.select(F.col("node").alias("head"), F.col("component").alias("ch")), "head").where("ct = ch")
        found = cut_lineage(found.union(ends.select("node", F.col("ct").alias("component"))))
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))


def find_cycles(edges: DataFrame) -> DataFrame:
    """G1: nodes on a cycle.

    The reference lists one cycle per back edge of a depth-first walk, which
    depends on visit order; the order-free answer is the set of nodes that
    reach themselves.
    """
    return cycle_components(edges).select("node")


def unguarded_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of loops (components) in which no node has a visit limit."""
    comp = cycle_components(edges)
    guarded = comp.join(nodes.where(F.col("max_iterations").isNotNull()).select(F.col("id").alias("node")),
                        "node", "left_semi").select("component").distinct()
    return comp.join(guarded, "component", "left_anti").select("node", "component")


def sink_nodes(nodes: DataFrame, edges: DataFrame, branch_col: str = "is_branch") -> DataFrame:
    """Nodes without an outgoing edge; branch (condition) nodes are exempt."""
    return nodes.where(~F.coalesce(F.col(branch_col), F.lit(False))).join(
        edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def failure_route(failed: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """What a failed node does next.

    on_error edges win (one row per error target); otherwise the failure is
    tolerated when every normal target is a merge (each merge receives the
    arrival as ``failed``); otherwise the run fails (``fatal``).
    """
    kinds = bounded_broadcast(nodes.select(F.col("id").alias("dst"), F.col("is_merge")))
    e = edges.join(kinds, "dst", "left").withColumn("is_merge", F.coalesce("is_merge", F.lit(False)))
    f = failed.select(F.col("id").alias("src")).distinct()
    fe = f.join(e, "src", "left")
    summary = fe.groupBy("src").agg(
        F.count_if(F.col("kind") == "on_error").alias("n_error"),
        F.count_if(F.col("kind") == "normal").alias("n_normal"),
        F.count_if((F.col("kind") == "normal") & F.col("is_merge")).alias("n_merge"))
    j = fe.join(summary, "src")
    on_error = j.where(F.col("n_error") > 0).where(F.col("kind") == "on_error") \
        .select("src", F.lit("on_error").alias("outcome"), "dst")
    tolerated = j.where((F.col("n_error") == 0) & (F.col("n_merge") > 0) & (F.col("n_merge") == F.col("n_normal"))) \
        .where(F.col("kind") == "normal").select("src", F.lit("tolerated").alias("outcome"), "dst")
    fatal = summary.where((F.col("n_error") == 0) & ~((F.col("n_merge") > 0) & (F.col("n_merge") == F.col("n_normal")))) \
        .select("src", F.lit("fatal").alias("outcome"), F.lit(None).cast(edges.schema["dst"].dataType).alias("dst"))
    return on_error.unionByName(tolerated).unionByName(fatal).withColumnRenamed("src", "node")
