"""Embedding near-duplicates over a neighbour graph refined by NN-descent.

1. Equal vectors become one node with a multiplicity, so copies cost nothing.
2. The graph starts from short random-hyperplane codes: nodes with a common code
   prefix are dealt into pools of bounded size and take their nearest there.
3. Each round joins neighbours of neighbours: every node's list, with a sample
   of the nodes that list it, is compared all against all, and a list keeps its
   nearest.  Rounds end when few entries change.
4. Pairs at or above the threshold are kept as edges; their components follow.
5. A saturated list (all of it above the threshold) cannot hold a node's links.
   Its node is compared with all nodes of its label outside its component, block
   of vectors against block, and components that link are joined.  Components
   are then counted exactly in the same way, without making a row per pair.
6. Recall is audited by brute force against all nodes, for a sample of nodes with
   links and one of all nodes, which grow with the root of the table.  Below the
   target the rounds go on with longer lists, in the end with every node taken
   as saturated, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

_POOL = 64          # nodes of a pool at the start
_BLOCK = 512        # nodes of a block when a component is counted
_AUDIT = 256        # nodes of an audited sample, at least
_TABLES, _BITS = 8, 24


def _unit(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (rows that have none are zero) and which rows have one; all of one length."""
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64)
    good = np.isfinite(x).all(axis=1)
    x[~good] = 0
    top = np.abs(x).max(axis=1, initial=0)
    good &= top > 0
    x = x / np.where(top > 0, top, 1)[:, None]
    return x / np.where(good, np.sqrt((x * x).sum(axis=1)), 1)[:, None], good


def _matrix(blobs) -> np.ndarray:
    return np.stack([np.frombuffer(b, "<f8") for b in blobs])


def _codes(x: np.ndarray, seed: int) -> np.ndarray:
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], _TABLES * _BITS))
    bits = (x @ planes > 0).reshape(len(x), _TABLES, _BITS)
    return bits @ (1 << np.arange(_BITS - 1, -1, -1))


def near_classes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 threshold: float = 0.93, neighbours: int = 10, rounds: int = 4, target_recall: float = 0.97,
                 seed: int = 7) -> DataFrame:
    """One row per row of ``df``: id, n_links, component_id, kept.

    Vectors are compared by cosine in double precision where their labels are
    equal and not null and their lengths are equal.  A vector that is null,
    zero or holds null or non-finite components links with nothing.
    ``n_links`` counts the rows linked directly, ``component_id`` is the smallest
    id reachable (the row's own where nothing links), ``kept`` whether that is
    the row's id.  Null ids never name a component that has other ids; other
    columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "descent")
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    usable = F.col("v").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) \
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x.cast("double"))
                    | (F.abs(x.cast("double")) == float("inf"))) \
        & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("node", F.when(usable, F.xxhash64("label", "v")))
    held = rows.where("node is not null").groupBy("node").agg(
        F.count("*").alias("times"), F.min("id").alias("least"), F.first("v").alias("v"),
        F.first("label").alias("label"))

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["v"].map(len)):
                x, _ = _unit(part["v"])
                yield pd.DataFrame({"node": part["node"], "times": part["times"], "least": part["least"].astype(object).where(part["least"].notna(), None),
                                    "grp": part["grp"], "unit": [u.tobytes() for u in x],
                                    "codes": list(_codes(x, seed))})

    nodes = held.withColumn("grp", F.xxhash64("label", F.size("v"))).withColumn("least", F.col("least").cast("string")) \
        .mapInPandas(prepare, "node long, times long, least string, grp long, unit binary, codes array<long>")
    id_type = rows.schema["id"].dataType
    nodes = scratch.keep(nodes.withColumn("least", F.col("least").cast(id_type)), "nodes")
    found = None
    graph = _start(nodes, scratch, threshold, neighbours)
    for attempt in range(4):
        size = neighbours << attempt
        graph = _descend(graph, nodes, scratch, threshold, size, rounds, attempt)
        edges = graph.where(F.col("s") >= threshold).select(F.col("u").alias("a"), F.col("v").alias("b"))
        joined = components(edges, scratch, f"cc-{attempt}")
        full = graph.groupBy("u").agg(F.count("*").alias("n"), F.min("s").alias("low")) \
            .where((F.col("n") >= size) & (F.col("low") >= threshold)).select(F.col("u").alias("node"))
        found = _widened(edges, joined, full, nodes, scratch, threshold, f"{attempt}")
        if _recall(nodes, found, threshold) >= target_recall:
            break
    else:
        found = _widened(edges, joined, nodes.select("node"), nodes, scratch, threshold, "all")
    part = nodes.select("node", "times", "least").join(found, "node", "left") \
        .withColumn("component", F.coalesce("component", "node"))
    low = part.groupBy("component").agg(F.min("least").alias("component_id"))
    part = part.join(low, "component").select("node", "component_id", (F.coalesce("links", F.lit(0))
                                                                       + F.col("times") - 1).alias("n_links"))
    out = rows.select("id", "node").join(part, "node", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _best(pairs: DataFrame, size: int) -> DataFrame:
    """The ``size`` nearest of each list; what is above is bounded by the lists it was made from."""
    top = pairs.groupBy("u", "v").agg(F.max("s").alias("s")).groupBy("u").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("s", "v")), asc=False), 1, size).alias("near"))
    return top.select("u", F.explode("near").alias("e")).select("u", "e.v", "e.s")


def _start(nodes: DataFrame, scratch: Scratch, threshold: float, size: int) -> DataFrame:
    count = nodes.groupBy("grp").agg(F.count("*").alias("n"))
    bits = F.greatest(F.lit(0), F.least(F.lit(_BITS), F.ceil(F.log2(F.col("n") / 16)))).cast("int")
    coded = nodes.join(count.select("grp", bits.alias("bits")), "grp") \
        .select("node", "unit", "grp", "bits", F.posexplode("codes").alias("tab", "code")) \
        .withColumn("code", F.expr(f"shiftright(code, {_BITS} - bits)"))
    room = coded.groupBy("grp", "tab", "code").agg(F.ceil(F.count("*") / _POOL).alias("parts"))
    pools = coded.join(room, ["grp", "tab", "code"]) \
        .withColumn("pool", F.xxhash64("grp", "tab", "code", F.pmod(F.xxhash64("node", "tab"), F.col("parts")))) \
        .groupBy("pool").agg(F.collect_list(F.struct("node", "unit")).alias("m")).where(F.size("m") > 1)
    found = pools.select("m").mapInPandas(_pairs(size, threshold, None), "u long, v long, s double")
    return scratch.keep(_best(found, size), "start")


def _pairs(size: int, threshold: float, floor: str | None):
    """Compare the members of each row's list with one another; each takes its nearest there."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            us, vs, ss = [], [], []
            for m in pdf["m"]:
                ids = np.array([r["node"] for r in m], dtype=np.int64)
                x = _matrix([r["unit"] for r in m])
                s = x @ x.T
                np.fill_diagonal(s, -2)
                k = min(size, len(ids) - 1)
                pick = np.argpartition(-s, k - 1, axis=1)[:, :k]
                row = np.repeat(np.arange(len(ids)), k)
                col = pick.ravel()
                val = s[row, col]
                if floor:
                    low = np.array([r[floor] for r in m])
                    good = val > low[row]
                    row, col, val = row[good], col[good], val[good]
                us.append(ids[row])
                vs.append(ids[col])
                ss.append(val)
            if us:
                yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs), "s": np.concatenate(ss)})
    return run


def _descend(graph: DataFrame, nodes: DataFrame, scratch: Scratch, threshold: float, size: int, rounds: int,
             attempt: int) -> DataFrame:
    total = nodes.count()
    for k in range(rounds):
        # those that list a node: a sample of about ``size`` of them, by a hash
        degree = graph.groupBy("v").agg(F.count("*").alias("n"))
        back = graph.join(degree, "v").where(
            F.pmod(F.xxhash64("u", "v", F.lit(k)), F.ceil(F.col("n") / size)) == 0)
        near = graph.select("u", "v").union(back.select(F.col("v").alias("u"), F.col("u").alias("v"))) \
            .union(graph.select("u", F.col("u").alias("v"))).distinct()
        last = graph.groupBy("u").agg(F.when(F.count("*") >= size, F.min("s")).otherwise(F.lit(-2.0)).alias("low"))
        vec = nodes.select("node", "unit").join(last.withColumnRenamed("u", "node"), "node", "left") \
            .withColumn("low", F.coalesce("low", F.lit(-2.0)))
        local = near.join(vec, near["v"] == vec["node"]).groupBy("u").agg(
            F.collect_list(F.struct("node", "unit", "low")).alias("m")).where(F.size("m") > 1)
        fresh = local.select("m").mapInPandas(_pairs(size, threshold, "low"), "u long, v long, s double")
        nxt = scratch.keep(_best(graph.unionByName(fresh), size), f"graph-{attempt}-{k}")
        changed = nxt.join(graph, ["u", "v"], "left_anti").count()
        graph = nxt
        if changed <= 0.01 * size * max(total, 1):
            break
    return graph


def _widened(edges: DataFrame, joined: DataFrame, full: DataFrame, nodes: DataFrame, scratch: Scratch, threshold: float,
             tag: str) -> DataFrame:
    """Links counted in the components, after those that a node of ``full`` links with another have been joined."""
    beyond = _beyond(joined, full, nodes, scratch, threshold, tag)
    if not beyond.isEmpty():
        joined = components(edges.unionByName(beyond), scratch, f"cc-wide-{tag}")
    return _count(joined, nodes, scratch, threshold, tag)


def _beyond(joined: DataFrame, full: DataFrame, nodes: DataFrame, scratch: Scratch, threshold: float,
            tag: str) -> DataFrame:
    """(a, b): pairs of components between which a node of ``full`` has a link."""
    placed = nodes.select("node", "grp", "unit").join(joined.withColumnRenamed("id", "node"), "node", "left") \
        .withColumn("component", F.coalesce("component", "node"))

    def blocks(part: DataFrame, name: str) -> DataFrame:
        room = part.groupBy("grp").agg(F.ceil(F.count("*") / _BLOCK).alias("parts"))
        packed = part.join(room, "grp").groupBy("grp", F.pmod(F.xxhash64("node"), F.col("parts")).alias("block")).agg(
            F.collect_list(F.struct("component", "unit")).alias(name))
        return scratch.keep(packed.select("grp", name), f"{name}-{tag}")

    asks = blocks(placed.join(full, "node", "left_semi"), "asks")
    if asks.isEmpty():
        return joined.select(F.col("id").alias("a"), F.col("component").alias("b")).limit(0)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b in zip(pdf["asks"], pdf["told"]):
                ca, cb = (np.array([r["component"] for r in m], dtype=np.int64) for m in (a, b))
                hit = _matrix([r["unit"] for r in a]) @ _matrix([r["unit"] for r in b]).T >= threshold
                i, j = np.nonzero(hit & (ca[:, None] != cb[None, :]))
                if len(i):
                    pairs = np.unique(np.stack((ca[i], cb[j]), 1), axis=0)
                    yield pd.DataFrame(pairs, columns=["a", "b"])

    # block against block of a label, partition by partition: nothing is shuffled by label
    met = asks.join(blocks(placed, "told").withColumnRenamed("grp", "g").hint("shuffle_replicate_nl"),
                    F.col("grp") == F.col("g"))
    return scratch.keep(met.select("asks", "told").mapInPandas(meet, "a long, b long"), f"beyond-{tag}").distinct()


def _count(joined: DataFrame, nodes: DataFrame, scratch: Scratch, threshold: float, tag: str) -> DataFrame:
    """(node, component, links) for the nodes of components of two or more, every pair inside a component compared."""
    inside = joined.withColumnRenamed("id", "node").join(nodes.select("node", "times", "unit"), "node")
    room = joined.groupBy("component").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("parts"))
    inside = inside.join(room, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # a node goes to the tiles of its block with every block, once on either side
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    tiles = inside.select("component", "node", "times", "unit", "block", other.alias("other")).select(
        "component", "node", "times", "unit", "block", F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        x, n = _matrix(pdf["unit"]), pdf["times"].to_numpy()
        a = pdf["block"].to_numpy() == i
        hit = (x[a] @ x[~a].T >= threshold) if i != j else (x @ x.T >= threshold)
        if i == j:
            np.fill_diagonal(hit, False)
            links = hit @ n
        else:
            links = np.zeros(len(n), dtype=np.int64)
            links[a], links[~a] = hit @ n[~a], hit.T @ n[a]
        return pd.DataFrame({"node": pdf["node"], "component": pdf["component"], "links": links})

    got = tiles.groupBy("component", "i", "j").applyInPandas(count, "node long, component long, links long") \
        .groupBy("node", "component").agg(F.sum("links").alias("links"))
    return scratch.keep(got, f"links-{tag}")


def _recall(nodes: DataFrame, found: DataFrame, threshold: float) -> float:
    """Share of a node's true links that were found, as a mean over sampled nodes that have any; 1 where none has.

    The lower of two means: over nodes with links found, and over any nodes,
    which also tells of nodes whose links are all lost.
    """
    size = max(_AUDIT, isqrt(nodes.count()))
    order = F.xxhash64("node", F.lit(3))
    every = nodes.select("node", "grp", "unit")
    linked = every.join(found.where("links > 0").select("node"), "node", "left_semi")
    picked = [[(r["node"], r["grp"], bytes(r["unit"])) for r in part.orderBy(order).limit(size).collect()]
              for part in (every, linked)]
    ask = list({a[0]: a for part in picked for a in part}.values())
    if not ask:
        return 1.0

    def true(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, part in pdf.groupby("grp"):
                mine = [a for a in ask if a[1] == g]
                if mine:
                    hit = _matrix([a[2] for a in mine]) @ _matrix(part["unit"]).T >= threshold
                    hit &= np.array([a[0] for a in mine])[:, None] != part["node"].to_numpy()[None, :]
                    yield pd.DataFrame({"node": [a[0] for a in mine], "n": hit @ part["times"].to_numpy()})

    known = {r["node"]: r["n"] for r in nodes.select("node", "grp", "unit", "times").mapInPandas(true, "node long, n long")
             .groupBy("node").agg(F.sum("n").alias("n")).collect()}
    got = {r["node"]: r["links"] for r in found.where(F.col("node").isin([a[0] for a in ask])).collect()}
    shares = [[min(got.get(a[0], 0), known[a[0]]) / known[a[0]] for a in part if known.get(a[0])] for part in picked]
    return min((sum(part) / len(part) for part in shares if part), default=1.0)
