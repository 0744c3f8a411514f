"""Resharding by minimum-cost flow: from old shard sizes and new capacities to the fewest bytes moved.

Rows are grouped into blocks inside their old shard.  Equal texts hash to the
same block; only a block that alone would unbalance the result is cut further.
The flow problem has one node per old and per new shard, whatever the data
size; its solution says how many bytes go from each old to each new shard.
Large blocks are placed first, each into a flow of its old shard that still has
room for it, by preference the one that stays; a large block that fits into no
flow is cut into pieces of about a hundredth of a shard.  Small blocks and
pieces then fill what is left of each flow.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def min_cost_flow(supply: Mapping[int, int], capacity: Mapping[int, int],
                  cost: Mapping[tuple[int, int], int] | None = None) -> dict[tuple[int, int], int]:
    """Amounts moved from old to new shards at least cost; by default staying is free and moving costs 1 a byte.

    Successive shortest augmenting paths over the bipartite transport graph.
    """
    old, new = sorted(supply), sorted(capacity)
    if sum(supply.values()) > sum(capacity.values()):
        raise ValueError("the new shards cannot hold all bytes")
    price = {(o, n): (cost or {}).get((o, n), int(o != n)) for o in old for n in new}
    flow = dict.fromkeys(price, 0)
    left, room = dict(supply), dict(capacity)
    while any(left.values()):
        # Bellman-Ford from all old shards with bytes left
        dist = {("o", o): 0 for o in old if left[o]}
        back: dict = {}
        changed = True
        while changed:
            changed = False
            for (o, n), p in price.items():
                a, b = ("o", o), ("n", n)
                if a in dist and dist[a] + p < dist.get(b, float("inf")):
                    dist[b], back[b], changed = dist[a] + p, a, True
                if flow[o, n] and b in dist and dist[b] - p < dist.get(a, float("inf")):
                    dist[a], back[a], changed = dist[b] - p, b, True
        end = min((n for n in new if room[n] and ("n", n) in dist), key=lambda n: (dist["n", n], n))
        path, node = [], ("n", end)
        while node in back:
            path.append((back[node], node))
            node = back[node]
        amount = min([left[node[1]], room[end], *(flow[b[1], a[1]] for a, b in path if a[0] == "n")])
        for a, b in path:
            if a[0] == "o":
                flow[a[1], b[1]] += amount
            else:
                flow[b[1], a[1]] -= amount
        left[node[1]] -= amount
        room[end] -= amount
    return {k: v for k, v in flow.items() if v}


def even_capacity(total: int, shards: int) -> dict[int, int]:
    return {i: total * (i + 1) // shards - total * i // shards for i in range(shards)}


def reshard(df: DataFrame, old_shard: Column, shards: int, id_col: str = "doc_id", text_col: str = "text",
            blocks: int = 4096) -> DataFrame:
    """One row per row of ``df``: id, size, text_crc32, old_shard, shard, slot.

    ``size`` is the UTF-8 length plus 1 (a null text has none), ``slot`` numbers
    the rows of a shard from 0 without gaps.  ``old_shard`` is an int
    expression over ``df``; null counts as shard 0.  ``blocks`` bounds the
    block table, which is what is broadcast (at most about three times as many
    rows), and so sets how near to equal the shards get.  Other columns are not
    read; null and repeated ids are kept.
    """
    scratch = Scratch(df.sparkSession, "reshard")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.keep(df.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"),
        F.pmod(F.xxhash64(text), F.lit(blocks)).cast("int").alias("block"),
        F.xxhash64(id_col, text).alias("spread"), F.monotonically_increasing_id().alias("own")), "rows")
    by_old = {r[0]: (r[1], r[2]) for r in rows.groupBy("old_shard").agg(F.sum("size"), F.count("*")).collect()}
    total, count = sum(v[0] for v in by_old.values()), sum(v[1] for v in by_old.values())
    flow = min_cost_flow({o: v[0] for o, v in by_old.items()}, even_capacity(total, shards))

    # a block that has to be cut comes in small pieces; a block with many rows is numbered in parts
    small, part_rows = max(1, total // (100 * shards)), max(64, count // blocks)
    sizes = scratch.keep(rows.groupBy("old_shard", "block").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")),
                         "sizes")
    listed = [(r["bytes"], r["old_shard"], r["block"], 0) for r in sizes.collect()]
    whole = [x for x in listed if x[0] <= total // (2 * shards)]
    lost = _place(whole, flow, small)[1]
    hot = [(o, b, -(-n // small)) for n, o, b, p in listed if n > total // (2 * shards) or (o, b, p) in lost]
    pieces = df.sparkSession.createDataFrame(hot, "old_shard int, block int, pieces long")
    cut = scratch.keep(sizes.join(F.broadcast(pieces), ["old_shard", "block"], "left").select(
        "old_shard", "block", F.coalesce("pieces", F.lit(1).cast("long")).alias("pieces"),
        F.ceil(F.col("rows") / F.coalesce("pieces", F.lit(1)) / part_rows).alias("parts")), "cut")
    # rows of a cut block may share id and text, so there each goes by its own number
    spread = F.abs(F.when(F.col("pieces") > 1, F.xxhash64("own")).otherwise(F.col("spread")) % 2**40)
    placed = rows.join(F.broadcast(cut), ["old_shard", "block"]) \
        .withColumn("piece", (spread % F.col("pieces")).cast("int")) \
        .withColumn("part", (F.floor(spread / F.col("pieces")) % F.col("parts")).cast("int"))
    key = ["old_shard", "block", "piece", "part"]
    parts = scratch.keep(placed.groupBy(*key).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "parts")
    plan = scratch.keep(_assign(parts, flow, small), "plan")
    number = Window.partitionBy(*key).orderBy(F.col("id").asc_nulls_last(), "text_crc32", "size")
    return placed.withColumn("rank", F.row_number().over(number) - 1).join(F.broadcast(plan), key).select(
        F.col("id").alias(id_col), "size", "text_crc32", "old_shard", "shard",
        (F.col("base") + F.col("rank")).cast("long").alias("slot"))


def _place(pieces: list[tuple[int, int, int, int]], flow: dict[tuple[int, int], int],
           small: int) -> tuple[dict[tuple[int, int, int], int], set[tuple[int, int, int]]]:
    """The new shard of every (bytes, old shard, block, piece), largest first, and those that fit into no flow.

    What is not over ``small`` goes where most room is left if it fits nowhere; so does a single row above that.
    """
    left: dict[int, dict[int, int]] = {}
    for (o, n), b in flow.items():
        left.setdefault(o, {})[n] = b
    to, lost = {}, set()
    for size, o, *rest in sorted(pieces, key=lambda x: (-x[0], *x[1:])):
        room = left[o]
        n = o if room.get(o, 0) >= size else max(room, key=lambda k: (room[k], -k))
        if size > room[n] and size > small:
            lost.add((o, *rest))
            continue
        room[n] -= size
        to[(o, *rest)] = n
    return to, lost


def _assign(parts: DataFrame, flow: dict[tuple[int, int], int], small: int) -> DataFrame:
    """Shard and first slot of every part, from the bounded block table."""
    pieces = [(r["bytes"], r["old_shard"], r["block"], r["piece"]) for r in
              parts.groupBy("old_shard", "block", "piece").agg(F.sum("bytes").alias("bytes")).collect()]
    # a piece above ``small`` that still fits nowhere goes where most room is left
    top = max((x[0] for x in pieces), default=0)
    to = _place(pieces, flow, max(small, top))[0]
    shards = parts.sparkSession.createDataFrame([(*k, n) for k, n in to.items()],
                                                "old_shard int, block int, piece int, shard int")
    placed = parts.join(F.broadcast(shards), ["old_shard", "block", "piece"])
    base = Window.partitionBy("shard").orderBy("old_shard", "block", "piece", "part") \
        .rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("old_shard", "block", "piece", "part", "shard",
                         F.coalesce(F.sum("rows").over(base), F.lit(0)).alias("base"))


def reshard_files(df: DataFrame, old_shard: Column, shards: int, path: str, text_col: str = "text",
                  blocks: int = 4096) -> list[int]:
    """Plan and rewrite in one: rows go by a number of their own, so null and repeated ids keep every row once."""
    rows = Scratch(df.sparkSession, "reshard-rows").keep(
        df.withColumns({"__row": F.monotonically_increasing_id(), "__old": old_shard.cast("int")}), "rows")
    placed = reshard(rows, F.col("__old"), shards, "__row", text_col, blocks)
    return rewrite_affected(rows.drop("__old"), placed, path, "__row")


def rewrite_affected(df: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> list[int]:
    """Write the shards that gain or lose rows as ``path/shard=N``; the others stay as they are.

    Raises unless ids are unique and not null; ``reshard_files`` needs no ids.
    """
    if not placed.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).isEmpty():
        raise ValueError("rows cannot be told apart: null or repeated ids")
    moved = placed.where("old_shard <> shard")
    gain = [r[0] for r in moved.select(F.explode(F.array("old_shard", "shard"))).distinct().collect()]
    todo = placed.where(F.col("shard").isin(gain)).select(id_col, "shard", "slot")
    df.join(todo, id_col).drop("__row").repartition("shard", F.floor(F.col("slot") / 100_000)) \
        .sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    return sorted(gain)
