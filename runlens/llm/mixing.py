"""Mixing sources to target weights by balanced sampling with the cube method.

Every document of a source has the same expected number of copies,
target / size of the source.  Its whole part is taken for certain; the
fraction is an inclusion probability.  The flight phase moves these
probabilities through the null space of two constraints, the number of
documents and the number of words, three undecided documents at a time, until
each is 0 or 1 but for two; both totals stay exactly where they were.

It runs in blocks of a bounded number of documents.  What each block leaves
undecided (two documents at most) flies on together, block by block again, until
one block per source is left; the landing phase then tries the few roundings of
the last two documents and takes the one nearest to the word total.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

_EPS = 1e-9


def water_fill(sizes: dict, weights: dict, share: float, ceiling: float) -> dict:
    """Targets by weight that sum to ``share`` of all sizes, none above ``ceiling`` times its size."""
    left, out, open_ = share * sum(sizes.values()), {}, {s for s in sizes}
    while open_:
        total = sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / total > ceiling * sizes[s]}
        if not over:
            out.update((s, left * weights[s] / total) for s in open_)
            break
        out.update((s, float(ceiling * sizes[s])) for s in over)
        left -= sum(ceiling * sizes[s] for s in over)
        open_ -= over
    return out


def flight(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities keeping their sum and their size-weighted sum until at most two are not 0 or 1."""
    p = prob.astype(float).tolist()
    z = size.astype(float).tolist()
    draws = rng.random(len(p) + 8).tolist()
    active: list[int] = []
    for k in range(len(p)):
        if not _EPS < p[k] < 1 - _EPS:
            p[k] = float(round(p[k]))
            continue
        active.append(k)
        while len(active) == 3:
            a, b, c = active
            u = (z[c] - z[b], z[a] - z[c], z[b] - z[a])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            # how far the step may go either way before one probability is 0 or 1
            up = min((1 - p[i] if v > 0 else p[i]) / abs(v) for i, v in zip(active, u) if v)
            down = min((p[i] if v > 0 else 1 - p[i]) / abs(v) for i, v in zip(active, u) if v)
            step = up if draws[k] * (up + down) < down else -down
            for i, v in zip(active, u):
                p[i] += step * v
            for i in active:
                if p[i] < _EPS or p[i] > 1 - _EPS:
                    p[i] = float(round(p[i]))
            active = [i for i in active if 0.0 < p[i] < 1.0]
    return np.asarray(p)


def land(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the undecided few so that the word total, then the document total, is nearest."""
    p = prob.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_):
        words, docs = float(p[open_] @ size[open_]), float(p[open_].sum())
        p[open_] = min(product((0.0, 1.0), repeat=len(open_)),
                       key=lambda r: (abs(float(np.dot(r, size[open_])) - words), abs(sum(r) - docs)))
    return p


def source_targets(df: DataFrame, source_col: str, size: Column, weights: Sequence[float], share: float,
                   ceiling: float) -> DataFrame:
    """(source, source_size, target, n) per source.

    Weights go round over the sources in code-point order, null last.  One
    small row per source passes through the driver.
    """
    by = df.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("w"), F.count("*").alias("n")).collect()
    by.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = {r["source"]: int(r["w"]) for r in by}
    weight = {r["source"]: float(weights[i % len(weights)]) for i, r in enumerate(by)}
    target = water_fill(sizes, weight, share, ceiling)
    rows = [(r["source"], sizes[r["source"]], float(target[r["source"]]), int(r["n"])) for r in by]
    return df.sparkSession.createDataFrame(rows, "source string, source_size long, target double, n long")


def mix(df: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source",
        weights: Sequence[float] = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0, seed: int = 0,
        block_rows: int = 100_000) -> DataFrame:
    """``df`` with size, source_size, target, copies and taken; zero copies leave a document out.

    Documents of a block are ordered by a hash of their id, and the draws of a
    block are seeded by its source and number, so that reruns agree.  Null and
    repeated ids are documents of their own.  Columns of ``df`` with one of the
    added names are replaced.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    scratch = Scratch(df.sparkSession, "mix")
    keep = [c for c in df.columns if c not in added]
    # the caller's columns stay inside one struct, where their names clash with nothing
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), F.col(source_col).alias("_of"),
                     F.col(id_col).alias("_ident"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    goal = source_targets(rows, "_of", F.col("size"), weights, share, ceiling)
    count = sum(r["n"] for r in goal.collect())
    limit = min(block_rows, max(256, count // 4096))
    blocks = F.ceil(F.col("n") / limit)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(ceiling))) \
        .otherwise(F.lit(0.0))
    base = rows.withColumn("_id", F.monotonically_increasing_id()).join(goal, rows["_of"].eqNullSafe(goal["source"])).select(
        "_id", "_row", "size", "source_size", "target",
        F.floor(rate).cast("long").alias("_whole"), (rate - F.floor(rate)).alias("_prob"),
        # rows of one id are told apart by their size, rows without an id by all they hold
        F.xxhash64(F.lit(seed), "_ident", "size", F.when(F.col("_ident").isNull(), F.to_json("_row"))).alias("_order"),
        goal["source"].alias("_source"), blocks.alias("_blocks"))
    small = ["_id", "_source", "_order", "size", "_whole", "_prob", "_blocks"]
    # written once, so that the row numbers stay; only slim rows fly
    held = scratch.keep(base, "held")
    done = _fly(held.select(*small, "source_size", "target"), scratch, seed, limit).select("_id", "copies")
    return held.join(done, "_id").select("_row.*", "size", "source_size", "target", "copies",
                                         (F.col("copies") * F.col("size")).alias("taken"))


def _flown(seed: int, k: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_order", "size", "_id"], kind="stable")
        name = f"{seed}/{k}/{pdf['_block'].iloc[0]}/{pdf['_source'].iloc[0]}"
        size = pdf["size"].to_numpy()
        p = flight(pdf["_prob"].to_numpy(), size, np.random.default_rng(zlib.crc32(name.encode())))
        return pdf.assign(_prob=land(p, size) if last else p)
    return run


def _fly(rows: DataFrame, scratch: Scratch, seed: int, limit: int) -> DataFrame:
    cols = ["_id", "_source", "_order", "size", "_whole", "_prob", "_blocks", "source_size", "target"]
    rows = rows.select(*cols).withColumn("_block", F.pmod("_order", F.col("_blocks")))
    schema = rows.schema
    done: list[DataFrame] = []
    for k in range(64):
        last = (rows.select(F.max("_blocks")).first()[0] or 0) <= 1
        flown = scratch.keep(rows.groupBy("_source", "_block").applyInPandas(_flown(seed, k, last), schema),
                             f"flight-{k}")
        open_ = (F.col("_prob") > 0) & (F.col("_prob") < 1)
        done.append(flown.where(~open_))
        if last:
            break
        # two undecided documents at most are left of each block
        fewer = F.ceil(2 * F.col("_blocks") / limit)
        rows = flown.where(open_).withColumn("_blocks", fewer).withColumn("_block", F.pmod("_order", F.col("_blocks")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumn("copies", F.col("_whole") + F.round("_prob").cast("long"))
