"""Helpers shared by the training-data operators: scratch tables, components, batching."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


class Scratch:
    """Tables in the cluster's shared checkpoint folder.

    ``keep`` writes a frame once and returns a scan of what was written, which
    cuts the lineage and survives the loss of any executor; ``drop`` removes a
    table that nothing will read again.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        df.write.option("compression", compression).mode("overwrite").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def arrow_batches(spark: SparkSession, max_bytes: str = "4m", max_rows: int = 2000) -> Iterator[None]:
    """Bound Arrow batches by bytes for the jobs run inside; the session's own settings come back after.

    With whole texts in a batch, this is what bounds a Python worker.
    """
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": max_bytes,
              "spark.sql.execution.arrow.maxRecordsPerBatch": str(max_rows)}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: long) by alternating large and small stars.

    Returns (id, component) for every vertex that has an edge, ``component``
    being its smallest reachable id.  Each half round is one grouped minimum
    and one join, so a vertex with very many neighbours is pre-aggregated and
    its join partition can be split.  Raises if the stars have not settled
    after ``max_rounds``; it never returns a partial closure.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.keep(e, f"{tag}-0")
    mark = None
    for i in range(1, max_rounds + 1):
        # large star: every larger neighbour of u is joined to the minimum around u
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        # small star: every smaller neighbour of u, and u itself, is joined to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v") \
            .where("u <> v").distinct()
        nxt = scratch.keep(small, f"{tag}-{i}")
        seen = nxt.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                       F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        scratch.drop(f"{tag}-{i - 1}")
        e = nxt
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")) \
        .union(e.select("v", "v").distinct().toDF("id", "component")).distinct()


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to about ``limit`` (one item at least)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


class Memo:
    """A bounded memo of two generations: what is still in use moves on, the rest goes."""

    def __init__(self, limit: int):
        self.limit, self.now, self.old = limit, {}, {}

    def missing(self, lists: list[list]) -> list:
        """Make ``now`` ready for the keys in ``lists``; returns those that it has never held or has let go."""
        if len(self.now) > self.limit:
            self.old, held = self.now.copy(), self.now
            held.clear()
        now, old = self.now, self.old
        new = {k for k in set().union(*lists) if k not in now}
        if old:
            known = [k for k in new if k in old]
            now.update((k, old[k]) for k in known)
            new.difference_update(known)
        return list(new)
