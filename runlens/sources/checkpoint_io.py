"""Checkpoint documents (S2): JSON text <-> nested columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Shape of one stored checkpoint document.
CHECKPOINT_SCHEMA = (
    "thread_id string, run_id string, step int, saved_at string, "
    "state map<string, string>, "
    "frontier array<struct<node_id: string, item: string, collect_channel: string, task_id: string>>, "
    "visits map<string, int>, "
    "pending_interrupt struct<node_id: string, prompt: string>, "
    "metrics struct<tokens: bigint, cost_usd: double, elapsed_s: double, nodes_run: bigint>, "
    "dead_letters array<struct<node_id: string, attempts: int, error: string, error_type: string, step: int>>"
)


def read_checkpoints(df: DataFrame, col: str = "doc") -> DataFrame:
    """Parse checkpoint JSON into nested columns; a missing ``pending_interrupt`` is null.

    Rows that are not valid documents come out with a null ``ckpt``, so a
    bad row never stops the read.
    """
    parsed = df.select("*", F.from_json(F.col(col), CHECKPOINT_SCHEMA, {"mode": "PERMISSIVE"}).alias("ckpt"))
    return parsed.select("*", *[F.col(f"ckpt.{f}").alias(f) for f in
                                ("thread_id", "run_id", "step", "saved_at", "state", "frontier",
                                 "visits", "pending_interrupt", "metrics", "dead_letters")]
                         ).drop("ckpt")


def checkpoint_history(ckpts: DataFrame) -> DataFrame:
    """History projection: thread, run, step, saved_at."""
    return ckpts.select("thread_id", "run_id", "step", "saved_at")


def checkpoint_documents(view: DataFrame) -> DataFrame:
    """Render the ``checkpoints`` fixture view as stored documents (one JSON text per row).

    ``to_json`` leaves out null fields, so runs without a pending gate store
    no ``pending_interrupt`` key at all -- the case the reader must handle.
    """
    n = F.col("frontier_size")
    frontier = F.when(n > 0, F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.struct(
        F.concat(F.lit("n"), i.cast("string")).alias("node_id"), F.lit(None).cast("string").alias("item"),
        F.lit(None).cast("string").alias("collect_channel"),
        F.concat(F.col("run_id"), F.lit(":"), F.col("step").cast("string"), F.lit(":"),
                 i.cast("string")).alias("task_id")))).otherwise(F.array())
    doc = F.struct(
        "thread_id", "run_id", "step",
        F.date_format("saved_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("saved_at"),
        F.create_map(F.lit("step_tokens"), F.col("step_tokens").cast("string")).alias("state"),
        frontier.alias("frontier"),
        F.when(F.col("pending_node").isNotNull(),
               F.struct(F.col("pending_node").alias("node_id"), F.lit("approve?").alias("prompt")))
         .alias("pending_interrupt"),
        F.struct(F.col("step_tokens").cast("long").alias("tokens"),
                 (F.col("step_tokens") * 3 / 1e7).alias("cost_usd"),
                 F.lit(0.0).alias("elapsed_s"), n.cast("long").alias("nodes_run")).alias("metrics"),
        F.array().cast("array<struct<node_id: string, attempts: int, error: string, error_type: string, "
                       "step: int>>").alias("dead_letters"))
    return view.select("ckpt_id", F.to_json(doc).alias("doc"))
