"""State folding over channel writes (A7-A11, A13, F4) and checkpoint views.

A channel's state is the fold of its writes in ``seq`` order.  Scalar folds
(last, sum) are algebraic aggregates.  List folds (append, extend) and map
folds (merge_dict) are returned in long form -- one row per element or key
-- so no state value is ever gathered into one row: a hot thread's list is
numbered with the skew-safe ``ordered_scan`` instead of ``collect_list``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import json_kind
from ..plans.broadcast import bounded_broadcast
from ..plans.ordered import ordered_scan

FOLD_KEYS = ("thread_id", "run_id", "channel")


def reduce_last(writes: DataFrame, keys: Sequence[str] = FOLD_KEYS, value: str = "value",
                order: str = "seq", default: Column | None = None, declared: DataFrame | None = None) -> DataFrame:
    """Last write wins, a last write of null included.

    With ``declared`` (the keys that exist) keys without any write get a row
    too; their value is ``default``.
    """
    out = writes.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("value")), F.col(order)).alias("_last"))
    if declared is not None:
        out = declared.select(*keys).distinct().join(out, list(keys), "left")
    # presence of a write decides, not its value
    return out.select(*keys, F.when(F.col("_last").isNotNull(), F.col("_last.value"))
                      .otherwise(default if default is not None else F.lit(None)).alias("value"))


def reduce_sum(writes: DataFrame, keys: Sequence[str] = FOLD_KEYS, value: str = "value",
               default: int = 0) -> DataFrame:
    """A10: sum from the default; a null write counts as 0."""
    return writes.groupBy(*keys).agg(
        (F.lit(default) + F.sum(F.coalesce(F.col(value), F.lit(0)))).cast("long").alias("value"))


def reduce_append(writes: DataFrame, keys: Sequence[str] = FOLD_KEYS, value: str = "value",
                  order: str = "seq") -> DataFrame:
    """Each write is one element (a list write nests); long form (keys, pos, value)."""
    w = writes.select(*keys, order, F.col(value).alias("value"))
    return ordered_scan(w, keys, [order], index="pos").select(*keys, "pos", "value")


def reduce_extend(writes: DataFrame, keys: Sequence[str] = FOLD_KEYS, elements: str = "elements",
                  order: str = "seq") -> DataFrame:
    """List writes are concatenated, a scalar write is appended.

    ``elements`` is an array column (a scalar write is a one-element array).
    Element positions: elements of earlier writes (running sum of sizes,
    skew-safe) plus the position inside the write.
    """
    w = writes.select(*keys, order, F.col(elements).alias("_els"))
    w = ordered_scan(w, keys, [order], running_before={"_before": F.size("_els")})
    e = w.select(*keys, "_before", F.posexplode("_els").alias("_i", "value"))
    return e.select(*keys, (F.col("_before") + F.col("_i") + 1).cast("long").alias("pos"), "value")


def reduce_merge_map(writes: DataFrame, keys: Sequence[str] = FOLD_KEYS, key: str = "map_key",
                     value: str = "value", order: str = "seq") -> DataFrame:
    """Maps merged, later keys win; long form (keys, key, value)."""
    return writes.groupBy(*keys, F.col(key).alias("key")).agg(
        F.max_by(F.col(value), F.col(order)).alias("value"))


def fold_state(writes: DataFrame, channels: DataFrame, keys: Sequence[str] = ("thread_id", "run_id"),
               value: str = "value", order: str = "seq", elements: str | None = None) -> DataFrame:
    """Fold every channel with its declared reducer; one summary row per (keys, channel).

    ``value`` is the scalar state for last/sum; ``size`` the element or key
    count for list and map channels (their contents are in the long-form folds); an
    ``extend`` write adds the elements of its ``elements`` list, or one element.
    Writes to channels that are not declared come back with reducer ``undeclared``
    (an error in the reference) and their number in ``size``.
    Channel declarations are a small dimension, broadcast after a size check.
    """
    w = writes.join(bounded_broadcast(channels.select("channel", "reducer")), "channel", "left") \
        .withColumn("reducer", F.coalesce("reducer", F.lit("undeclared")))
    added = F.coalesce(F.size(elements), F.lit(0)) if elements else F.lit(1)
    r = F.col("reducer")
    agg = w.groupBy(*keys, "channel", "reducer").agg(
        F.max_by(F.col(value), F.col(order)).alias("_last"),
        F.sum(F.coalesce(F.col(value), F.lit(0))).alias("_sum"),
        F.count(F.lit(1)).alias("_n"), F.sum(added).alias("_elements"),
        F.count_distinct(F.col("map_key")).alias("_nkeys"))
    return agg.select(
        *keys, "channel", "reducer",
        F.when(r == "last", F.col("_last")).when(r == "sum", F.col("_sum")).cast("long").alias("value"),
        F.when(r.isin("append", "undeclared"), F.col("_n")).when(r == "extend", F.col("_elements"))
         .when(r == "merge_dict", F.col("_nkeys"))
         .cast("long").alias("size"))


def changed_channels(writes: DataFrame, keys: Sequence[str] = ("run_id", "step")) -> DataFrame:
    """Sorted set of channels written per run and step.

    Channels are declared names (a bounded set), so ``collect_set`` per step is bounded.
    """
    return writes.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("changed"))


# Which value kinds each declared channel type accepts
# (a bool is an int, an int or bool is a float; null fits every type).
TYPE_ACCEPTS = {
    "str": ("str",),
    "int": ("int", "bool"),
    "float": ("int", "float", "bool"),
    "bool": ("bool",),
    "list": ("list",),
    "dict": ("dict",),
}


def check_channel_type(writes: DataFrame, channels: DataFrame, value_json: str = "value_json") -> DataFrame:
    """writes whose JSON value does not fit the channel's declared type, and all writes to
    channels that are not declared (``declared`` is null)."""
    w = writes.join(bounded_broadcast(channels.select("channel", F.col("type").alias("declared"))),
                    "channel", "left").withColumn("actual", json_kind(F.col(value_json)))
    fits = F.lit(False)
    for typ, kinds in TYPE_ACCEPTS.items():
        fits = fits | ((F.col("declared") == typ) & F.col("actual").isin(*kinds))
    fits = fits | (F.col("actual") == "null") | (F.col("declared") == "any") \
        | ~F.col("declared").isin(*TYPE_ACCEPTS)
    return w.where(F.col("declared").isNull() | ~fits)


def latest_checkpoint(ckpts: DataFrame, key: str = "thread_id", order: str = "ckpt_id") -> DataFrame:
    """Newest checkpoint per thread.

    ``max_by`` over the whole row struct is an algebraic aggregate: each map
    task keeps one candidate per thread, so a hot thread costs nothing extra.
    """
    cols = [c for c in ckpts.columns if c != key]
    agg = ckpts.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r"))
    return agg.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def thread_status(ckpts: DataFrame) -> DataFrame:
    """Interrupted when a gate is pending, finished when the frontier is empty, else stopped."""
    last = latest_checkpoint(ckpts)
    return last.select(
        "thread_id", "run_id", "step",
        F.when(F.col("pending_node").isNotNull(), "interrupted")
         .when(F.coalesce(F.col("frontier_size"), F.lit(0)) == 0, "finished")
         .otherwise("stopped").alias("status"))


def frontier_order(done: DataFrame, frontier: DataFrame, keys: Sequence[str],
                   frontier_col: str = "frontier", task: str = "node_id") -> DataFrame:
    """K3: completed tasks with their place ``pos`` (from 0) in the frontier's declared order.

    ``frontier`` holds one declared task list per key (bounded by the graph's
    concurrency); it is exploded with positions and joined to the completions.
    """
    pos = frontier.select(*keys, F.posexplode(frontier_col).alias("pos", task))
    return done.join(pos, [*keys, task], "inner")
