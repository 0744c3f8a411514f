"""Joins: barrier, cache probe, zip, dangling references, pricing, webhook routing,
same-attribute edges, as-of resume (J2-J5, J7-J10).

Small declared tables (graph edges, prices, triggers) are broadcast only
after a size check (``bounded_broadcast``); data-sized sides shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.broadcast import bounded_broadcast
from ..plans.ordered import asof_last, ordered_scan


def merge_barrier(edges: DataFrame, arrivals: DataFrame, threshold: int | None = None) -> DataFrame:
    """Per (thread, merge node) the barrier outcome.

    ``edges`` (source, merge) declare the expected sources of each merge;
    ``arrivals`` (thread_id, source, state) hold the last state of each source
    (ok / failed / skipped).  Expected sources that never arrived count as
    skipped.  Required = sources that did not skip; the threshold defaults to
    required; the merge passes when successes >= threshold.

    No thread x source product is built: arrivals are joined to the (small,
    broadcast) edge table and the missing ones are counted as expected minus
    arrived per merge.
    """
    e = bounded_broadcast(edges.select("source", "merge").distinct())
    expected = bounded_broadcast(edges.select("source", "merge").distinct().groupBy("merge")
                                 .agg(F.count(F.lit(1)).alias("n_expected")))
    a = arrivals.join(e, "source", "inner")
    g = a.groupBy("thread_id", "merge").agg(
        F.count_if(F.col("state") == "ok").alias("ok"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(F.col("state") == "skipped").alias("skipped_arrived"),
        F.count(F.lit(1)).alias("arrived"))
    g = g.join(expected, "merge", "inner")
    required = F.col("ok") + F.col("failed")
    thr = F.lit(threshold) if threshold is not None else required
    return g.select("thread_id", "merge", "ok", "failed",
                    (F.col("skipped_arrived") + F.col("n_expected") - F.col("arrived")).alias("skipped"),
                    required.alias("required"), thr.cast("long").alias("threshold"),
                    (F.col("ok") >= thr).alias("passed"))


def cache_probe(work: DataFrame, cache: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(cached, todo): work rows with a cache entry for their key, and the rest."""
    c = cache.select(*keys).distinct()
    return work.join(c, list(keys), "left_semi"), work.join(c, list(keys), "left_anti")


def zip_by_position(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """Pair the nth row of ``a`` with the nth row of ``b`` per key; the longer side is cut."""
    ia = ordered_scan(a, [key], [order], index="pos")
    ib = ordered_scan(b, [key], [order], index="pos")
    ra = ia.select(key, "pos", *[F.col(c).alias(f"a_{c}") for c in a.columns if c != key])
    rb = ib.select(key, "pos", *[F.col(c).alias(f"b_{c}") for c in b.columns if c != key])
    return ra.join(rb, [key, "pos"], "inner")


def dangling_refs(refs: DataFrame, allowed: DataFrame) -> DataFrame:
    """Issue rows for references whose target is not in the allowed set.

    ``refs`` (kind, ref_id, target, severity); ``allowed`` (kind, target).
    One ``left_anti`` join on (kind, target) covers every reference kind.
    """
    return refs.join(allowed.select("kind", "target").distinct(), ["kind", "target"], "left_anti")


def price_usage(usage: DataFrame, prices: DataFrame, provider: str = "provider") -> DataFrame:
    """Cost per call = (prompt * price_in + completion * price_out) / 1e6; 0 when unpriced."""
    p = bounded_broadcast(prices.select(F.col("provider").alias(provider), "input_per_1m", "output_per_1m"))
    j = usage.join(p, provider, "left")
    cost = (F.col("prompt_tokens") * F.col("input_per_1m")
            + F.col("completion_tokens") * F.col("output_per_1m")) / 1e6
    return j.withColumn("cost_usd", F.coalesce(cost, F.lit(0.0))).drop("input_per_1m", "output_per_1m")


def _trim_slashes(c: Column) -> Column:
    return F.regexp_replace(c, r"^/+|/+$", "")


def route_webhooks(hooks: DataFrame, triggers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(routed, unmatched).

    Triggers are indexed by trimmed path; when several claim a path, the
    last one (highest ``trigger_id``) wins.  A hook's run input is the
    trigger's static input, overridden key by key by the hook body only
    when the trigger reads its input from the body and the body is a JSON
    object.  The index has one row per path, broadcast after a size check.
    """
    t = triggers.where(F.col("type") == "webhook").withColumn("path_key", _trim_slashes(F.col("path")))
    index = t.groupBy("path_key").agg(F.max_by(F.struct("trigger_id", "workflow", "input_from", "input"),
                                               F.col("trigger_id")).alias("t"))
    index = bounded_broadcast(index)
    h = hooks.withColumn("path_key", _trim_slashes(F.col("hook_path")))
    routed = h.join(index, "path_key", "inner")
    is_obj = F.coalesce(F.schema_of_variant(F.try_parse_json("body")).startswith("OBJECT"), F.lit(False))
    body_map = F.from_json(F.col("body"), "map<string,string>")
    static = F.coalesce(F.col("t.input"), F.create_map().cast("map<string,string>"))
    run_input = F.when((F.col("t.input_from") == "body") & is_obj, F.map_concat(
        F.map_filter(static, lambda k, v: ~F.map_contains_key(body_map, k)), body_map)).otherwise(static)
    routed = routed.select(*hooks.columns, F.col("t.trigger_id").alias("trigger_id"),
                           F.col("t.workflow").alias("workflow"), run_input.alias("run_input"))
    unmatched = h.join(index, "path_key", "left_anti").drop("path_key")
    return routed, unmatched


def same_attribute_edges(edges: DataFrame, src_nodes: DataFrame, dst_nodes: DataFrame,
                         attr: str = "attr") -> DataFrame:
    """Edges whose endpoints share ``attr``; at most one report per target, the
    first edge in edge order (``min_by``, combined map-side)."""
    s = src_nodes.select(F.col("id").alias("src"), F.col(attr).alias("_sa"))
    d = dst_nodes.select(F.col("id").alias("dst"), F.col(attr).alias("_da"))
    j = edges.join(s, "src").join(d, "dst").where(F.col("_sa") == F.col("_da"))
    # ties in edge order fall back to the source id
    return j.groupBy("dst").agg(F.min_by(F.struct("src", "edge_order"), F.struct("edge_order", "src")).alias("e"),
                                F.first("_da").alias(attr)) \
        .select("dst", F.col("e.src").alias("src"), F.col("e.edge_order").alias("edge_order"), attr)


def answer_asof(commands: DataFrame, ckpts: DataFrame, thread: str = "thread_id", ts: str = "ts") -> DataFrame:
    """Each resume command meets its thread's latest checkpoint at or before it.

    The answer goes to the checkpoint's pending node, or is unused when no
    gate is pending; the command's update patch is folded into the state
    first.  As-of is a skew-safe union + carried ``last`` (no per-thread
    sort of the whole history in one task).
    """
    c = commands.select(thread, F.col(ts).alias("_t"), F.lit(1).alias("_kind"),
                        F.col("command_id"), F.col("answer"), F.col("update"),
                        F.lit(None).cast(ckpts.schema["ckpt_id"].dataType).alias("ckpt_id"),
                        F.lit(None).cast("string").alias("pending_node"),
                        F.lit(None).cast("long").alias("state_value"))
    k = ckpts.select(thread, F.col("saved_at").alias("_t"), F.lit(0).alias("_kind"),
                     F.lit(None).cast(commands.schema["command_id"].dataType).alias("command_id"),
                     F.lit(None).cast("string").alias("answer"), F.lit(None).cast("long").alias("update"),
                     "ckpt_id", "pending_node", "state_value")
    u = c.unionByName(k)
    ck = F.struct(F.col("ckpt_id"), F.col("pending_node"), F.col("state_value"))
    a = asof_last(u, [thread], ["_t", "_kind"], ck, F.col("_kind") == 0, "_ck")
    a = a.where(F.col("_kind") == 1)
    pending = F.col("_ck.pending_node")
    return a.select(thread, "command_id", F.col("_ck.ckpt_id").alias("ckpt_id"), pending.alias("pending_node"),
                    F.when(pending.isNotNull(), F.col("answer")).alias("answer_to_node"),
                    (F.col("_ck.ckpt_id").isNotNull() & pending.isNull()).alias("unused"),
                    (F.col("_ck.state_value") + F.coalesce(F.col("update"), F.lit(0))).alias("state_after"))
