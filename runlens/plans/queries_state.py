"""Registered queries: state folding and checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state as S
from ..sources import checkpoint_io as C
from ..sources import fixtures as fx
from .fixture_sql import with_views
from .registry import register


def _writes(spark, sf):
    return fx.writes(fx.run_log(spark, sf))


@register("reduce_last", with_views("""
WITH w AS (SELECT thread_id, run_id, channel, seq, CASE WHEN seq % 9 <> 0 THEN value END AS value,
        row_number() OVER (PARTITION BY thread_id, run_id, channel ORDER BY seq DESC) AS newest FROM writes),
d AS (SELECT DISTINCT thread_id, run_id, unnest(['c0', 'c1', 'c2', 'c3']) AS channel FROM writes)
SELECT d.thread_id, d.run_id, d.channel, CASE WHEN w.seq IS NULL THEN 0 ELSE w.value END AS value
FROM d LEFT JOIN w ON d.thread_id = w.thread_id AND d.run_id = w.run_id AND d.channel = w.channel AND w.newest = 1""",
                                    "writes"), "A7")
def q_reduce_last(spark, sf):
    # some writes are null; channels that a run never wrote keep the default 0
    w = _writes(spark, sf).withColumn("value", F.when(F.col("seq") % 9 != 0, F.col("value")))
    declared = w.select("thread_id", "run_id").distinct().withColumn(
        "channel", F.explode(F.array(*[F.lit(c) for c, _, _ in fx.CHANNEL_ROWS])))
    return S.reduce_last(w, default=F.lit(0).cast("long"), declared=declared)


@register("reduce_sum", with_views("""
SELECT thread_id, run_id, channel, CAST(0 + sum(coalesce(value, 0)) AS BIGINT) AS value FROM writes
GROUP BY thread_id, run_id, channel""", "writes"), "A10")
def q_reduce_sum(spark, sf):
    return S.reduce_sum(_writes(spark, sf))


@register("reduce_append", with_views("""
SELECT thread_id, run_id, channel,
    CAST(row_number() OVER (PARTITION BY thread_id, run_id, channel ORDER BY seq) AS BIGINT) AS pos, value
FROM writes""", "writes"), "A8")
def q_reduce_append(spark, sf):
    return S.reduce_append(_writes(spark, sf))


@register("reduce_extend", with_views("""
WITH w AS (SELECT thread_id, run_id, channel, seq, value, value2, CASE WHEN seq % 2 = 0 THEN 2 ELSE 1 END AS n,
        coalesce(sum(CASE WHEN seq % 2 = 0 THEN 2 ELSE 1 END) OVER (PARTITION BY thread_id, run_id, channel
            ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM writes)
SELECT thread_id, run_id, channel, CAST(before + 1 AS BIGINT) AS pos, value FROM w
UNION ALL
SELECT thread_id, run_id, channel, CAST(before + 2 AS BIGINT) AS pos, value2 AS value FROM w WHERE n = 2""",
                                      "writes"), "A9")
def q_reduce_extend(spark, sf):
    w = _writes(spark, sf).withColumn(
        "elements", F.when(F.col("seq") % 2 == 0, F.array("value", "value2")).otherwise(F.array("value")))
    return S.reduce_extend(w)


@register("reduce_merge_map", with_views("""
SELECT thread_id, run_id, channel, map_key AS key, arg_max(value, seq) AS value FROM writes
GROUP BY thread_id, run_id, channel, map_key""", "writes"), "A11")
def q_reduce_merge_map(spark, sf):
    return S.reduce_merge_map(_writes(spark, sf))


@register("fold_state", with_views("""
SELECT w.thread_id, w.run_id, w.channel, coalesce(c.reducer, 'undeclared') AS reducer,
    CAST(CASE WHEN c.reducer = 'last' THEN arg_max(w.value, w.seq)
              WHEN c.reducer = 'sum' THEN sum(coalesce(w.value, 0)) END AS BIGINT) AS value,
    CAST(CASE WHEN c.reducer IS NULL OR c.reducer = 'append' THEN count(*)
              WHEN c.reducer = 'extend' THEN sum(CASE WHEN seq % 2 = 0 THEN 2 ELSE 1 END)
              WHEN c.reducer = 'merge_dict' THEN count(DISTINCT w.map_key) END AS BIGINT) AS size
FROM (SELECT * REPLACE (CASE WHEN seq % 11 = 0 THEN 'zz' WHEN seq % 13 = 0 THEN 'c4' ELSE channel END AS channel) FROM writes) w
LEFT JOIN (SELECT * FROM channels UNION ALL SELECT 'c4', 'list', 'extend') c ON w.channel = c.channel
GROUP BY w.thread_id, w.run_id, w.channel, c.reducer""", "writes", "channels"), "A7-A11")
def q_fold_state(spark, sf):
    # some writes go to a channel that is not declared, some extend a list by one or two elements
    w = _writes(spark, sf).withColumn("channel", F.when(F.col("seq") % 11 == 0, "zz").when(
        F.col("seq") % 13 == 0, "c4").otherwise(F.col("channel")))
    w = w.withColumn("elements", F.when(F.col("seq") % 2 == 0, F.array("value", "value2")).otherwise(F.array("value")))
    declared = spark.createDataFrame([*fx.CHANNEL_ROWS, ("c4", "list", "extend")], "channel string, type string, reducer string")
    return S.fold_state(w, declared, elements="elements")


@register("changed_channels", with_views("""
SELECT run_id, step, array_to_string(list_sort(list_distinct(list(channel))), ',') AS changed
FROM writes GROUP BY run_id, step""", "writes"), "A13")
def q_changed_channels(spark, sf):
    return S.changed_channels(_writes(spark, sf))


VALUE_JSON_SPARK = """CASE channel
    WHEN 'c0' THEN CASE WHEN seq % 5 = 0 THEN concat('"', CAST(value AS STRING), '"') ELSE CAST(value AS STRING) END
    WHEN 'c1' THEN CASE WHEN seq % 7 = 0 THEN 'true' ELSE CAST(value AS STRING) END
    WHEN 'c2' THEN CASE WHEN seq % 2 = 0 THEN concat('[', CAST(value AS STRING), ']') ELSE CAST(value AS STRING) END
    ELSE CASE WHEN seq % 3 = 0 THEN concat('{"', map_key, '": ', CAST(value AS STRING), '}')
              WHEN seq % 3 = 1 THEN 'null' ELSE concat(CAST(value AS STRING), '.5') END END"""


@register("check_channel_type", with_views(f"""
WITH v AS (SELECT thread_id, run_id, seq, CASE WHEN seq % 11 = 0 THEN 'zz' ELSE channel END AS channel,
    {VALUE_JSON_SPARK} AS value_json FROM writes),
k AS (SELECT v.*, c.type AS declared,
    CASE json_type(value_json) WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'bool'
        WHEN 'BIGINT' THEN 'int' WHEN 'UBIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float'
        WHEN 'VARCHAR' THEN 'str' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'dict' END AS actual
    FROM v LEFT JOIN channels c ON v.channel = c.channel)
SELECT * FROM k WHERE declared IS NULL OR NOT (actual = 'null'
    OR (declared = 'int' AND actual IN ('int', 'bool'))
    OR (declared = 'float' AND actual IN ('int', 'float', 'bool'))
    OR (declared = 'str' AND actual = 'str') OR (declared = 'bool' AND actual = 'bool')
    OR (declared = 'list' AND actual = 'list') OR (declared = 'dict' AND actual = 'dict'))""",
                                           "writes", "channels"), "F4")
def q_check_channel_type(spark, sf):
    w = _writes(spark, sf).select("thread_id", "run_id", "seq", "channel",
                                  F.expr(VALUE_JSON_SPARK).alias("value_json"))
    w = w.withColumn("channel", F.when(F.col("seq") % 11 == 0, "zz").otherwise(F.col("channel")))
    return S.check_channel_type(w, fx.channels(spark)).select(
        "thread_id", "run_id", "seq", "channel", "value_json", "declared", "actual")


@register("read_checkpoints", with_views("""
SELECT thread_id, run_id, step, strftime(saved_at, '%Y-%m-%dT%H:%M:%S.%f') AS saved_at,
    pending_node, CAST(frontier_size AS INT) AS frontier, step_tokens AS tokens
FROM checkpoints""", "checkpoints"), "S2")
def q_read_checkpoints(spark, sf):
    docs = C.checkpoint_documents(fx.checkpoints(fx.run_log(spark, sf)))
    ck = C.read_checkpoints(docs)
    return ck.select("thread_id", "run_id", "step", "saved_at",
                     F.col("pending_interrupt.node_id").alias("pending_node"),
                     F.size("frontier").alias("frontier"), F.col("metrics.tokens").alias("tokens"))


@register("latest_checkpoint", with_views("""
SELECT thread_id, run_id, step, ckpt_id, saved_at, step_tokens, step_cost_micros, pending_node, frontier_size FROM (
    SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY ckpt_id DESC) AS r FROM checkpoints) x
WHERE r = 1""", "checkpoints"), "W2")
def q_latest_checkpoint(spark, sf):
    return S.latest_checkpoint(fx.checkpoints(fx.run_log(spark, sf)))


@register("thread_status", with_views("""
SELECT thread_id, run_id, step,
    CASE WHEN pending_node IS NOT NULL THEN 'interrupted' WHEN coalesce(frontier_size, 0) = 0 THEN 'finished'
         ELSE 'stopped' END AS status FROM (
    SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY ckpt_id DESC) AS r FROM checkpoints) x
WHERE r = 1""", "checkpoints"), "W3")
def q_thread_status(spark, sf):
    return S.thread_status(fx.checkpoints(fx.run_log(spark, sf)))


@register("frontier_order", with_views("""
SELECT run_id, step, CAST(row_number() OVER (PARTITION BY run_id, step ORDER BY seq) - 1 AS INT) AS pos,
    concat(node_id, ':', CAST(seq AS VARCHAR)) AS task, type
FROM run_log WHERE node_id IS NOT NULL""", "run_log"), "K3")
def q_frontier_order(spark, sf):
    log = fx.run_log(spark, sf).where(F.col("node_id").isNotNull()).withColumn(
        "task", F.concat("node_id", F.lit(":"), F.col("seq").cast("string")))
    # the declared frontier of a step: its tasks in seq order (bounded by the step's width)
    frontier = log.groupBy("run_id", "step").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "task"))), lambda s: s["task"]).alias("frontier"))
    done = log.select("run_id", "step", "task", "type")
    return S.frontier_order(done, frontier, ["run_id", "step"], task="task").select(
        "run_id", "step", "pos", "task", "type")
