"""Registered queries: run-log reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from ..sources import fixtures as fx
from ..sources.tables import table
from .fixture_sql import with_views
from .ordered import ordered_scan
from .registry import register

TERMS = "('run_finished', 'run_failed', 'run_interrupted', 'run_cancelled')"
NODE_ROW = f"node_id IS NOT NULL AND type <> 'interrupt_raised' AND type <> 'run_started' AND type NOT IN {TERMS}"
STATUS_OF = """CASE {c} WHEN 'run_finished' THEN 'finished' WHEN 'run_failed' THEN 'failed'
    WHEN 'run_interrupted' THEN 'interrupted' WHEN 'run_cancelled' THEN 'cancelled' END"""

NODE_METRICS_SQL = with_views(f"""
SELECT run_id, node_id,
    CAST(sum(CASE WHEN type = 'node_finished' THEN 1 ELSE 0 END) AS BIGINT) AS runs,
    CAST(sum(CASE WHEN type = 'node_finished' THEN duration_ms ELSE 0 END) AS BIGINT) AS latency_ms,
    CAST(sum(CASE WHEN type = 'node_finished' THEN coalesce(nullif(attempts, 0), 1) ELSE 0 END) AS BIGINT) AS attempts,
    CAST(sum(CASE WHEN type = 'node_retrying' THEN 1 ELSE 0 END) AS BIGINT) AS retries,
    CAST(sum(CASE WHEN type = 'node_fallback' THEN 1 ELSE 0 END) AS BIGINT) AS fallbacks,
    CAST(sum(CASE WHEN type = 'node_failed' THEN 1 ELSE 0 END) AS BIGINT) AS failures,
    CAST(sum(CASE WHEN type = 'node_finished' AND coalesce(cached, false) THEN 1 ELSE 0 END) AS BIGINT) AS cached,
    CAST(sum(CASE WHEN type = 'node_finished' THEN tokens ELSE 0 END) AS BIGINT) AS tokens,
    CAST(sum(CASE WHEN type = 'node_finished' THEN cost_micros ELSE 0 END) AS BIGINT) AS cost_micros
FROM run_log WHERE {NODE_ROW}
GROUP BY run_id, node_id
""", "run_log")

RUN_REPORT_BODY = f"""
rr AS (SELECT run_id, max(thread_id) AS thread_id,
    arg_max(coalesce(graph, ''), CASE WHEN type = 'run_started' THEN seq END) AS wf,
    arg_max(CASE WHEN type IN {TERMS} THEN type END, CASE WHEN type IN {TERMS} THEN seq END) AS last_term,
    max(CASE WHEN type IN {TERMS} THEN seq END) AS last_term_seq,
    min(CASE WHEN type = 'guard_tripped' THEN seq END) AS guard_seq,
    coalesce(max(step), 0) AS steps,
    epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us,
    CAST(sum(CASE WHEN {NODE_ROW} AND type = 'node_finished' THEN tokens ELSE 0 END) AS BIGINT) AS tokens,
    CAST(sum(CASE WHEN {NODE_ROW} AND type = 'node_finished' THEN cost_micros ELSE 0 END) AS BIGINT) AS cost_micros,
    CAST(sum(CASE WHEN {NODE_ROW} AND type = 'node_finished' THEN 1 ELSE 0 END) AS BIGINT) AS nodes_run,
    CAST(sum(CASE WHEN {NODE_ROW} AND type = 'node_retrying' THEN 1 ELSE 0 END) AS BIGINT) AS retries,
    CAST(sum(CASE WHEN {NODE_ROW} AND type = 'node_fallback' THEN 1 ELSE 0 END) AS BIGINT) AS fallbacks,
    CAST(coalesce(max(CASE WHEN type IN {TERMS} THEN dead_letters END), 0) AS BIGINT) AS dead_letters,
    CAST(sum(CASE WHEN type = 'interrupt_raised' THEN 1 ELSE 0 END) AS BIGINT) AS interventions
  FROM run_log GROUP BY run_id),
run_report AS (SELECT run_id, thread_id, coalesce(wf, '') AS workflow,
    CASE WHEN last_term = 'run_failed' AND guard_seq < last_term_seq THEN 'guard_tripped'
         ELSE coalesce({STATUS_OF.format(c='last_term')}, 'running') END AS status,
    steps, duration_us, tokens, cost_micros, nodes_run, retries, fallbacks, dead_letters, interventions
  FROM rr)
"""


def _log(spark, sf):
    return fx.run_log(spark, sf)


@register("node_metrics", NODE_METRICS_SQL, "A1")
def q_node_metrics(spark, sf):
    return R.node_metrics(_log(spark, sf))


@register("run_report", with_views("WITH " + RUN_REPORT_BODY + "SELECT * FROM run_report", "run_log"), "A2")
def q_run_report(spark, sf):
    return R.run_report(_log(spark, sf))


@register("fleet_aggregate", with_views("WITH " + RUN_REPORT_BODY + """
SELECT CAST(count(*) AS BIGINT) AS runs,
    CAST(sum(CASE WHEN status = 'finished' THEN 1 ELSE 0 END) AS BIGINT) AS passed,
    CAST(sum(CASE WHEN status IN ('failed', 'guard_tripped') THEN 1 ELSE 0 END) AS BIGINT) AS failed,
    CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total_tokens,
    CAST(coalesce(sum(cost_micros), 0) AS BIGINT) AS total_cost_micros,
    coalesce(avg(duration_us) / 1e6, 0.0) AS avg_duration_s
FROM run_report""", "run_log"), "A3")
def q_fleet_aggregate(spark, sf):
    return R.fleet_aggregate(R.run_report(_log(spark, sf)))


@register("fleet_aggregate_empty", with_views("WITH " + RUN_REPORT_BODY + """
SELECT CAST(count(*) AS BIGINT) AS runs,
    CAST(coalesce(sum(CASE WHEN status = 'finished' THEN 1 ELSE 0 END), 0) AS BIGINT) AS passed,
    CAST(coalesce(sum(CASE WHEN status IN ('failed', 'guard_tripped') THEN 1 ELSE 0 END), 0) AS BIGINT) AS failed,
    CAST(coalesce(sum(tokens), 0) AS BIGINT) AS total_tokens,
    CAST(coalesce(sum(cost_micros), 0) AS BIGINT) AS total_cost_micros,
    coalesce(avg(duration_us) / 1e6, 0.0) AS avg_duration_s
FROM run_report WHERE workflow = 'no such workflow'""", "run_log"), "A3")
def q_fleet_aggregate_empty(spark, sf):
    reports = R.run_report(_log(spark, sf)).where(F.col("workflow") == "no such workflow")
    return R.fleet_aggregate(reports).select(
        "runs", F.coalesce("passed", F.lit(0)).cast("long").alias("passed"),
        F.coalesce("failed", F.lit(0)).cast("long").alias("failed"),
        "total_tokens", "total_cost_micros", "avg_duration_s")


LIST_RUNS_BODY = f"""
list_runs AS (SELECT run_id, max(thread_id) AS thread_id,
    coalesce(max(CASE WHEN type = 'run_started' THEN graph END), '?') AS workflow,
    coalesce({STATUS_OF.format(c='arg_max(type, event_id)')}, 'running') AS status,
    coalesce(max(step), 0) AS steps, min(ts) AS started, max(ts) AS ended, min(event_id) AS first_id
  FROM run_log GROUP BY run_id)
"""


@register("list_runs", with_views("WITH " + LIST_RUNS_BODY + "SELECT * FROM list_runs", "run_log"), "A4")
def q_list_runs(spark, sf):
    return R.list_runs(_log(spark, sf))


@register("recent_runs", with_views("WITH " + LIST_RUNS_BODY +
                                    "SELECT * FROM list_runs ORDER BY first_id DESC LIMIT 50", "run_log"), "K1")
def q_recent_runs(spark, sf):
    return R.recent_runs(_log(spark, sf), limit=50)


@register("recent_runs_workflow", with_views("WITH " + LIST_RUNS_BODY +
                                             "SELECT * FROM list_runs WHERE workflow = 'wf3' "
                                             "ORDER BY first_id DESC LIMIT 20", "run_log"), "K1")
def q_recent_runs_workflow(spark, sf):
    return R.recent_runs(_log(spark, sf), limit=20, workflow="wf3")


@register("dead_letters", with_views("""
SELECT run_id, thread_id, node_id, step, seq, attempts,
    CASE WHEN tokens % 3 = 0 THEN concat('HTTP ', CAST(500 + tokens % 4 AS VARCHAR), ' after ', CAST(duration_ms AS VARCHAR), ' ms')
         WHEN tokens % 3 = 1 THEN concat('bad field ', node_id) ELSE 'unknown error' END AS error,
    CASE tokens % 3 WHEN 0 THEN 'TransientError' WHEN 1 THEN 'SchemaError' ELSE 'ConfigError' END AS error_type
FROM run_log WHERE type = 'node_failed'""", "run_log"), "A12")
def q_dead_letters(spark, sf):
    kind = F.col("tokens") % 3
    log = _log(spark, sf).withColumn("error", F.when(kind == 0, F.concat(
        F.lit("HTTP "), (500 + F.col("tokens") % 4).cast("string"), F.lit(" after "), F.col("duration_ms").cast("string"), F.lit(" ms")))
        .when(kind == 1, F.concat(F.lit("bad field "), "node_id"))) \
        .withColumn("error_type", F.when(kind == 0, "TransientError").when(kind == 1, "SchemaError"))
    return R.dead_letters(log)


@register("dead_letter_counts", with_views("""
SELECT run_id, count(*) AS dead_letters FROM run_log WHERE type = 'node_failed' GROUP BY run_id""",
                                           "run_log"), "A12")
def q_dead_letter_counts(spark, sf):
    return R.dead_letter_counts(_log(spark, sf))


@register("metrics_override", with_views("WITH " + RUN_REPORT_BODY + """,
n AS (SELECT run_id, step, ckpt_id, sum(step_tokens) OVER w AS tok, sum(step_cost_micros) OVER w AS cost,
        sum((SELECT count(*) FROM run_log l WHERE l.run_id = c.run_id AND l.step = c.step AND l.type = 'node_finished'))
            OVER w AS nodes, row_number() OVER (PARTITION BY run_id ORDER BY ckpt_id DESC) AS newest
    FROM checkpoints c WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cm AS (SELECT run_id, step AS ckpt_step, CAST(tok AS BIGINT) AS ckpt_tokens, CAST(cost AS BIGINT) AS ckpt_cost_micros,
    CAST(nodes AS BIGINT) AS ckpt_nodes_run FROM n WHERE newest = 1)
SELECT r.run_id, thread_id, workflow, status, steps, duration_us,
    CASE WHEN cm.ckpt_step IS NOT NULL THEN ckpt_tokens ELSE tokens END AS tokens,
    CASE WHEN cm.ckpt_step IS NOT NULL THEN ckpt_cost_micros ELSE cost_micros END AS cost_micros,
    CASE WHEN cm.ckpt_step IS NOT NULL THEN ckpt_nodes_run ELSE nodes_run END AS nodes_run,
    retries, fallbacks, dead_letters, interventions
FROM run_report r LEFT JOIN cm ON r.run_id = cm.run_id""", "run_log", "checkpoints"), "J6")
def q_metrics_override(spark, sf):
    log = _log(spark, sf)
    # runs without any checkpoint have their event sums
    return R.metrics_override(R.run_report(log), R.checkpoint_metrics(fx.cumulative_checkpoints(log)))


@register("assign_seq", """
SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq
FROM events""", "W1")
def q_assign_seq(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return ordered_scan(ev, ["user_id"], ["ts", "event_id"], index="seq").select("event_id", "user_id", "seq")
