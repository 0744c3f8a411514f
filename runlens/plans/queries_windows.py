"""Registered queries: guards, budgets, visits, retries, status, replay, capture
(W4-W7, W9, W10, W12, A15, A18, F9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guards as G
from ..sources import fixtures as fx
from ..sources.tables import table
from .fixture_sql import with_views
from .registry import register

# Limits used by the registered guard queries (parameters, not data).
LIMITS = {"max_steps": 12, "tokens": 2000.0, "cost_micros": 600.0, "deadline_s": 432000.0}

USAGE_SQL = """
u AS (SELECT run_id, step,
    CAST(coalesce(sum(step_tokens) OVER (PARTITION BY run_id ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tokens_before,
    CAST(sum(step_tokens) OVER (PARTITION BY run_id ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tokens_after,
    CAST(coalesce(sum(step_cost_micros) OVER (PARTITION BY run_id ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cost_before,
    CAST(sum(step_cost_micros) OVER (PARTITION BY run_id ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cost_after,
    (epoch_us(saved_at) - epoch_us(min(saved_at) OVER (PARTITION BY run_id))) / 1e6 AS elapsed_s
  FROM checkpoints)
"""


def _usage(spark, sf):
    return G.step_usage(fx.checkpoints(fx.run_log(spark, sf)))


@register("guard_trip", with_views("WITH " + USAGE_SQL + """,
g AS (SELECT run_id, step, 0 AS g_no, 'max_steps' AS guard, CAST(step AS DOUBLE) AS used, CAST(12.0 AS DOUBLE) AS lim FROM u
  UNION ALL SELECT run_id, step, 1, 'tokens', CAST(tokens_before AS DOUBLE), 2000.0 FROM u
  UNION ALL SELECT run_id, step, 2, 'cost_usd', CAST(cost_before AS DOUBLE), 600.0 FROM u
  UNION ALL SELECT run_id, step, 3, 'deadline', elapsed_s, 432000.0 FROM u),
t AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step, g_no) AS r FROM g WHERE used >= lim)
SELECT run_id, step, guard, used, lim AS limit_value FROM t WHERE r = 1""", "checkpoints"), "W4")
def q_guard_trip(spark, sf):
    return G.guard_trip(_usage(spark, sf), **LIMITS)


@register("budget_warnings", with_views("WITH " + USAGE_SQL + """,
g AS (SELECT run_id, step, 'max_steps' AS guard, CAST(step + 1 AS DOUBLE) AS used, CAST(12.0 AS DOUBLE) AS lim FROM u
  UNION ALL SELECT run_id, step, 'tokens', CAST(tokens_after AS DOUBLE), 2000.0 FROM u
  UNION ALL SELECT run_id, step, 'cost_usd', CAST(cost_after AS DOUBLE), 600.0 FROM u
  UNION ALL SELECT run_id, step, 'deadline', elapsed_s, 432000.0 FROM u)
SELECT run_id, step, guard, used, lim AS limit_value FROM g
WHERE CASE WHEN lim = 0 THEN 0.0 ELSE used / lim END >= 0.8""", "checkpoints"), "W5")
def q_budget_warnings(spark, sf):
    return G.budget_warnings(_usage(spark, sf), **LIMITS)


def _nodes(spark, sf):
    n = fx.nodes_g(spark, sf)
    return n.select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), "max_iterations",
                    F.when(F.col("id") % 2 == 0, F.concat(F.lit("n"), (F.col("id") + 1).cast("string")))
                     .alias("on_exhausted"))


@register("visit_guard", with_views("""
WITH v AS (SELECT run_id, node_id, seq,
    CAST(row_number() OVER (PARTITION BY run_id, node_id ORDER BY seq) AS BIGINT) AS visit
  FROM run_log WHERE node_id IS NOT NULL),
n AS (SELECT concat('n', CAST(id AS VARCHAR)) AS node_id, max_iterations,
    CASE WHEN id % 2 = 0 THEN concat('n', CAST(id + 1 AS VARCHAR)) END AS on_exhausted FROM nodes_g)
SELECT v.run_id, v.node_id, v.seq, v.visit, n.max_iterations,
    CASE WHEN n.on_exhausted IS NOT NULL THEN concat('exhausted->', n.on_exhausted) ELSE 'fatal' END AS outcome
FROM v JOIN n ON v.node_id = n.node_id
WHERE n.max_iterations IS NOT NULL AND v.visit > n.max_iterations""", "run_log", "nodes_g"), "W6")
def q_visit_guard(spark, sf):
    visits = fx.run_log(spark, sf).where(F.col("node_id").isNotNull()).select("run_id", "node_id", "seq")
    return G.visit_guard(visits, _nodes(spark, sf))


STATUS_SQL = """CASE event_id % 6 WHEN 0 THEN 429 WHEN 1 THEN 500 WHEN 2 THEN 503 WHEN 3 THEN 404
    WHEN 4 THEN 400 END"""
ERRTYPE_SQL = """CASE WHEN event_id % 6 = 5 THEN CASE WHEN event_id % 4 < 2 THEN 'NodeTimeout'
    ELSE 'ValueError' END END"""
FAIL_SQL_COLS = f"{STATUS_SQL} AS status, {ERRTYPE_SQL} AS error_type"
TRANSIENT_SQL = """error_type IN ('TransientError', 'NodeTimeout', 'ConnectionError', 'TimeoutError',
    'ConnectionRefusedError', 'ConnectionResetError', 'ConnectionAbortedError', 'BrokenPipeError')"""
KIND_SQL = f"""CASE WHEN status IS NOT NULL THEN
        CASE WHEN status >= 200 AND status < 300 THEN 'ok' WHEN status = 429 OR status >= 500 THEN 'transient'
             ELSE 'deterministic' END
    WHEN {TRANSIENT_SQL} THEN 'transient' ELSE 'deterministic' END"""
KIND_404_SQL = f"""CASE WHEN status IS NOT NULL THEN
        CASE WHEN status IN (200, 404) THEN 'ok' WHEN status = 429 OR status >= 500 THEN 'transient'
             ELSE 'deterministic' END
    WHEN {TRANSIENT_SQL} THEN 'transient' ELSE 'deterministic' END"""


def _failures(spark, sf):
    log = fx.run_log(spark, sf).where(F.col("type").isin("node_failed", "node_retrying"))
    f = log.select("run_id", "node_id", "seq", "event_id", F.expr(STATUS_SQL).alias("status"),
                   F.expr(ERRTYPE_SQL).alias("error_type"))
    return f.withColumn("kind", G.classify_error(F.col("status"), F.col("error_type")))


@register("classify_error", with_views(f"""
WITH f AS (SELECT run_id, node_id, seq, event_id, {FAIL_SQL_COLS}
  FROM run_log WHERE type IN ('node_failed', 'node_retrying'))
SELECT *, {KIND_SQL} AS kind, {KIND_404_SQL} AS kind_accepting_404 FROM f""", "run_log"), "F9")
def q_classify_error(spark, sf):
    f = _failures(spark, sf)
    return f.withColumn("kind_accepting_404",
                        G.classify_error(F.col("status"), F.col("error_type"), accepted=[200, 404]))


@register("retry_schedule", with_views(f"""
WITH f AS (SELECT run_id, node_id, seq // 40 AS visit, seq, event_id, {FAIL_SQL_COLS}
  FROM run_log WHERE type IN ('node_failed', 'node_retrying')),
k AS (SELECT *, {KIND_SQL} AS kind, CASE WHEN status = 429 THEN CAST(1.5 AS DOUBLE) END AS retry_after,
    CAST(row_number() OVER (PARTITION BY run_id, node_id, visit ORDER BY seq) AS BIGINT) AS attempt FROM f),
s AS (SELECT *, min(CASE WHEN kind <> 'transient' THEN attempt END) OVER (PARTITION BY run_id, node_id, visit) AS stop
    FROM k),
d AS (SELECT *, CASE WHEN retry_after IS NOT NULL
        THEN greatest(least(0.5 * pow(2.0, attempt - 1), 60.0), retry_after)
        ELSE least(0.5 * pow(2.0, attempt - 1), 60.0) END AS delay_s
  FROM s WHERE attempt < 3 AND (stop IS NULL OR attempt < stop))
SELECT * EXCLUDE (stop), sum(delay_s) OVER (PARTITION BY run_id, node_id, visit ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS wait_s FROM d""", "run_log"), "W7")
def q_retry_schedule(spark, sf):
    # a visit of a node: a stretch of 40 events of the run
    f = _failures(spark, sf).withColumn("retry_after", F.when(F.col("status") == 429, F.lit(1.5))) \
        .withColumn("visit", F.floor(F.col("seq") / 40))
    return G.retry_schedule(f, ["run_id", "node_id", "visit"])


@register("node_status", with_views("""
WITH e AS (SELECT run_id, node_id, seq, CASE WHEN type = 'node_retrying' THEN 'superstep_started'
        WHEN type = 'node_fallback' THEN 'node_started' ELSE type END AS type, cached, tokens % 40 = 10 AS degraded FROM run_log
    WHERE node_id IS NOT NULL),
s AS (SELECT run_id, node_id, seq, CASE type WHEN 'node_finished' THEN CASE WHEN degraded THEN 'degraded' WHEN cached THEN 'cached'
        ELSE 'ok' END WHEN 'node_started' THEN 'running' WHEN 'node_failed' THEN 'failed'
        WHEN 'interrupt_raised' THEN 'waiting' WHEN 'superstep_started' THEN 'queued' END AS st FROM e),
f AS (SELECT run_id, node_id, arg_max(st, CASE WHEN st <> 'queued' THEN seq END) FILTER (st <> 'queued') AS st,
    max(CASE WHEN st <> 'queued' THEN seq END) AS told, max(CASE WHEN st = 'queued' THEN seq END) AS queued
  FROM s GROUP BY run_id, node_id)
SELECT run_id, node_id, CASE WHEN queued IS NOT NULL AND (st IS NULL OR queued > told AND st <> 'running') THEN 'queued' ELSE st END
    AS status FROM f""", "run_log"), "W9")
def q_node_status(spark, sf):
    # retries stand for supersteps that queue a node, fallbacks for started nodes
    ev = fx.run_log(spark, sf).withColumn("type", F.when(F.col("type") == "node_retrying", "superstep_started")
                                          .when(F.col("type") == "node_fallback", "node_started").otherwise(F.col("type")))
    return G.node_status(ev.withColumn("degraded", F.col("tokens") % 40 == 10))


REPLAY_SQL = """
SELECT run_id, seq, type, node_id, event_id, CAST(least(cnt, {n}) - r + 1 AS BIGINT) AS replay_pos FROM (
    SELECT run_id, seq, type, node_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS r,
        count(*) OVER (PARTITION BY run_id) AS cnt FROM run_log) x
WHERE r <= {n}"""


@register("bounded_replay", with_views(REPLAY_SQL.format(n=1000), "run_log"), "W10")
def q_bounded_replay(spark, sf):
    ev = fx.run_log(spark, sf).select("run_id", "seq", "type", "node_id", "event_id")
    return G.bounded_replay(ev, 1000)


@register("bounded_replay_5", with_views(REPLAY_SQL.format(n=5), "run_log"), "W10")
def q_bounded_replay_5(spark, sf):
    ev = fx.run_log(spark, sf).select("run_id", "seq", "type", "node_id", "event_id")
    return G.bounded_replay(ev, 5)


@register("capture_cap", """
WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line,
    unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM conversations),
c AS (SELECT conv_id, turn, line_no, CAST(length(line) + 1 AS BIGINT) AS chars,
    CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn, line_no
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS captured_before FROM l)
SELECT * FROM c WHERE captured_before < 2048""", "W12")
def q_capture_cap(spark, sf):
    c = table(spark, sf, "conversations")
    lines = c.select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select(
        "conv_id", "turn", (F.col("pos") + 1).cast("bigint").alias("line_no"),
        (F.length("line") + 1).cast("bigint").alias("chars"))
    return G.capture_cap(lines, ["conv_id"], ["turn", "line_no"], cap=2048).select(
        "conv_id", "turn", "line_no", "chars", F.col("captured_before").cast("bigint").alias("captured_before"))


VARIANT_ORDER = ["purchase", "click", "view", "signup"]


@register("first_success", with_views("""
WITH c AS (SELECT *, list_position(['purchase', 'click', 'view', 'signup'], variant) AS rnk,
        CASE WHEN json_valid(response) THEN json_type(response) = 'OBJECT' ELSE false END AS ok FROM candidates),
c2 AS (SELECT * FROM c WHERE rnk IS NOT NULL AND rnk > 0),
f AS (SELECT item, variant, min(CASE WHEN ok THEN attempt END) AS first_ok FROM c2 GROUP BY item, variant),
pv AS (SELECT c2.item, c2.variant, c2.rnk,
        sum(CASE WHEN f.first_ok IS NULL OR c2.attempt <= f.first_ok THEN 1 ELSE 0 END) AS used,
        bool_or(f.first_ok IS NOT NULL) AS okv
    FROM c2 JOIN f ON c2.item = f.item AND c2.variant = f.variant GROUP BY c2.item, c2.variant, c2.rnk),
b AS (SELECT item, min(CASE WHEN okv THEN rnk END) AS best FROM pv GROUP BY item),
r AS (SELECT pv.item, b.best, sum(used) AS att, arg_max(variant, rnk) AS var
    FROM pv JOIN b ON pv.item = b.item WHERE b.best IS NULL OR pv.rnk <= b.best GROUP BY pv.item, b.best)
SELECT item, CASE WHEN best IS NULL THEN 'static' ELSE var END AS variant, best IS NULL AS degraded,
    CAST(CASE WHEN best IS NULL THEN att + 1 ELSE att END AS BIGINT) AS attempts FROM r
UNION ALL SELECT item, 'static', true, CAST(1 AS BIGINT) FROM c GROUP BY item
    HAVING count(CASE WHEN rnk > 0 THEN 1 END) = 0""", "candidates"), "A15")
def q_first_success(spark, sf):
    c = fx.candidates(spark, sf)
    ok = F.coalesce(F.schema_of_variant(F.try_parse_json("response")).startswith("OBJECT"), F.lit(False))
    return G.first_success(c.withColumn("ok", ok), VARIANT_ORDER)


@register("node_budget", with_views("""
WITH u AS (SELECT run_id, node_id, seq, tokens,
    sum(tokens) OVER (PARTITION BY run_id, node_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        AS cum_tokens FROM run_log WHERE type = 'node_finished'),
b AS (SELECT concat('n', CAST(id AS VARCHAR)) AS node_id, 150 * (id + 1) AS token_budget FROM nodes_g)
SELECT u.node_id, u.run_id, u.seq, u.tokens, CAST(u.cum_tokens AS BIGINT) AS cum_tokens, b.token_budget
FROM u JOIN b ON u.node_id = b.node_id WHERE u.cum_tokens > b.token_budget""", "run_log", "nodes_g"), "A18")
def q_node_budget(spark, sf):
    usage = fx.run_log(spark, sf).where(F.col("type") == "node_finished")
    budgets = fx.nodes_g(spark, sf).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"),
                                           (F.lit(150) * (F.col("id") + 1)).alias("token_budget"))
    return G.node_budget(usage, budgets).select("node_id", "run_id", "seq", "tokens",
                                                F.col("cum_tokens").cast("bigint").alias("cum_tokens"),
                                                "token_budget")
