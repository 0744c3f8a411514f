"""The fixture views as portable SQL (same text as FIXTURES.md).

Used only to build oracle queries for DuckDB: ``with_views(body, "run_log")``
prefixes the body with the CTEs it needs.  The Spark side builds the same
views with the DataFrame API in ``runlens.sources.fixtures``.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {}
DEPENDS: dict[str, tuple[str, ...]] = {}

VIEWS["run_log"] = """
WITH b AS (SELECT event_id, ts, user_id, event_type, value,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
    concat('t', CAST(user_id AS STRING)) AS thread_id,
    concat('t', CAST(user_id AS STRING), '-w',
           CAST(CAST(floor((day(ts) - 1) / 7) AS INT) AS STRING)) AS run_id FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS seq,
    count(*) OVER (PARTITION BY run_id) AS cnt FROM b),
t AS (SELECT *, CASE WHEN seq = 1 THEN 'run_started'
    WHEN seq = cnt AND event_type = 'error' THEN 'run_failed'
    WHEN seq = cnt AND event_type = 'signup' THEN 'run_interrupted'
    WHEN seq = cnt AND event_type = 'view' THEN 'run_cancelled'
    WHEN seq = cnt AND event_type = 'purchase' THEN 'run_finished'
    WHEN event_type IN ('click', 'purchase') THEN 'node_finished'
    WHEN event_type = 'error' THEN 'node_failed'
    WHEN event_type = 'signup' THEN 'node_retrying'
    WHEN k % 2 = 0 THEN 'node_fallback' ELSE 'interrupt_raised' END AS type FROM n)
SELECT run_id, thread_id, CAST(seq AS BIGINT) AS seq, CAST(floor((seq - 1) / 2) AS INT) AS step, ts, type,
    CASE WHEN type LIKE 'run_%' THEN NULL ELSE concat('n', CAST(event_id % 7 AS STRING)) END AS node_id,
    CASE WHEN type = 'run_started' THEN concat('wf', CAST(user_id % 5 AS STRING)) END AS graph,
    CAST(floor(value * 10) AS BIGINT) AS duration_ms, CAST(k * 10 AS BIGINT) AS tokens,
    CAST(k * 3 AS BIGINT) AS cost_micros, CAST(1 + k % 3 AS INT) AS attempts,
    k % 10 = 0 AS cached, event_id,
    CASE WHEN type IN ('run_finished', 'run_failed', 'run_interrupted', 'run_cancelled') THEN k % 4 END AS dead_letters
FROM t
"""

VIEWS["checkpoints"] = """
SELECT thread_id, run_id, step, min(event_id) AS ckpt_id, max(ts) AS saved_at,
    CAST(sum(CASE WHEN type = 'node_finished' THEN tokens ELSE 0 END) AS BIGINT) AS step_tokens,
    CAST(sum(CASE WHEN type = 'node_finished' THEN cost_micros ELSE 0 END) AS BIGINT) AS step_cost_micros,
    max(CASE WHEN type = 'interrupt_raised' THEN node_id END) AS pending_node,
    count(node_id) AS frontier_size
FROM run_log GROUP BY thread_id, run_id, step
"""
DEPENDS["checkpoints"] = ("run_log",)

VIEWS["writes"] = """
SELECT thread_id, run_id, seq, step, concat('c', CAST(event_id % 4 AS STRING)) AS channel,
    node_id AS map_key, tokens AS value, cost_micros AS value2
FROM run_log WHERE type = 'node_finished'
"""
DEPENDS["writes"] = ("run_log",)

VIEWS["channels"] = """
SELECT * FROM (VALUES ('c0', 'int', 'last'), ('c1', 'int', 'sum'),
    ('c2', 'list', 'append'), ('c3', 'dict', 'merge_dict')) AS t(channel, type, reducer)
"""

VIEWS["arrivals"] = """
SELECT thread_id, source, state FROM (
    SELECT run_id AS thread_id, node_id AS source,
        CASE type WHEN 'node_finished' THEN 'ok' WHEN 'node_failed' THEN 'failed' ELSE 'skipped' END AS state,
        row_number() OVER (PARTITION BY run_id, node_id ORDER BY seq DESC) AS r
    FROM run_log WHERE node_id IN ('n0', 'n1', 'n2')) x WHERE r = 1
"""
DEPENDS["arrivals"] = ("run_log",)

VIEWS["cases"] = """
SELECT run_id AS name, CASE WHEN count(*) % 3 = 0 THEN 'failed' WHEN count(*) % 3 = 1 THEN 'finished' END AS expect_status,
    CASE WHEN count(*) % 2 = 0 THEN CAST(3000 AS BIGINT) END AS token_budget
FROM run_log GROUP BY run_id
"""
DEPENDS["cases"] = ("run_log",)

VIEWS["candidates"] = """
SELECT user_id AS item, event_type AS variant,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt,
    CASE k % 4 WHEN 0 THEN props WHEN 1 THEN concat('Sure. ', repeat('`', 3), 'json ', props, ' ', repeat('`', 3))
        WHEN 2 THEN concat('The answer is ', props, ' as asked.')
        ELSE concat('no object ', substr(props, 1, 3)) END AS response
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e
"""

VIEWS["edges_g"] = """
SELECT o_custkey AS src, o_custkey - o_custkey % 40 + max(o_orderkey) * 7 % 40 AS dst FROM orders GROUP BY o_custkey
"""

VIEWS["nodes_g"] = """
SELECT id, CASE WHEN id % 3 = 0 AND id // 8 % 16 = 0 THEN 3 END AS max_iterations
FROM (SELECT c_custkey AS id FROM customer UNION SELECT dst FROM edges_g) x
"""

DEPENDS["nodes_g"] = ("edges_g",)

VIEWS["templates"] = """
SELECT n_nationkey AS id, concat('Hello <nation.name>, region <region.name>: $', '{HOME_DIR} secret://key_',
    CAST(n_regionkey AS STRING)) AS template FROM nation
"""


def _order(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        for d in DEPENDS.get(n, ()):
            visit(d)
        if n not in seen:
            seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with CTEs for the named fixture views and their dependencies."""
    if not names:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in _order(names))
    body = body.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
