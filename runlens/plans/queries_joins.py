"""Registered queries: joins, sets, sinks and sources
(J2-J5, J7-J10, U1-U3, K2, A14, A16, A17, A19, W11, S1, S3, S4, S6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins as J
from ..operators import sets as U
from ..sources import fixtures as fx
from ..sources import sinks as K
from ..sources.tables import table
from .fixture_sql import with_views
from .registry import register

# Declared graph of the barrier query: three sources feed one merge node.
BARRIER_EDGES = [("n0", "merge"), ("n1", "merge"), ("n2", "merge")]

BARRIER_SQL = """
WITH e AS (SELECT * FROM (VALUES ('n0', 'merge'), ('n1', 'merge'), ('n2', 'merge')) t(source, merge)),
n AS (SELECT merge, count(*) AS n_expected FROM e GROUP BY merge),
a AS (SELECT ar.thread_id, e.merge, ar.state FROM arrivals ar JOIN e ON ar.source = e.source),
g AS (SELECT thread_id, merge, sum(CASE WHEN state = 'ok' THEN 1 ELSE 0 END) AS ok,
        sum(CASE WHEN state = 'failed' THEN 1 ELSE 0 END) AS failed,
        sum(CASE WHEN state = 'skipped' THEN 1 ELSE 0 END) AS skipped_arrived, count(*) AS arrived
      FROM a GROUP BY thread_id, merge)
SELECT thread_id, g.merge, CAST(ok AS BIGINT) AS ok, CAST(failed AS BIGINT) AS failed,
    CAST(skipped_arrived + n_expected - arrived AS BIGINT) AS skipped, CAST(ok + failed AS BIGINT) AS required,
    CAST({thr} AS BIGINT) AS threshold, ok >= {thr} AS passed
FROM g JOIN n ON g.merge = n.merge"""


def _barrier(spark, sf, threshold):
    edges = spark.createDataFrame(BARRIER_EDGES, "source string, merge string")
    return J.merge_barrier(edges, fx.arrivals(fx.run_log(spark, sf)), threshold)


@register("merge_barrier", with_views(BARRIER_SQL.format(thr="ok + failed"), "arrivals"), "J2")
def q_merge_barrier(spark, sf):
    return _barrier(spark, sf, None)


@register("merge_barrier_threshold", with_views(BARRIER_SQL.format(thr="2"), "arrivals"), "J2")
def q_merge_barrier_threshold(spark, sf):
    return _barrier(spark, sf, 2)


CACHE_SQL = """
WITH c AS (SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey {op} (SELECT o_orderkey FROM c)"""


def _cache(spark, sf):
    work = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    cache = table(spark, sf, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)) \
        .select(F.col("l_orderkey").alias("o_orderkey"))
    return J.cache_probe(work, cache, ["o_orderkey"])


@register("cache_hits", CACHE_SQL.format(op="IN"), "J3")
def q_cache_hits(spark, sf):
    return _cache(spark, sf)[0]


@register("cache_todo", CACHE_SQL.format(op="NOT IN"), "J3")
def q_cache_todo(spark, sf):
    return _cache(spark, sf)[1]


@register("zip_by_position", """
WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos
    FROM conversations WHERE role = 'user'),
b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos
    FROM conversations WHERE role = 'assistant')
SELECT a.conv_id, CAST(a.pos AS BIGINT) AS pos, a.turn AS a_turn, b.turn AS b_turn
FROM a JOIN b ON a.conv_id = b.conv_id AND a.pos = b.pos""", "J4")
def q_zip_by_position(spark, sf):
    c = table(spark, sf, "conversations")
    a = c.where(F.col("role") == "user").select("conv_id", "turn")
    b = c.where(F.col("role") == "assistant").select("conv_id", "turn")
    return J.zip_by_position(a, b, "conv_id", "turn").select("conv_id", "pos", "a_turn", "b_turn")


@register("dangling_refs", """
WITH refs AS (
    SELECT 'part' AS kind, l_orderkey * 10 + l_linenumber AS ref_id,
        CASE WHEN l_orderkey % 97 = 0 THEN l_partkey + 1000000 ELSE l_partkey END AS target, 'error' AS severity
    FROM lineitem
    UNION ALL SELECT 'customer', o_orderkey, CASE WHEN o_orderkey % 89 = 0 THEN o_custkey + 1000000 ELSE o_custkey END,
        'error' FROM orders
    UNION ALL SELECT 'supplier', l_orderkey * 10 + l_linenumber, l_suppkey, 'warning' FROM lineitem),
allowed AS (SELECT 'part' AS kind, p_partkey AS target FROM part
    UNION ALL SELECT 'customer', c_custkey FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier)
SELECT * FROM refs r WHERE NOT EXISTS (SELECT 1 FROM allowed a WHERE a.kind = r.kind AND a.target = r.target)""",
          "J5")
def q_dangling_refs(spark, sf):
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders")
    rid = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id")
    refs = li.select(F.lit("part").alias("kind"), rid, F.when(F.col("l_orderkey") % 97 == 0,
                     F.col("l_partkey") + 1000000).otherwise(F.col("l_partkey")).alias("target"),
                     F.lit("error").alias("severity")) \
        .unionByName(o.select(F.lit("customer").alias("kind"), F.col("o_orderkey").alias("ref_id"),
                              F.when(F.col("o_orderkey") % 89 == 0, F.col("o_custkey") + 1000000)
                              .otherwise(F.col("o_custkey")).alias("target"), F.lit("error").alias("severity"))) \
        .unionByName(li.select(F.lit("supplier").alias("kind"), rid, F.col("l_suppkey").alias("target"),
                               F.lit("warning").alias("severity")))
    allowed = table(spark, sf, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("target")) \
        .unionByName(table(spark, sf, "customer").select(F.lit("customer").alias("kind"),
                                                         F.col("c_custkey").alias("target"))) \
        .unionByName(table(spark, sf, "supplier").select(F.lit("supplier").alias("kind"),
                                                         F.col("s_suppkey").alias("target")))
    return J.dangling_refs(refs, allowed)


# Price table of the pricing query (per 1M tokens; wf3 and wf4 are unpriced).
PRICES = [("wf0", 3.0, 15.0), ("wf1", 0.5, 1.5), ("wf2", 10.0, 30.0)]


@register("price_usage", with_views("""
WITH p AS (SELECT * FROM (VALUES ('wf0', 3.0, 15.0), ('wf1', 0.5, 1.5), ('wf2', 10.0, 30.0))
        t(provider, input_per_1m, output_per_1m)),
w AS (SELECT run_id, graph AS provider FROM run_log WHERE type = 'run_started'),
u AS (SELECT l.run_id, l.seq, w.provider, l.tokens AS prompt_tokens, l.cost_micros AS completion_tokens
      FROM run_log l JOIN w ON l.run_id = w.run_id WHERE l.type = 'node_finished')
SELECT u.*, coalesce((prompt_tokens * CAST(p.input_per_1m AS DOUBLE)
    + completion_tokens * CAST(p.output_per_1m AS DOUBLE)) / 1e6, 0.0) AS cost_usd
FROM u LEFT JOIN p ON u.provider = p.provider""", "run_log"), "J7")
def q_price_usage(spark, sf):
    log = fx.run_log(spark, sf)
    w = log.where(F.col("type") == "run_started").select("run_id", F.col("graph").alias("provider"))
    u = log.where(F.col("type") == "node_finished").join(w, "run_id").select(
        "run_id", "seq", "provider", F.col("tokens").alias("prompt_tokens"),
        F.col("cost_micros").alias("completion_tokens"))
    prices = spark.createDataFrame(PRICES, "provider string, input_per_1m double, output_per_1m double")
    return J.price_usage(u, prices)


# Trigger declarations of the webhook query: two workflows claim the click path
# (the later one wins); the error hook reads its input from the body.
TRIGGERS = [(1, "webhook", "wf_a", "/click/", "body", {"src": "a"}),
            (2, "webhook", "wf_b", "click", None, {"src": "b"}),
            (3, "webhook", "wf_c", "error", "body", {"src": "c", "k": "0"}),
            (4, "schedule", "wf_d", None, None, None)]
TRIGGER_SCHEMA = ("trigger_id int, type string, workflow string, path string, input_from string, "
                  "input map<string,string>")

WEBHOOK_SQL = """
WITH t AS (SELECT * FROM (VALUES (1, 'webhook', 'wf_a', '/click/', 'body', 'src=a'),
        (2, 'webhook', 'wf_b', 'click', NULL, 'src=b'), (3, 'webhook', 'wf_c', 'error', 'body', 'src=c'),
        (4, 'schedule', 'wf_d', NULL, NULL, NULL)) x(trigger_id, type, workflow, path, input_from, static)),
idx AS (SELECT trim(path, '/') AS pk, max(trigger_id) AS tid FROM t WHERE type = 'webhook' GROUP BY 1),
ix AS (SELECT idx.pk, t.* FROM idx JOIN t ON idx.tid = t.trigger_id),
h AS (SELECT event_id AS hook_id, event_type, props, trim(concat('/', event_type, '/'), '/') AS pk FROM events)
"""


def _hooks(spark, sf):
    e = table(spark, sf, "events")
    hooks = e.select(F.col("event_id").alias("hook_id"),
                     F.concat(F.lit("/"), F.col("event_type"), F.lit("/")).alias("hook_path"),
                     F.col("props").alias("body"))
    triggers = spark.createDataFrame(TRIGGERS, TRIGGER_SCHEMA)
    return J.route_webhooks(hooks, triggers)


@register("route_webhooks", WEBHOOK_SQL + """
SELECT h.hook_id, ix.trigger_id, ix.workflow,
    CASE WHEN ix.input_from = 'body' AND json_type(h.props) = 'OBJECT'
         THEN concat('k=', regexp_extract(h.props, '([0-9]+)', 1), ',', ix.static)
         ELSE ix.static END AS input_text
FROM h JOIN ix ON h.pk = ix.pk""", "J8")
def q_route_webhooks(spark, sf):
    routed, _ = _hooks(spark, sf)
    txt = F.array_join(F.array_sort(F.transform(F.map_entries("run_input"),
                                                lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return routed.select("hook_id", "trigger_id", "workflow", txt.alias("input_text"))


@register("route_webhooks_unmatched", WEBHOOK_SQL + """
SELECT h.hook_id, concat('/', h.event_type, '/') AS hook_path FROM h WHERE h.pk NOT IN (SELECT pk FROM ix)""", "J8")
def q_route_webhooks_unmatched(spark, sf):
    _, unmatched = _hooks(spark, sf)
    return unmatched.select("hook_id", "hook_path")


@register("same_attribute_edges", """
WITH e AS (SELECT l_suppkey AS src, o_custkey AS dst, min(l_orderkey * 10 + l_linenumber) AS edge_order
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey, o_custkey),
j AS (SELECT e.*, s.s_nationkey AS attr FROM e JOIN supplier s ON e.src = s.s_suppkey
    JOIN customer c ON e.dst = c.c_custkey WHERE s.s_nationkey = c.c_nationkey)
SELECT dst, src, edge_order, attr FROM (
    SELECT *, row_number() OVER (PARTITION BY dst ORDER BY edge_order, src) AS r FROM j) x WHERE r = 1""",
          "J9")
def q_same_attribute_edges(spark, sf):
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders")
    e = li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy(
        F.col("l_suppkey").alias("src"), F.col("o_custkey").alias("dst")).agg(
        F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_order"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("attr"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("attr"))
    return J.same_attribute_edges(e, s, c)


@register("answer_asof", with_views("""
WITH c AS (SELECT thread_id, event_id AS command_id, ts, concat('yes-', CAST(event_id AS VARCHAR)) AS answer,
        CASE WHEN event_id % 2 = 0 THEN 5 END AS upd FROM run_log WHERE type = 'node_retrying'),
k AS (SELECT thread_id, saved_at, ckpt_id, pending_node, step_tokens FROM checkpoints)
SELECT c.thread_id, c.command_id, k.ckpt_id, k.pending_node,
    CASE WHEN k.pending_node IS NOT NULL THEN c.answer END AS answer_to_node,
    k.ckpt_id IS NOT NULL AND k.pending_node IS NULL AS unused,
    CAST(k.step_tokens + coalesce(c.upd, 0) AS BIGINT) AS state_after
FROM c ASOF LEFT JOIN k ON c.thread_id = k.thread_id AND c.ts >= k.saved_at""", "checkpoints"), "J10")
def q_answer_asof(spark, sf):
    log = fx.run_log(spark, sf)
    cmds = log.where(F.col("type") == "node_retrying").select(
        "thread_id", "ts", F.col("event_id").alias("command_id"),
        F.concat(F.lit("yes-"), F.col("event_id").cast("string")).alias("answer"),
        F.when(F.col("event_id") % 2 == 0, F.lit(5)).cast("long").alias("update"))
    ck = fx.checkpoints(log).select("thread_id", "saved_at", "ckpt_id", "pending_node",
                                    F.col("step_tokens").alias("state_value"))
    return J.answer_asof(cmds, ck).withColumn("state_after", F.col("state_after").cast("long"))


@register("dedup_first", """
SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text""", "U1")
def q_dedup_first(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return U.dedup_first(d, ["text"], "doc_id").select("doc_id", "copies")


IMPLIED_SQL = """
WITH implied AS (SELECT id AS src, id + 1 AS dst, 'goto' AS kind FROM nodes_g WHERE id % 10 = 0
    UNION ALL SELECT id, id * 7, 'goto' FROM nodes_g WHERE id % 4 = 0)
SELECT DISTINCT i.src, i.dst, i.kind FROM implied i
WHERE NOT EXISTS (SELECT 1 FROM edges_g e WHERE e.src = i.src AND e.dst = i.dst)"""


@register("implicit_edges", with_views(IMPLIED_SQL, "nodes_g", "edges_g"), "U2")
def q_implicit_edges(spark, sf):
    n = fx.nodes_g(spark, sf)
    implied = n.where(F.col("id") % 10 == 0).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"),
                                                     F.lit("goto").alias("kind")) \
        .unionByName(n.where(F.col("id") % 4 == 0).select(F.col("id").alias("src"),
                                                          (F.col("id") * 7).alias("dst"),
                                                          F.lit("goto").alias("kind")))
    return U.implicit_edges(implied, fx.edges_g(spark, sf))


@register("set_gap", """
SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""", "U3")
def q_set_gap(spark, sf):
    want = table(spark, sf, "customer").select("c_custkey")
    have = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return U.set_gap(want, have, "c_custkey")


@register("ref_union", """
SELECT l_partkey AS partkey FROM lineitem UNION SELECT p_partkey FROM part""", "U3")
def q_ref_union(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("partkey"))
    b = table(spark, sf, "part").select(F.col("p_partkey").alias("partkey"))
    return U.ref_union(a, b, "partkey")


@register("pick_preferred", """
SELECT s_nationkey, s_suppkey FROM (
    SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_acctbal > 0) DESC,
        (s_suppkey % 3 = 0) DESC, (s_acctbal > 5000) DESC, s_suppkey) AS r FROM supplier) x WHERE r = 1""", "K2")
def q_pick_preferred(spark, sf):
    s = table(spark, sf, "supplier")
    best = U.pick_preferred(s, "s_nationkey", [F.col("s_suppkey") % 3 == 0, F.col("s_acctbal") > 5000],
                            F.col("s_acctbal") > 0, "s_suppkey")
    return best.select("s_nationkey", "s_suppkey")


@register("preferred_order", """
SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3 <> 0, s_acctbal, s_suppkey) AS INT)
    AS place FROM supplier""", "K2")
def q_preferred_order(spark, sf):
    s = table(spark, sf, "supplier")
    return U.preferred_order(s, F.col("s_suppkey") % 3 == 0, "s_acctbal", "s_suppkey", ["s_nationkey"]) \
        .select("s_suppkey", "place")


@register("category_list", "SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL", "A19")
def q_category_list(spark, sf):
    return U.category_list(table(spark, sf, "part"), "p_brand")


@register("category_breakdown", """
WITH o AS (SELECT o_custkey, coalesce(CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END, 'other') AS cat,
        o_orderstatus = 'O' AND trim(CASE WHEN o_orderkey % 5 = 0 THEN '  '
            ELSE concat('Re order ', CAST(o_orderkey AS VARCHAR)) END) <> '' AS draft FROM orders),
c AS (SELECT o_custkey, cat, count(*) AS n, sum(CASE WHEN draft THEN 1 ELSE 0 END) AS drafts FROM o GROUP BY 1, 2)
SELECT o_custkey, string_agg(concat(CAST(n AS VARCHAR), ' ', cat), ', ' ORDER BY cat) AS breakdown,
    CAST(sum(n) AS BIGINT) AS items, CAST(sum(drafts) AS BIGINT) AS draft_count FROM c GROUP BY o_custkey""", "A14")
def q_category_breakdown(spark, sf):
    o = table(spark, sf, "orders")
    cat = F.when(F.col("o_orderkey") % 13 == 0, F.lit(None)).otherwise(F.col("o_orderpriority"))
    draft = F.when(F.col("o_orderkey") % 5 == 0, F.lit("  ")).otherwise(
        F.concat(F.lit("Re order "), F.col("o_orderkey").cast("string")))
    return U.category_breakdown(o, "o_custkey", cat, F.col("o_orderstatus"), F.col("o_orderstatus") == "O", draft)


FIRST_VALID_SQL = """
WITH b AS (SELECT item, variant, attempt, response,
    CASE WHEN regexp_matches(response, '(?s)```(?:json)?\\s*(.*?)```')
         THEN regexp_extract(response, '(?s)```(?:json)?\\s*(.*?)```', 1) ELSE response END AS body FROM candidates),
s AS (SELECT *, instr(body, '{') AS st, length(body) - instr(reverse(body), '}') + 1 AS la,
    instr(body, '}') > 0 AS has_end FROM b),
f AS (SELECT *, st > 0 AND has_end AND la > st AS found FROM s),
g AS (SELECT *, CASE WHEN found THEN substr(body, st, la - st + 1) END AS span FROM f),
v AS (SELECT item, variant, attempt, found AND json_valid(span) AS ok,
    CASE WHEN NOT found THEN 'no JSON object found in response' WHEN NOT json_valid(span) THEN 'invalid JSON' END AS err,
    row_number() OVER (PARTITION BY item, variant ORDER BY attempt) AS try FROM g),
w AS (SELECT * FROM v WHERE try <= 3)
SELECT item, variant, CASE WHEN min(CASE WHEN ok THEN try END) IS NOT NULL THEN 'ok' ELSE 'failed' END AS status,
    CAST(coalesce(min(CASE WHEN ok THEN try END), max(try)) AS BIGINT) AS attempts,
    CASE WHEN min(CASE WHEN ok THEN try END) IS NULL THEN arg_max(err, try) END AS error
FROM w GROUP BY item, variant"""


@register("first_valid_attempt", with_views(FIRST_VALID_SQL, "candidates"), "A16")
def q_first_valid_attempt(spark, sf):
    c = S.with_extracted_json(fx.candidates(spark, sf), "response", "x")
    c = c.select("item", "variant", "attempt", F.col("x.json").isNotNull().alias("ok"), F.col("x.error").alias("err"))
    return U.first_valid_attempt(c, ["item", "variant"], "attempt", "ok", "err", reasks=2)


@register("concat_chunks", """
WITH c AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text,
    sum(CASE WHEN conv_id % 2 = 0 THEN length(text) // 3 END) AS rep FROM conversations GROUP BY conv_id)
SELECT conv_id, CAST(length(text) AS INT) AS chars, sha256(text) AS text_sha,
    CAST(CASE WHEN coalesce(rep, 0) > 0 THEN rep ELSE greatest(1, length(text) // 4) END AS BIGINT) AS tokens
FROM c""", "A17")
def q_concat_chunks(spark, sf):
    c = table(spark, sf, "conversations")
    rep = F.when(F.col("conv_id") % 2 == 0, F.floor(F.length("text") / 3)).cast("long")
    out = U.concat_chunks(c, "conv_id", "turn", "text", rep)
    return out.select("conv_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_sha"), "tokens")


@register("coalesce_turns", """
WITH r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos
    FROM conversations WHERE role <> 'system'),
p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY pos) AS prev_role FROM r),
s AS (SELECT *, CASE WHEN role = 'assistant' AND prev_role = 'assistant' THEN 0 ELSE 1 END AS st FROM p),
i AS (SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    AS island FROM s)
SELECT conv_id, CAST(island AS BIGINT) AS island, min(role) AS role, min(turn) AS first_turn,
    count(*) AS merged, CAST(length(string_agg(text, chr(10) ORDER BY pos)) AS INT) AS chars
FROM i GROUP BY conv_id, island""", "W11")
def q_coalesce_turns(spark, sf):
    turns, _ = U.coalesce_turns(table(spark, sf, "conversations"))
    return turns.select("conv_id", F.col("island").cast("long").alias("island"), "role", "first_turn",
                        "merged", F.length("text").alias("chars"))


@register("coalesce_turns_system", """
SELECT conv_id, CAST(length(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS INT) AS chars
FROM conversations WHERE role = 'system' GROUP BY conv_id""", "W11")
def q_coalesce_turns_system(spark, sf):
    _, system = U.coalesce_turns(table(spark, sf, "conversations"))
    return system.select("conv_id", F.length("system").alias("chars"))


@register("upsert_keep_last", """
WITH u AS (SELECT o_orderkey, o_orderstatus, 1 AS version FROM orders
    UNION ALL SELECT o_orderkey, 'U', 2 FROM orders WHERE o_orderkey % 4 = 0
    UNION ALL SELECT o_orderkey + 1000000000, 'N', 2 FROM orders WHERE o_orderkey % 50 = 0)
SELECT o_orderkey, arg_max(o_orderstatus, version) AS o_orderstatus, max(version) AS version FROM u GROUP BY o_orderkey""",
          "S4")
def q_upsert_keep_last(spark, sf):
    o = table(spark, sf, "orders")
    base = o.select("o_orderkey", "o_orderstatus", F.lit(1).alias("version"))
    delta = o.where(F.col("o_orderkey") % 4 == 0).select("o_orderkey", F.lit("U").alias("o_orderstatus"),
                                                         F.lit(2).alias("version")) \
        .unionByName(o.where(F.col("o_orderkey") % 50 == 0).select(
            (F.col("o_orderkey") + 1000000000).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"),
            F.lit(2).alias("version")))
    return K.upsert_keep_last(base, delta, ["o_orderkey"], "version")


def _outbox(spark, sf, channel):
    c = table(spark, sf, "customer")
    fields = {"message": F.when(F.col("c_custkey") % 9 == 0, F.lit("")).otherwise(
                  F.concat(F.lit("New customer "), F.col("c_name"))),
              "chat_id": F.col("c_custkey").cast("string"),
              "to": F.concat(F.lower(F.col("c_mktsegment")), F.lit("@example.com")),
              "from_email": F.lit("ops@example.com"), "subject": F.concat(F.lit("Welcome "), F.col("c_name")),
              "body": F.concat(F.lit("Segment "), F.col("c_mktsegment")), "title": F.col("c_name"),
              "comment": F.concat(F.lit("Seen "), F.col("c_name"))}
    return K.outbox_payloads(c, channel, fields).select("c_custkey", "channel", "payload")


OUTBOX_SQL = """
SELECT c_custkey, '{ch}' AS channel, CAST({payload} AS VARCHAR) AS payload FROM customer"""


@register("outbox_slack", OUTBOX_SQL.format(ch="slack", payload="""json_object('text',
    CASE WHEN c_custkey % 9 = 0 THEN '' ELSE concat('New customer ', c_name) END)"""), "S6")
def q_outbox_slack(spark, sf):
    return _outbox(spark, sf, "slack")


@register("outbox_telegram", OUTBOX_SQL.format(ch="telegram", payload="""json_object('chat_id',
    CAST(c_custkey AS VARCHAR), 'text', CASE WHEN c_custkey % 9 = 0 THEN '' ELSE concat('New customer ', c_name) END)"""),
          "S6")
def q_outbox_telegram(spark, sf):
    return _outbox(spark, sf, "telegram")


@register("outbox_sendgrid", OUTBOX_SQL.format(ch="sendgrid", payload="""json_object(
    'personalizations', json_array(json_object('to', json_array(json_object('email',
        concat(lower(c_mktsegment), '@example.com'))))),
    'from', json_object('email', 'ops@example.com'), 'subject', concat('Welcome ', c_name),
    'content', json_array(json_object('type', 'text/plain', 'value', concat('Segment ', c_mktsegment))))"""), "S6")
def q_outbox_sendgrid(spark, sf):
    return _outbox(spark, sf, "sendgrid")


@register("outbox_gitlab_issue", OUTBOX_SQL.format(ch="gitlab_issue", payload="""json_object('title', c_name,
    'description', concat('Segment ', c_mktsegment))"""), "S6")
def q_outbox_gitlab_issue(spark, sf):
    return _outbox(spark, sf, "gitlab_issue")


@register("outbox_discord", OUTBOX_SQL.format(ch="discord", payload="""json_object('content',
    CASE WHEN c_custkey % 9 = 0 THEN '' ELSE concat('New customer ', c_name) END)"""), "S6")
def q_outbox_discord(spark, sf):
    return _outbox(spark, sf, "discord")


@register("outbox_github_issue", OUTBOX_SQL.format(ch="github_issue", payload="""json_object('title', c_name,
    'body', concat('Segment ', c_mktsegment))"""), "S6")
def q_outbox_github_issue(spark, sf):
    return _outbox(spark, sf, "github_issue")


@register("outbox_github_comment", OUTBOX_SQL.format(ch="github_comment", payload="""json_object('body',
    concat('Seen ', c_name))"""), "S6")
def q_outbox_github_comment(spark, sf):
    return _outbox(spark, sf, "github_comment")


@register("outbox_webhook", """
SELECT c_custkey, 'webhook' AS channel, CASE WHEN c_custkey % 9 = 0 THEN NULL
    ELSE CAST(json_object('text', concat('New customer ', c_name)) AS VARCHAR) END AS payload FROM customer""", "S6")
def q_outbox_webhook(spark, sf):
    return _outbox(spark, sf, "webhook")


@register("append_events", with_views("""
SELECT run_id, seq, event_id, CAST(ts AS DATE) AS event_date FROM run_log""", "run_log"), "S3")
def q_append_events(spark, sf):
    log = fx.run_log(spark, sf).select("run_id", "seq", "event_id", "ts")
    path = K.scratch_path(spark, "events")
    K.append_events(log.where(F.col("seq") % 2 == 1), path)
    K.append_events(log.where(F.col("seq") % 2 == 0), path)
    return spark.read.parquet(path).select("run_id", "seq", "event_id", "event_date")


JSONL_BAD_EVERY = 50


def _event_lines(spark, sf):
    log = fx.run_log(spark, sf)
    good = F.to_json(F.struct(
        "seq", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "run_id", "thread_id", "step",
        "type", "node_id", F.to_json(F.struct("tokens", "attempts")).alias("data")))
    line = F.when(F.col("event_id") % JSONL_BAD_EVERY == 0,
                  F.concat(F.lit("not json {"), F.col("event_id").cast("string"))).otherwise(good)
    lines = log.select(line.alias("value")).unionByName(
        log.where(F.col("event_id") % 77 == 0).select(F.lit("").alias("value")))
    path = K.scratch_path(spark, "jsonl")
    lines.write.text(path)
    return K.read_run_events(spark, path)


@register("read_run_events", with_views(f"""
SELECT run_id, seq, type, ts FROM run_log WHERE event_id % {JSONL_BAD_EVERY} <> 0""", "run_log"), "S1")
def q_read_run_events(spark, sf):
    good, _ = _event_lines(spark, sf)
    return good.select("run_id", "seq", "type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@register("read_run_events_quarantine", f"""
SELECT concat('not json {{', CAST(event_id AS VARCHAR)) AS raw FROM events WHERE event_id % {JSONL_BAD_EVERY} = 0""", "S1")
def q_read_run_events_quarantine(spark, sf):
    _, bad = _event_lines(spark, sf)
    return bad


PARQUET_TYPE_SQL = "CASE event_id % 20 WHEN 0 THEN NULL WHEN 1 THEN 'no such type' ELSE type END"


def _event_parquet(spark, sf):
    """The log with some rows that lack a type or have an unknown one, as a parquet source."""
    log = fx.run_log(spark, sf).withColumn("type", F.when(F.col("event_id") % 20 == 1, F.lit("no such type"))
                                           .when(F.col("event_id") % 20 != 0, F.col("type")))
    path = K.scratch_path(spark, "event-parquet")
    log.write.parquet(path)
    return K.read_run_events(spark, path, "parquet")


@register("read_run_events_parquet", with_views(f"""
SELECT run_id, seq, event_id, {PARQUET_TYPE_SQL} AS type, event_id % 20 > 1 AS good FROM run_log""", "run_log"), "S1")
def q_read_run_events_parquet(spark, sf):
    good, bad = _event_parquet(spark, sf)
    return good.select("run_id", "seq", "event_id", "type", F.lit(True).alias("good")).unionByName(
        bad.select("run_id", "seq", "event_id", "type", F.lit(False).alias("good")))
