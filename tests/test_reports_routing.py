"""Report, routing and rule semantics on small hand-made logs (reference-style cases)."""

from pyspark.sql import functions as F

from runlens.functions import scalars as S
from runlens.operators import guards as W
from runlens.operators import joins as J
from runlens.operators import reports as R
from runlens.operators.judging import verdict

LOG_SCHEMA = ("run_id string, thread_id string, seq long, step int, ts timestamp_ntz, type string, node_id string, "
              "graph string, duration_ms long, tokens long, cost_micros long, attempts int, cached boolean, "
              "event_id long")


def _log(spark, rows):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    full = [(r[0], "t", r[1], r[1] // 2, base + dt.timedelta(seconds=r[1]), r[2], r[3], r[4] if len(r) > 4 else None,
             10, 5, 2, 1, False, r[1]) for r in rows]
    return spark.createDataFrame(full, LOG_SCHEMA)


def test_status_rules_last_terminal_vs_last_event(spark):
    log = _log(spark, [("r1", 1, "run_started", None, "wf1"), ("r1", 2, "node_finished", "a"),
                       ("r1", 3, "run_interrupted", None), ("r1", 4, "node_finished", "b"),
                       ("r2", 1, "run_started", None, "wf2"), ("r2", 2, "guard_tripped", None),
                       ("r2", 3, "run_failed", None)])
    rep = {r.run_id: r.status for r in R.run_report(log).collect()}
    assert rep == {"r1": "interrupted", "r2": "guard_tripped"}
    lst = {r.run_id: (r.status, r.workflow) for r in R.list_runs(log).collect()}
    assert lst == {"r1": ("running", "wf1"), "r2": ("failed", "wf2")}  # the very last event decides here


def test_recent_runs_filters_before_limit(spark):
    rows = []
    for i in range(30):
        rows.append((f"r{i:02d}", i * 10 + 1, "run_started", None, "wfA" if i % 3 == 0 else "wfB"))
    got = [r.run_id for r in R.recent_runs(_log(spark, rows), limit=4, workflow="wfA").collect()]
    assert got == ["r27", "r24", "r21", "r18"]


def test_node_status_queued_never_replaces_running(spark):
    ev = spark.createDataFrame([("r", "a", 1, "node_started", False, False), ("r", "a", 2, "superstep_started", False, False),
                                ("r", "b", 1, "node_finished", True, False), ("r", "b", 3, "superstep_started", False, False),
                                ("r", "c", 1, "node_finished", False, True)],
                               "run_id string, node_id string, seq long, type string, cached boolean, degraded boolean")
    got = {r.node_id: r.status for r in W.node_status(ev).collect()}
    assert got == {"a": "running", "b": "queued", "c": "degraded"}


def test_route_webhooks_last_wins_and_body_override(spark):
    hooks = spark.createDataFrame([(1, "/a/", '{"x": "1"}'), (2, "b", "not json"), (3, "/zzz", "{}")],
                                  "hook_id long, hook_path string, body string")
    trig = spark.createDataFrame([(1, "webhook", "w1", "a", "body", {"x": "0", "y": "s"}),
                                  (2, "webhook", "w2", "/a", "body", {"y": "t"}),
                                  (3, "webhook", "w3", "b", "body", {"y": "u"})],
                                 "trigger_id int, type string, workflow string, path string, input_from string, "
                                 "input map<string,string>")
    routed, unmatched = J.route_webhooks(hooks, trig)
    got = {r.hook_id: (r.workflow, dict(r.run_input)) for r in routed.collect()}
    assert got == {1: ("w2", {"y": "t", "x": "1"}), 2: ("w3", {"y": "u"})}
    assert [r.hook_id for r in unmatched.collect()] == [3]


def test_verdict_rules(spark):
    df = spark.createDataFrame([("pass", 0.9), ("pass", None), ("fail", 0.95), ("maybe", 0.99)],
                               "raw string, score double")
    a = [tuple(r) for r in df.select(verdict(F.col("raw"), F.col("score"), F.lit("why"), min_score=0.7,
                                             on_pass="ok", on_fail="redo").alias("v")).select(
        "v.passed", "v.goto", "v.feedback").collect()]
    assert a == [(True, "ok", None), (False, "redo", "why"), (True, "ok", None), (False, "redo", "why")]
    b = [r.passed for r in df.select(verdict(F.col("raw"), F.col("score"), F.lit("why"), on_pass="ok")
                                     .alias("v")).select("v.passed", "v.goto").collect()]
    assert b == [True, True, False, False]


def test_typed_literal_and_classify(spark):
    df = spark.createDataFrame([("a=5",), ('b="x"',), ("c=[1]",), ("d=hello world",), ("novalue",)], "t string")
    got = [(r.key, r.type) for r in df.select(S.typed_literal("t").alias("x")).select("x.*").collect()]
    assert got == [("a", "int"), ("b", "str"), ("c", "list"), ("d", "text"), (None, None)]
    e = spark.createDataFrame([(429, None), (503, None), (404, None), (204, None), (None, "NodeTimeout"),
                               (None, "KeyError")], "status int, etype string")
    kinds = [r[0] for r in e.select(W.classify_error(F.col("status"), F.col("etype"))).collect()]
    assert kinds == ["transient", "transient", "deterministic", "ok", "transient", "deterministic"]


def test_checkpoints_of_every_run_are_used(spark):
    from runlens.operators.reports import checkpoint_metrics, metrics_override
    from runlens.sources.fixtures import cumulative_checkpoints
    log = spark.createDataFrame(
        [(f"t1-w{w}", "t1", 2 * s + 1, s, s, "node_finished", "n1", 10, 3, 100 * w + s) for w in range(5) for s in range(3)],
        "run_id string, thread_id string, seq long, step int, ts long, type string, node_id string, tokens long, "
        "cost_micros long, event_id long")
    ck = checkpoint_metrics(cumulative_checkpoints(log))
    assert sorted(r.run_id for r in ck.collect()) == [f"t1-w{w}" for w in range(5)]
    report = spark.createDataFrame([("t1-w3", 1, 1, 1), ("none", 2, 2, 2)],
                                   "run_id string, tokens long, cost_micros long, nodes_run long")
    got = {r.run_id: (r.tokens, r.cost_micros, r.nodes_run) for r in metrics_override(report, ck).collect()}
    assert got == {"t1-w3": (30, 9, 3), "none": (2, 2, 2)}
