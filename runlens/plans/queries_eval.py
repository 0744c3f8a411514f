"""Registered queries: evaluation of recorded runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import reports as R
from ..session import cut_lineage
from ..sources import fixtures as fx
from .fixture_sql import with_views
from .queries_reports import RUN_REPORT_BODY
from .registry import register

# Assertions every case carries in the registered eval query; the last three fail: a name that is neither a
# channel nor a node, a field that the node does not give, and a text that does not parse.
ASSERTS = ["c0 >= 100 or not c1", "len(c2) >= 2 and c2[0] > 50", "n3.tokens >= 200 and n3.attempts < 3",
           "c1 // 100 % 2 == 0", "nosuch > 1", "n3.color == 'red'", "c0 >= "]


def _log(spark, sf):
    """The event log, written once: cases, reports, state and outputs all read it."""
    return cut_lineage(fx.run_log(spark, sf))


def _reports(log):
    rep = R.run_report(log)
    return rep.select(F.col("run_id").alias("name"), "*").drop("run_id").withColumn(
        "cost_usd", F.col("cost_micros") / 1e6)


def _cases(log):
    c = fx.cases(log).withColumn("asserts", F.array(*[F.lit(a) for a in ASSERTS]))
    return E.load_cases(c)


def final_state(log):
    """(name, key, value): channels c0 (last), c1 (sum) and c2 (append) of every run as JSON texts."""
    w = fx.writes(log)
    agg = w.groupBy("run_id").agg(
        F.max_by("value", F.when(F.col("channel") == "c0", F.col("seq"))).alias("c0"),
        F.coalesce(F.sum(F.when(F.col("channel") == "c1", F.col("value"))), F.lit(0)).alias("c1"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("channel") == "c2", F.struct("seq", "value")))),
                    lambda x: x["value"]).alias("c2"))
    return agg.select(F.col("run_id").alias("name"), F.explode(F.create_map(
        F.lit("c0"), F.coalesce(F.col("c0").cast("string"), F.lit("0")), F.lit("c1"), F.col("c1").cast("string"),
        F.lit("c2"), F.to_json("c2"))).alias("key", "value"))


def node_outputs(log):
    """(name, key, value): the last output of every finished node as a JSON text."""
    out = E.last_node_output(log.withColumn("o", F.struct("tokens", "attempts")), "o")
    return out.select(F.col("run_id").alias("name"), F.col("node_id").alias("key"), F.to_json("output").alias("value"))


@register("load_cases", with_views("""
SELECT name, coalesce(expect_status, 'finished') AS status, true AS no_dead_letters,
    7 AS n_asserts, CAST(token_budget AS DOUBLE) AS budget_tokens FROM cases""", "cases"), "S5")
def q_load_cases(spark, sf):
    c = _cases(fx.run_log(spark, sf))
    return c.select("name", "status", "no_dead_letters", F.size("asserts").alias("n_asserts"),
                    F.col("budget")["tokens"].alias("budget_tokens"))


EVAL_BODY = RUN_REPORT_BODY + """,
cl AS (SELECT name, coalesce(expect_status, 'finished') AS status_expected, token_budget FROM cases),
st AS (SELECT run_id, coalesce(arg_max(value, seq) FILTER (channel = 'c0'), 0) AS c0,
        coalesce(sum(value) FILTER (channel = 'c1'), 0) AS c1, list(value ORDER BY seq) FILTER (channel = 'c2') AS c2
    FROM writes GROUP BY run_id),
n3 AS (SELECT run_id, arg_max(tokens, seq) AS n3_tokens, arg_max(attempts, seq) AS n3_attempts
    FROM run_log WHERE type = 'node_finished' AND node_id = 'n3' GROUP BY run_id),
j AS (SELECT cl.*, r.status, r.dead_letters, r.tokens, st.run_id IS NOT NULL AS has, st.c0, st.c1, st.c2, n3_tokens, n3_attempts,
        n3.run_id IS NOT NULL AS has3
    FROM cl LEFT JOIN run_report r ON cl.name = r.run_id LEFT JOIN st ON cl.name = st.run_id LEFT JOIN n3 ON cl.name = n3.run_id),
checks AS (
  SELECT name, 0 AS check_no, 'status' AS kind, concat('status == ', status_expected) AS detail,
         coalesce(status = status_expected, false) AS ok FROM j
  UNION ALL SELECT name, 1, 'dead_letters', 'no dead-letters', coalesce(dead_letters = 0, false) FROM j
  UNION ALL SELECT name, 2, 'assert', concat('c0 >= 100 or not c1', CASE WHEN NOT has THEN $$  (unknown name 'c0')$$ ELSE '' END),
         has AND (c0 >= 100 OR c1 = 0) FROM j
  UNION ALL SELECT name, 3, 'assert', concat('len(c2) >= 2 and c2[0] > 50', CASE WHEN NOT has THEN $$  (unknown name 'c2')$$ ELSE '' END),
         has AND coalesce(len(c2), 0) >= 2 AND c2[1] > 50 FROM j
  UNION ALL SELECT name, 4, 'assert', concat('n3.tokens >= 200 and n3.attempts < 3',
         CASE WHEN NOT has3 THEN $$  (unknown name 'n3')$$ ELSE '' END), has3 AND n3_tokens >= 200 AND n3_attempts < 3 FROM j
  UNION ALL SELECT name, 5, 'assert', concat('c1 // 100 % 2 == 0', CASE WHEN NOT has THEN $$  (unknown name 'c1')$$ ELSE '' END),
         has AND coalesce(c1, 0) // 100 % 2 = 0 FROM j
  UNION ALL SELECT name, 6, 'assert', $$nosuch > 1  (unknown name 'nosuch')$$, false FROM j
  UNION ALL SELECT name, 7, 'assert', concat($$n3.color == 'red'  ($$,
         CASE WHEN has3 THEN $$cannot resolve '.color'$$ ELSE $$unknown name 'n3'$$ END, ')'), false FROM j
  UNION ALL SELECT name, 8, 'assert', $$c0 >=   (invalid expression: 'c0 >= ')$$, false FROM j
  UNION ALL SELECT name, 9, 'budget', concat('tokens ', CAST(tokens AS VARCHAR), ' <= ', CAST(token_budget AS VARCHAR)),
         coalesce(tokens <= token_budget, false) FROM j WHERE token_budget IS NOT NULL)
"""


@register("eval_cases", with_views("WITH " + EVAL_BODY + "SELECT * FROM checks", "run_log", "cases", "writes"), "A6")
def q_eval_cases(spark, sf):
    log = _log(spark, sf)
    return E.eval_cases(_cases(log), _reports(log), final_state(log), node_outputs(log)).withColumn("check_no", F.col("check_no").cast("int"))


@register("eval_summary", with_views("WITH " + EVAL_BODY + """,
per AS (SELECT name, bool_and(ok) AS passed FROM checks GROUP BY name)
SELECT CAST(sum(CASE WHEN p.passed THEN 1 ELSE 0 END) AS BIGINT) AS passed,
    CAST(sum(CASE WHEN p.passed THEN 0 ELSE 1 END) AS BIGINT) AS failed,
    CAST(sum(r.tokens) AS BIGINT) AS total_tokens, sum(r.cost_micros) / 1e6 AS total_cost_usd
FROM per p JOIN run_report r ON p.name = r.run_id""", "run_log", "cases", "writes"), "A5")
def q_eval_summary(spark, sf):
    log = _log(spark, sf)
    cases, reports = _cases(log), _reports(log)
    checks = E.eval_cases(cases, reports, final_state(log), node_outputs(log))
    return E.eval_summary(E.case_results(checks, reports, cases))


COMPARE_SQL = with_views("WITH " + RUN_REPORT_BODY + """,
side AS (SELECT concat('u', CAST(CAST(substr(thread_id, 2) AS BIGINT) // 2 AS VARCHAR), '-',
                       split_part(run_id, '-', 2)) AS name,
                CAST(substr(thread_id, 2) AS BIGINT) % 2 AS v,
                status = 'finished' AND dead_letters = 0 AS passed, status, tokens FROM run_report)
SELECT a.name, a.passed AS a_passed, a.status AS a_status, a.tokens AS a_tokens,
       b.passed AS b_passed, b.status AS b_status, b.tokens AS b_tokens,
       b.tokens - a.tokens AS token_delta,
       (a.passed <> b.passed) OR (a.status <> b.status) AS outcome_changed
FROM side a JOIN side b ON a.name = b.name AND a.v = 0 AND b.v = 1""", "run_log")


@register("compare_runs", COMPARE_SQL, "J1")
def q_compare_runs(spark, sf):
    rep = R.run_report(fx.run_log(spark, sf))
    user = F.substring("thread_id", 2, 1 << 20).cast("long")
    side = rep.select(
        F.concat(F.lit("u"), F.floor(user / 2).cast("string"), F.lit("-"),
                 F.split_part("run_id", F.lit("-"), F.lit(2))).alias("name"),
        (user % 2).alias("v"),
        ((F.col("status") == "finished") & (F.col("dead_letters") == 0)).alias("passed"),
        "status", "tokens")
    return E.compare_runs(side.where("v = 0"), side.where("v = 1"))


@register("last_node_output", with_views("""
SELECT run_id, node_id, arg_max(tokens, seq) AS output, max(seq) AS seq
FROM run_log WHERE type = 'node_finished' GROUP BY run_id, node_id""", "run_log"), "W8")
def q_last_node_output(spark, sf):
    return E.last_node_output(fx.run_log(spark, sf))
