"""Run-log reports: per node, per run, fleet totals, run listing.

All reports are algebraic aggregates (sum / count / max_by), so Spark
combines them map-side before the shuffle on ``run_id``: a hot run costs one
partial row per map task, never a hot reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terminal event types and the status each one gives.
TERMINAL_STATUS = {"run_finished": "finished", "run_failed": "failed",
                   "run_interrupted": "interrupted", "run_cancelled": "cancelled"}


def _terminal_status(type_col: Column) -> Column:
    expr = None
    for t, s in TERMINAL_STATUS.items():
        expr = (F.when(type_col == t, s) if expr is None else expr.when(type_col == t, s))
    return expr


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def _sum_if(cond: Column, value: Column) -> Column:
    return F.sum(F.when(cond, value).otherwise(0)).cast("long")


def node_metrics(events: DataFrame) -> DataFrame:
    """A1: per run and node.  Interrupts and run-level events do not create node rows; no
    attempts, or 0 of them, count as one."""
    t = F.col("type")
    fin = t == "node_finished"
    rows = events.where(F.col("node_id").isNotNull() & (t != "interrupt_raised")
                        & ~t.isin(*TERMINAL_STATUS) & (t != "run_started"))
    return rows.groupBy("run_id", "node_id").agg(
        _count_if(fin).alias("runs"),
        _sum_if(fin, F.col("duration_ms")).alias("latency_ms"),
        _sum_if(fin, F.when(F.col("attempts") != 0, F.col("attempts")).otherwise(1)).alias("attempts"),
        _count_if(t == "node_retrying").alias("retries"),
        _count_if(t == "node_fallback").alias("fallbacks"),
        _count_if(t == "node_failed").alias("failures"),
        _count_if(fin & F.coalesce(F.col("cached"), F.lit(False))).alias("cached"),
        _sum_if(fin, F.col("tokens")).alias("tokens"),
        _sum_if(fin, F.col("cost_micros")).alias("cost_micros"))


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def run_report(events: DataFrame) -> DataFrame:
    """A2: one row per run.

    Status is the last terminal event by ``seq`` (``running`` without one);
    a failure preceded by a ``guard_tripped`` event reports ``guard_tripped``.
    Duration is max(ts) - min(ts) in whole microseconds.  Node sums follow A1's rules.
    ``workflow`` is the graph of the last start event; ``dead_letters`` the largest number
    that a terminal event carries in ``dead_letters`` (a log without that column has none).
    """
    t = F.col("type")
    node_row = (F.col("node_id").isNotNull() & (t != "interrupt_raised")
                & ~t.isin(*TERMINAL_STATUS) & (t != "run_started"))
    fin = node_row & (t == "node_finished")
    term = F.when(t.isin(*TERMINAL_STATUS), F.struct(F.col("seq"), t.alias("type")))
    letters = F.col("dead_letters") if "dead_letters" in events.columns else F.lit(0)
    agg = events.groupBy("run_id").agg(
        F.max("thread_id").alias("thread_id"),
        F.max_by(F.coalesce("graph", F.lit("")), F.when(t == "run_started", F.col("seq"))).alias("workflow"),
        F.max_by(term, F.when(term.isNotNull(), F.col("seq"))).alias("_last_term"),
        F.min(F.when(t == "guard_tripped", F.col("seq"))).alias("_guard_seq"),
        F.coalesce(F.max("step"), F.lit(0)).alias("steps"),
        F.min(_micros(F.col("ts"))).alias("_t0"), F.max(_micros(F.col("ts"))).alias("_t1"),
        _sum_if(fin, F.col("tokens")).alias("tokens"),
        _sum_if(fin, F.col("cost_micros")).alias("cost_micros"),
        _count_if(fin).alias("nodes_run"),
        _count_if(node_row & (t == "node_retrying")).alias("retries"),
        _count_if(node_row & (t == "node_fallback")).alias("fallbacks"),
        F.coalesce(F.max(F.when(term.isNotNull(), letters)), F.lit(0)).cast("long").alias("dead_letters"),
        _count_if(t == "interrupt_raised").alias("interventions"))
    status = F.coalesce(_terminal_status(F.col("_last_term.type")), F.lit("running"))
    status = F.when((status == "failed") & (F.col("_guard_seq") < F.col("_last_term.seq")),
                    "guard_tripped").otherwise(status)
    return agg.select(
        "run_id", "thread_id", F.coalesce(F.col("workflow"), F.lit("")).alias("workflow"),
        status.alias("status"), "steps",
        (F.col("_t1") - F.col("_t0")).alias("duration_us"),
        "tokens", "cost_micros", "nodes_run", "retries", "fallbacks", "dead_letters",
        "interventions")


def checkpoint_metrics(ckpts: DataFrame) -> DataFrame:
    """Cumulative metrics of the newest checkpoint per run (what a resume would see).

    ``ckpts`` carries running totals (total_tokens, total_cost_micros, total_nodes_run);
    the row with the largest ``ckpt_id`` counts, whatever was lost before it."""
    last = ckpts.groupBy("run_id").agg(F.max_by(F.struct(
        "step", "total_tokens", "total_cost_micros", "total_nodes_run"), "ckpt_id").alias("c"))
    return last.select("run_id", F.col("c.step").alias("ckpt_step"), F.col("c.total_tokens").alias("ckpt_tokens"),
                       F.col("c.total_cost_micros").alias("ckpt_cost_micros"),
                       F.col("c.total_nodes_run").alias("ckpt_nodes_run"))


def metrics_override(report: DataFrame, ckpt_metrics: DataFrame) -> DataFrame:
    """Checkpoint totals replace the event sums as a whole when a checkpoint exists.

    One row per run on both sides: a shuffle join on run_id with no fan-out.
    """
    j = report.join(ckpt_metrics, "run_id", "left")
    has = F.col("ckpt_step").isNotNull()
    cols = []
    for c in report.columns:
        if c in ("tokens", "cost_micros", "nodes_run"):
            cols.append(F.when(has, F.col(f"ckpt_{c}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def fleet_aggregate(reports: DataFrame) -> DataFrame:
    """A3: one row; an empty input gives zeros (global aggregate, no grouping key)."""
    st = F.col("status")
    return reports.agg(
        F.count(F.lit(1)).alias("runs"),
        _count_if(st == "finished").alias("passed"),
        _count_if(st.isin("failed", "guard_tripped")).alias("failed"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total_tokens"),
        F.coalesce(F.sum("cost_micros"), F.lit(0)).cast("long").alias("total_cost_micros"),
        F.coalesce(F.avg("duration_us") / 1e6, F.lit(0.0)).alias("avg_duration_s"))


def list_runs(events: DataFrame) -> DataFrame:
    """A4: listing row per run; status from the very last event (not the last terminal one)."""
    t = F.col("type")
    agg = events.groupBy("run_id").agg(
        F.max("thread_id").alias("thread_id"),
        F.min("ts").alias("started"), F.max("ts").alias("ended"),
        F.coalesce(F.max("step"), F.lit(0)).alias("steps"),
        F.max(F.when(t == "run_started", F.col("graph"))).alias("workflow"),
        F.max_by(t, F.col("event_id")).alias("_last_type"),
        F.min("event_id").alias("first_id"))
    return agg.select(
        "run_id", "thread_id", F.coalesce(F.col("workflow"), F.lit("?")).alias("workflow"),
        F.coalesce(_terminal_status(F.col("_last_type")), F.lit("running")).alias("status"),
        "steps", "started", "ended", "first_id")


def recent_runs(events: DataFrame, limit: int = 50, workflow: str | None = None) -> DataFrame:
    """K1: newest runs by first event id; the workflow filter applies before the limit.

    ``orderBy().limit()`` plans as TakeOrderedAndProject: each task keeps its
    own top ``limit`` and only those reach the final merge.
    """
    runs = list_runs(events)
    if workflow is not None:
        runs = runs.where(F.col("workflow") == workflow)
    return runs.orderBy(F.col("first_id").desc()).limit(max(1, limit))


def dead_letters(events: DataFrame) -> DataFrame:
    """One dead-letter row per failed node event, with the error and its type as the log recorded them; a failure
    without one is an unknown error of the configuration."""
    return events.where(F.col("type") == "node_failed").select(
        "run_id", "thread_id", "node_id", "step", "seq", F.coalesce("attempts", F.lit(0)).alias("attempts"),
        F.coalesce("error", F.lit("unknown error")).alias("error"),
        F.coalesce("error_type", F.lit("ConfigError")).alias("error_type"))


def dead_letter_counts(events: DataFrame) -> DataFrame:
    return events.where(F.col("type") == "node_failed").groupBy("run_id").agg(F.count(F.lit(1)).alias("dead_letters"))
