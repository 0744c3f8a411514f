"""Guards, budgets, visits, retries and per-node status.

Running totals per run or node use the skew-safe ``ordered_scan``; "first
row that trips" is a ``min_by`` aggregate (map-side combined); top-n per key
is ``row_number() <= n`` (partial WindowGroupLimit before the shuffle).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.broadcast import bounded_broadcast
from ..plans.ordered import ordered_scan

# Guard names in the order they are checked.
GUARD_ORDER = ("max_steps", "tokens", "cost_usd", "deadline")


def _guard_rows(steps: DataFrame, used: dict[str, Column], limits: dict[str, float | None]) -> DataFrame:
    """One row per (step row, guard) with used and limit; guards with a null limit are off."""
    entries = []
    for i, g in enumerate(GUARD_ORDER):
        lim = limits.get(g)
        if lim is None:
            continue
        entries.append(F.struct(F.lit(i).alias("g_no"), F.lit(g).alias("guard"),
                                used[g].cast("double").alias("used"), F.lit(float(lim)).alias("limit")))
    if not entries:
        return steps.select("*", F.lit(None).cast(
            "struct<g_no:int,guard:string,used:double,limit:double>").alias("_g")).where("false")
    return steps.select("*", F.explode(F.array(*entries)).alias("_g"))


def step_usage(ckpts: DataFrame) -> DataFrame:
    """Per run and step: cumulative tokens and cost before and after the step, elapsed seconds.

    Running sums come from ``ordered_scan`` so a run with millions of steps
    is still spread over many tasks.
    """
    start = ckpts.groupBy("run_id").agg(F.min("saved_at").alias("_start"))
    s = ordered_scan(ckpts.select("run_id", "step", "step_tokens", "step_cost_micros", "saved_at"), ["run_id"], ["step"],
                     running={"tokens_after": "step_tokens", "cost_micros_after": "step_cost_micros"},
                     running_before={"tokens_before": "step_tokens", "cost_micros_before": "step_cost_micros"})
    s = s.join(start, "run_id")
    el = (F.unix_micros(F.col("saved_at").cast("timestamp"))
          - F.unix_micros(F.col("_start").cast("timestamp"))) / 1e6
    return s.select("run_id", "step", "tokens_before", "tokens_after",
                    "cost_micros_before", "cost_micros_after", el.alias("elapsed_s"))


def guard_trip(usage: DataFrame, max_steps: int | None = 25, tokens: float | None = None,
               cost_micros: float | None = None, deadline_s: float | None = None) -> DataFrame:
    """Per run, the first step at which a guard reaches its limit (>=), guards checked in order.

    The check before step s sees the totals of the steps before it.
    """
    used = {"max_steps": F.col("step"), "tokens": F.col("tokens_before"),
            "cost_usd": F.col("cost_micros_before"), "deadline": F.col("elapsed_s")}
    limits = {"max_steps": max_steps, "tokens": tokens, "cost_usd": cost_micros, "deadline": deadline_s}
    g = _guard_rows(usage, used, limits).where(F.col("_g.used") >= F.col("_g.limit"))
    first = g.groupBy("run_id").agg(F.min_by(F.struct("step", "_g"), F.struct("step", "_g.g_no")).alias("t"))
    return first.select("run_id", F.col("t.step").alias("step"), F.col("t._g.guard").alias("guard"),
                        F.col("t._g.used").alias("used"), F.col("t._g.limit").alias("limit_value"))


def budget_warnings(usage: DataFrame, max_steps: int | None = 25, tokens: float | None = None,
                    cost_micros: float | None = None, deadline_s: float | None = None,
                    threshold: float = 0.8) -> DataFrame:
    """After each step, every guard at >= threshold of its limit, measured at step + 1.

    A limit of 0 counts as 0 %.
    """
    used = {"max_steps": F.col("step") + 1, "tokens": F.col("tokens_after"),
            "cost_usd": F.col("cost_micros_after"), "deadline": F.col("elapsed_s")}
    limits = {"max_steps": max_steps, "tokens": tokens, "cost_usd": cost_micros, "deadline": deadline_s}
    g = _guard_rows(usage, used, limits)
    frac = F.when(F.col("_g.limit") == 0, F.lit(0.0)).otherwise(F.col("_g.used") / F.col("_g.limit"))
    return g.where(frac >= threshold).select(
        "run_id", "step", F.col("_g.guard").alias("guard"), F.col("_g.used").alias("used"),
        F.col("_g.limit").alias("limit_value"))


def visit_guard(visits: DataFrame, nodes: DataFrame, keys: Sequence[str] = ("run_id",),
                node: str = "node_id", order: str = "seq") -> DataFrame:
    """Nth visit per key and node; a visit over ``max_iterations`` goes to ``on_exhausted``,
    or is fatal without one.  Returns only the visits over the limit."""
    v = ordered_scan(visits, [*keys, node], [order], index="visit")
    lim = bounded_broadcast(nodes.select(F.col("id").alias(node), "max_iterations", "on_exhausted"))
    j = v.join(lim, node, "inner").where(
        F.col("max_iterations").isNotNull() & (F.col("visit") > F.col("max_iterations")))
    return j.select(*keys, node, order, "visit", "max_iterations",
                    F.when(F.col("on_exhausted").isNotNull(), F.concat(F.lit("exhausted->"), "on_exhausted"))
                     .otherwise(F.lit("fatal")).alias("outcome"))


def retry_schedule(failures: DataFrame, keys: Sequence[str] = ("run_id", "node_id"), order: str = "seq",
                   attempts: int = 3, base: float = 0.5, factor: float = 2.0, max_delay: float = 60.0,
                   jitter: bool = False, seed: int = 0) -> DataFrame:
    """Retry delays.  Attempt n is the nth failure of a visit of a node (``keys`` name the
    visit); a visit ends at its first deterministic error or when its attempts are used up, and
    nothing after that is retried; delay = min(base * factor^(n-1), max_delay), raised to
    ``retry_after`` when given; ``wait_s`` is the running total of the visit's delays.
    With ``jitter`` the delay is uniform in its upper half, drawn from a seeded hash.

    Only the first ``attempts`` failures of a visit can matter, so the window keeps that many
    rows per visit before the shuffle."""
    first = Window.partitionBy(*keys).orderBy(order)
    f = failures.withColumn("attempt", F.row_number().over(first).cast("long")).where(F.col("attempt") < attempts)
    ended = F.min(F.when(F.col("kind") != "transient", F.col("attempt"))).over(Window.partitionBy(*keys))
    f = f.withColumn("_end", ended).where(F.col("_end").isNull() | (F.col("attempt") < F.col("_end"))).drop("_end")
    d = F.least(F.lit(base) * F.pow(F.lit(factor), F.col("attempt") - 1), F.lit(max_delay))
    if jitter:
        u = (F.xxhash64(F.lit(seed), *[F.col(k) for k in keys], F.col("attempt")).bitwiseAND(0xFFFFFF)
             / float(1 << 24))
        d = d / 2 + u * d / 2
    d = F.when(F.col("retry_after").isNotNull(), F.greatest(d, F.col("retry_after"))).otherwise(d)
    f = f.withColumn("delay_s", d)
    upto = first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return f.withColumn("wait_s", F.sum("delay_s").over(upto))


# Event type -> display status of a node.
STATUS_OF_EVENT = {"node_started": "running", "node_failed": "failed", "interrupt_raised": "waiting"}


def node_status(events: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Final display status per node: the last status-bearing event wins, except that
    ``queued`` (superstep start) never replaces ``running``."""
    t = F.col("type")
    st = (F.when(t == "node_finished",
                 F.when(F.coalesce(F.col("degraded"), F.lit(False)), "degraded")
                  .when(F.coalesce(F.col("cached"), F.lit(False)), "cached").otherwise("ok")))
    for typ, s in STATUS_OF_EVENT.items():
        st = st.when(t == typ, s)
    e = events.where(F.col("node_id").isNotNull()).withColumn("_st", st)
    agg = e.groupBy(*keys, "node_id").agg(
        F.max_by(F.struct(F.col("seq"), F.col("_st").alias("s")),
                 F.when(F.col("_st").isNotNull(), F.col("seq"))).alias("last"),
        F.max(F.when(t == "superstep_started", F.col("seq"))).alias("_queued_seq"))
    queued = F.col("_queued_seq").isNotNull() & (
        F.col("last").isNull() | ((F.col("_queued_seq") > F.col("last.seq")) & (F.col("last.s") != "running")))
    return agg.select(*keys, "node_id", F.when(queued, "queued").otherwise(F.col("last.s")).alias("status"))


def bounded_replay(events: DataFrame, n: int = 1000, key: str = "run_id", order: str = "seq") -> DataFrame:
    """Newest ``n`` events per run, numbered in order (1 = oldest kept)."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    kept = events.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    cnt = F.least(F.count(F.lit(1)).over(Window.partitionBy(key)), F.lit(n))
    return kept.withColumn("replay_pos", (cnt - F.col("_r") + 1).cast("long")).drop("_r")


def capture_cap(lines: DataFrame, keys: Sequence[str], order: Sequence[str], length: str = "chars",
                cap: int = 256 * 1024) -> DataFrame:
    """Keep a line while the characters captured before it are under ``cap``."""
    s = ordered_scan(lines, list(keys), list(order), running_before={"captured_before": length})
    return s.where(F.col("captured_before") < cap)


def first_success(attempts: DataFrame, order: Sequence[str], item: str = "item", variant: str = "variant",
                  attempt: str = "attempt", ok: str = "ok") -> DataFrame:
    """Fallback chain.  Per item the first variant, in declared ``order``, that has a
    successful attempt; attempts are counted up to and including the first success of
    each variant tried.  No success anywhere gives the static fallback row, marked
    ``degraded``, costing one more attempt.  Attempts of variants outside ``order`` are not
    part of the chain; an item with only those gets the static row."""
    rank = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(variant))
    a = attempts.withColumn("_rank", F.when(rank > 0, rank))
    none = a.groupBy(item).agg(F.count("_rank").alias("_n")).where(F.col("_n") == 0).select(
        item, F.lit("static").alias("variant"), F.lit(True).alias("degraded"), F.lit(1).cast("long").alias("attempts"))
    a = a.where(F.col("_rank").isNotNull())
    firsts = a.groupBy(item, variant, "_rank").agg(
        F.min(F.when(F.col(ok), F.col(attempt))).alias("_first_ok"))
    a = a.join(firsts.drop("_rank"), [item, variant], "inner")
    per_var = a.groupBy(item, variant, "_rank").agg(
        F.count_if(F.col("_first_ok").isNull() | (F.col(attempt) <= F.col("_first_ok"))).alias("_used"),
        F.max(F.col("_first_ok").isNotNull()).alias("_ok"))
    # per item at most len(order) rows: a bounded window
    w = Window.partitionBy(item)
    best = F.min(F.when(F.col("_ok"), F.col("_rank"))).over(w)
    pv = per_var.withColumn("_best", best)
    res = pv.where(F.col("_best").isNull() | (F.col("_rank") <= F.col("_best"))).groupBy(item).agg(
        F.max("_best").alias("_best"), F.sum("_used").cast("long").alias("_att"),
        F.max_by(F.col(variant), F.col("_rank")).alias("_var"))
    degraded = F.col("_best").isNull()
    return res.select(item, F.when(degraded, F.lit("static")).otherwise(F.col("_var")).alias("variant"),
                      degraded.alias("degraded"),
                      F.when(degraded, F.col("_att") + 1).otherwise(F.col("_att")).alias("attempts")).unionByName(none)


def node_budget(usage: DataFrame, budgets: DataFrame, keys: Sequence[str] = ("run_id", "node_id"),
                order: str = "seq", tokens: str = "tokens") -> DataFrame:
    """Rows where a node's own cumulative tokens exceed its own budget (strict >)."""
    s = ordered_scan(usage.select(*keys, order, tokens), list(keys), [order], running={"cum_tokens": tokens})
    b = bounded_broadcast(budgets.select("node_id", "token_budget"))
    return s.join(b, "node_id", "inner").where(F.col("cum_tokens") > F.col("token_budget"))


# Exception names that count as transient (the retryable family).
TRANSIENT_TYPES = ("TransientError", "NodeTimeout", "ConnectionError", "TimeoutError",
                   "ConnectionRefusedError", "ConnectionResetError", "ConnectionAbortedError",
                   "BrokenPipeError")


def classify_error(status: Column, error_type: Column, accepted: Sequence[int] | None = None) -> Column:
    """``ok`` / ``transient`` / ``deterministic``.

    With a status: an accepted status is ok (default 2xx); 429 and >= 500 are
    transient; anything else deterministic.  Without one the error type decides.
    """
    ok = status.isin(*accepted) if accepted else (status >= 200) & (status < 300)
    by_status = (F.when(ok, "ok").when((status == 429) | (status >= 500), "transient")
                 .otherwise("deterministic"))
    by_type = F.when(error_type.isin(*TRANSIENT_TYPES), "transient").otherwise("deterministic")
    return F.when(status.isNotNull(), by_status).otherwise(by_type)
