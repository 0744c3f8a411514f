"""Log-shaped views derived from the driver tables (see FIXTURES.md).

Each view is a lazy DataFrame over the parquet scans, so its size grows with
the data.  The same views exist as SQL text in ``runlens.plans.fixture_sql``
for the DuckDB oracle; the two are written independently and checked
against each other through every registered query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordered import ordered_scan
from .tables import table


def _k(props: str = "props"):
    return F.regexp_extract(F.col(props), r"([0-9]+)", 1).cast("int")


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log: one row per event, numbered per run (W1) and typed by position."""
    ev = table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value", _k().alias("k"),
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("thread_id"),
        F.concat(F.lit("t"), F.col("user_id").cast("string"), F.lit("-w"),
                 F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").cast("string")).alias("run_id"))
    n = ordered_scan(ev, ["run_id"], ["event_id"], index="seq", total="cnt")
    last = F.col("seq") == F.col("cnt")
    et = F.col("event_type")
    typ = (F.when(F.col("seq") == 1, "run_started")
           .when(last & (et == "error"), "run_failed")
           .when(last & (et == "signup"), "run_interrupted")
           .when(last & (et == "view"), "run_cancelled")
           .when(last & (et == "purchase"), "run_finished")
           .when(et.isin("click", "purchase"), "node_finished")
           .when(et == "error", "node_failed")
           .when(et == "signup", "node_retrying")
           .when(F.col("k") % 2 == 0, "node_fallback")
           .otherwise("interrupt_raised"))
    t = n.withColumn("type", typ)
    return t.select(
        "run_id", "thread_id", F.col("seq").cast("long").alias("seq"),
        F.floor((F.col("seq") - 1) / 2).cast("int").alias("step"), "ts", "type",
        F.when(F.col("type").startswith("run_"), F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("n"), (F.col("event_id") % 7).cast("string"))).alias("node_id"),
        F.when(F.col("type") == "run_started",
               F.concat(F.lit("wf"), (F.col("user_id") % 5).cast("string"))).alias("graph"),
        F.floor(F.col("value") * 10).cast("long").alias("duration_ms"),
        (F.col("k") * 10).cast("long").alias("tokens"),
        (F.col("k") * 3).cast("long").alias("cost_micros"),
        (1 + F.col("k") % 3).cast("int").alias("attempts"),
        (F.col("k") % 10 == 0).alias("cached"),
        "event_id", F.when(F.col("type").isin("run_finished", "run_failed", "run_interrupted", "run_cancelled"),
                           F.col("k") % 4).alias("dead_letters"))


def checkpoints(log: DataFrame) -> DataFrame:
    """One checkpoint per (thread, run, step) with step metrics and the pending gate."""
    return log.groupBy("thread_id", "run_id", "step").agg(
        F.min("event_id").alias("ckpt_id"),
        F.max("ts").alias("saved_at"),
        F.sum(F.when(F.col("type") == "node_finished", F.col("tokens")).otherwise(0))
         .cast("long").alias("step_tokens"),
        F.sum(F.when(F.col("type") == "node_finished", F.col("cost_micros")).otherwise(0))
         .cast("long").alias("step_cost_micros"),
        F.max(F.when(F.col("type") == "interrupt_raised", F.col("node_id"))).alias("pending_node"),
        F.count("node_id").alias("frontier_size"))


def cumulative_checkpoints(log: DataFrame) -> DataFrame:
    """Checkpoints as a run saves them: each carries the run's totals up to its step."""
    ck = checkpoints(log)
    done = log.groupBy("run_id", "step").agg(F.count_if(F.col("type") == "node_finished").alias("step_nodes"))
    ck = ck.join(done, ["run_id", "step"])
    return ordered_scan(ck, ["run_id"], ["step"], running={
        "total_tokens": "step_tokens", "total_cost_micros": "step_cost_micros", "total_nodes_run": "step_nodes"})


def writes(log: DataFrame) -> DataFrame:
    """Channel writes: every finished node writes one value to one channel."""
    return log.where(F.col("type") == "node_finished").select(
        "thread_id", "run_id", "seq", "step",
        F.concat(F.lit("c"), (F.col("event_id") % 4).cast("string")).alias("channel"),
        F.col("node_id").alias("map_key"), F.col("tokens").alias("value"),
        F.col("cost_micros").alias("value2"))


# The channel declarations of the fixture (name, type, reducer).
CHANNEL_ROWS = [("c0", "int", "last"), ("c1", "int", "sum"),
                ("c2", "list", "append"), ("c3", "dict", "merge_dict")]


def channels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHANNEL_ROWS, "channel string, type string, reducer string")


def arrivals(log: DataFrame) -> DataFrame:
    """Latest state of sources n0..n2 per run, as a merge barrier sees them."""
    src = log.where(F.col("node_id").isin("n0", "n1", "n2")).select(
        F.col("run_id").alias("thread_id"), F.col("node_id").alias("source"),
        F.struct(F.col("seq"), F.col("type")).alias("last"))
    latest = src.groupBy("thread_id", "source").agg(F.max_by("last", "last.seq").alias("last"))
    return latest.select(
        "thread_id", "source",
        F.when(F.col("last.type") == "node_finished", "ok")
         .when(F.col("last.type") == "node_failed", "failed").otherwise("skipped").alias("state"))


def cases(log: DataFrame) -> DataFrame:
    c = log.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    return c.select(
        F.col("run_id").alias("name"),
        F.when(F.col("n") % 3 == 0, "failed").when(F.col("n") % 3 == 1, "finished").alias("expect_status"),
        F.when(F.col("n") % 2 == 0, F.lit(3000).cast("long")).alias("token_budget"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded model answers: bare JSON, fenced JSON, chatty JSON, or broken."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "props", _k().alias("k"))
    e = ordered_scan(e, ["user_id"], ["event_id"], index="attempt")
    fence = F.lit("```")
    resp = (F.when(F.col("k") % 4 == 0, F.col("props"))
            .when(F.col("k") % 4 == 1, F.concat(F.lit("Sure. "), fence, F.lit("json "), F.col("props"), F.lit(" "), fence))
            .when(F.col("k") % 4 == 2, F.concat(F.lit("The answer is "), F.col("props"), F.lit(" as asked.")))
            .otherwise(F.concat(F.lit("no object "), F.substring("props", 1, 3))))
    return e.select(F.col("user_id").alias("item"), F.col("event_type").alias("variant"),
                    F.col("attempt").cast("long").alias("attempt"), resp.alias("response"))


def edges_g(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of 40 customers each: an edge per customer that has orders, to one that its newest order picks."""
    o = table(spark, sf_dir, "orders")
    first = F.col("src") - F.col("src") % 40
    return o.groupBy(F.col("o_custkey").alias("src")).agg(F.max("o_orderkey").alias("newest")) \
        .select("src", (first + F.col("newest") * 7 % 40).alias("dst"))


def nodes_g(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node per customer and per edge target; every third of some stretches of ids has a visit limit."""
    i = F.col("id")
    limited = (i % 3 == 0) & (F.floor(i / 8) % 16 == 0)
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")) \
        .union(edges_g(spark, sf_dir).select("dst")).distinct()
    return ids.select("id", F.when(limited, F.lit(3)).alias("max_iterations"))


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").alias("id"),
        F.concat(F.lit("Hello <nation.name>, region <region.name>: $"), F.lit("{HOME_DIR} secret://key_"),
                 F.col("n_regionkey").cast("string")).alias("template"))
