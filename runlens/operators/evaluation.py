"""Evaluation over recorded runs: cases, checks, summaries, A/B compare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assertions import NAME_PATTERN, checked


def load_cases(df: DataFrame) -> DataFrame:
    """Case table with defaults: status ``finished``, no_dead_letters true,
    empty assertion list, budget map from the budget columns that are set."""
    cols = set(df.columns)
    status = F.coalesce(F.col("expect_status"), F.lit("finished")) if "expect_status" in cols \
        else F.lit("finished")
    ndl = F.coalesce(F.col("no_dead_letters"), F.lit(True)) if "no_dead_letters" in cols else F.lit(True)
    asserts = F.coalesce(F.col("asserts"), F.array().cast("array<string>")) if "asserts" in cols \
        else F.array().cast("array<string>")
    tok = F.col("token_budget").cast("double") if "token_budget" in cols else F.lit(None).cast("double")
    cost = F.col("cost_budget").cast("double") if "cost_budget" in cols else F.lit(None).cast("double")
    budget = F.map_from_entries(F.filter(
        F.array(F.struct(F.lit("tokens").alias("k"), tok.alias("v")),
                F.struct(F.lit("cost_usd").alias("k"), cost.alias("v"))),
        lambda e: e["v"].isNotNull()))
    return df.select(F.col("name"), status.alias("status"), ndl.alias("no_dead_letters"),
                     asserts.alias("asserts"), budget.alias("budget"))


def named_values(cases: DataFrame, state: DataFrame | None, outputs: DataFrame | None) -> DataFrame:
    """(name, names): for every case the values that its assertions name, as JSON texts; state hides node outputs.

    ``state`` and ``outputs`` are long: name, key, value (JSON text), a row per channel or node.  Only the
    keys that stand in a case's assertions are joined, so a row holds no more than its assertions read.
    """
    asked = cases.select("name", F.explode("asserts").alias("t")).select(
        "name", F.explode(F.regexp_extract_all("t", F.lit(f"({NAME_PATTERN})"), 1)).alias("key")).distinct()
    parts = [df.select("name", "key", "value", F.lit(rank).alias("rank")) for rank, df in enumerate((state, outputs)) if df is not None]
    if not parts:
        return asked.select("name", F.create_map().cast("map<string,string>").alias("names")).limit(0)
    given = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    one = given.join(asked, ["name", "key"]).groupBy("name", "key").agg(
        F.min_by(F.struct("value"), "rank").getField("value").alias("value"))
    return one.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("names"))


def eval_cases(cases: DataFrame, reports: DataFrame, state: DataFrame | None = None,
               outputs: DataFrame | None = None) -> DataFrame:
    """One row per check and case: (name, check_no, kind, detail, ok).

    ``cases`` as from ``load_cases``; ``reports`` one row per case name with ``status``,
    ``dead_letters``, ``tokens`` and ``cost_usd``; ``state`` and ``outputs`` the final state and
    the node outputs in long form (``named_values``).  An assertion that does not
    compile, names something unknown or fails is a failed check, not a crash.
    """
    status_chk = F.when(F.col("status_expected").isNotNull(), F.struct(
        F.lit("status").alias("kind"),
        F.concat(F.lit("status == "), F.col("status_expected")).alias("detail"),
        F.coalesce(F.col("status") == F.col("status_expected"), F.lit(False)).alias("ok")))
    dl_chk = F.when(F.col("no_dead_letters"), F.struct(
        F.lit("dead_letters").alias("kind"), F.lit("no dead-letters").alias("detail"),
        F.coalesce(F.col("dead_letters") == 0, F.lit(False)).alias("ok")))

    tok_b = F.col("budget")["tokens"]
    cost_b = F.col("budget")["cost_usd"]
    tok_chk = F.when(tok_b.isNotNull(), F.struct(
        F.lit("budget").alias("kind"),
        F.concat(F.lit("tokens "), F.col("tokens").cast("string"), F.lit(" <= "),
                 tok_b.cast("long").cast("string")).alias("detail"),
        F.coalesce(F.col("tokens") <= tok_b, F.lit(False)).alias("ok")))
    cost_chk = F.when(cost_b.isNotNull(), F.struct(
        F.lit("budget").alias("kind"),
        F.concat(F.lit("cost "), F.col("cost_usd").cast("string"), F.lit(" <= "),
                 cost_b.cast("string")).alias("detail"),
        F.coalesce(F.col("cost_usd") <= cost_b, F.lit(False)).alias("ok")))
    asserted = F.transform(F.arrays_zip("asserts", "_checked"), lambda x: F.struct(
        F.lit("assert").alias("kind"),
        F.concat(x["asserts"], F.coalesce(F.concat(F.lit("  ("), x["_checked"]["error"], F.lit(")")), F.lit(""))).alias("detail"),
        F.coalesce(x["_checked"]["ok"], F.lit(False)).alias("ok")))
    # all checks of a case in the reference's order, exploded once
    checks = F.concat(F.array_compact(F.array(status_chk, dl_chk)), asserted, F.array_compact(F.array(tok_chk, cost_chk)))
    j = cases.withColumnRenamed("status", "status_expected").join(reports, "name", "left") \
        .join(named_values(cases, state, outputs), "name", "left").withColumn("_checked", checked("asserts", "names"))
    return j.select("name", F.posexplode(checks).alias("check_no", "_c")).select(
        "name", "check_no", F.col("_c.kind").alias("kind"), F.col("_c.detail").alias("detail"),
        F.col("_c.ok").alias("ok"))


def case_results(checks: DataFrame, reports: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case: passed when every check holds (a case with no checks passes)."""
    per = checks.groupBy("name").agg(F.bool_and("ok").alias("all_ok"),
                                     F.count(F.lit(1)).alias("checks"))
    return cases.select("name").join(per, "name", "left").join(
        reports.select("name", "tokens", "cost_micros"), "name", "left").select(
        "name", F.coalesce("all_ok", F.lit(True)).alias("passed"),
        F.coalesce("checks", F.lit(0)).cast("long").alias("checks"),
        F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"),
        F.coalesce("cost_micros", F.lit(0)).cast("long").alias("cost_micros"))


def eval_summary(results: DataFrame) -> DataFrame:
    """A5: passed, failed, total tokens, total cost (one row, zeros on empty)."""
    return results.agg(
        F.count_if(F.col("passed")).cast("long").alias("passed"),
        F.count_if(~F.col("passed")).cast("long").alias("failed"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total_tokens"),
        (F.coalesce(F.sum("cost_micros"), F.lit(0)) / 1e6).alias("total_cost_usd"))


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join of two versions' case results by name.

    Inputs carry name, passed, status, tokens.  One row per name on each
    side, so the join is a plain shuffle (or broadcast by AQE when small).
    """
    sa = a.select("name", F.col("passed").alias("a_passed"), F.col("status").alias("a_status"),
                  F.col("tokens").alias("a_tokens"))
    sb = b.select("name", F.col("passed").alias("b_passed"), F.col("status").alias("b_status"),
                  F.col("tokens").alias("b_tokens"))
    j = sa.join(sb, "name", "inner")
    return j.select("*", (F.col("b_tokens") - F.col("a_tokens")).alias("token_delta"),
                    ((F.col("a_passed") != F.col("b_passed"))
                     | (F.col("a_status") != F.col("b_status"))).alias("outcome_changed"))


def last_node_output(events: DataFrame, output: str = "tokens") -> DataFrame:
    """Last finished output per run and node (``max_by`` combines map-side)."""
    fin = events.where(F.col("type") == "node_finished")
    return fin.groupBy("run_id", "node_id").agg(
        F.max_by(F.col(output), F.col("seq")).alias("output"), F.max("seq").alias("seq"))
