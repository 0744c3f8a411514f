"""Registered queries: user-function surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import samples
from ..functions import scalars as S
from ..operators import udf as X
from ..sources import fixtures as fx
from ..sources.tables import table
from .fixture_sql import with_views
from .queries_payload import TRACE_DATA_SQL, WORDS_SQL
from .registry import register


@register("map_items", f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS idx FROM d),
y AS (SELECT doc_id, idx, regexp_matches(word, '[0-9]') AS bad,
    CASE WHEN length(word) = 1 THEN NULL ELSE length(word) END AS v FROM x)
SELECT doc_id, count(*) AS items, CAST(sum(CASE WHEN bad THEN 0 ELSE 1 END) AS BIGINT) AS count,
    CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS INT) AS n_errors,
    CAST(sum(CASE WHEN bad THEN NULL ELSE v END) AS BIGINT) AS sum_out,
    CAST(sum(CASE WHEN NOT bad AND v IS NULL THEN 1 ELSE 0 END) AS INT) AS null_outputs,
    CAST(min(CASE WHEN bad THEN idx END) AS INT) AS first_error_index
FROM y GROUP BY doc_id""", "X1")
def q_map_items(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", S.words("text").alias("words"))
    m = X.map_items(d, "doc_id", "words", samples.word_len, "long", on_error="skip")
    return m.select("doc_id", "items", "count", F.size("errors").alias("n_errors"),
                    F.aggregate("results", F.lit(None).cast("long"),
                                lambda acc, v: F.when(v.isNull(), acc).otherwise(F.coalesce(acc, F.lit(0)) + v))
                    .alias("sum_out"),
                    F.size(F.filter("results", lambda v: v.isNull())).alias("null_outputs"),
                    F.get(F.col("errors"), 0)["idx"].alias("first_error_index"))


@register("map_items_fail", f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS idx FROM d),
y AS (SELECT doc_id, idx, word, regexp_matches(word, '[0-9]') AS bad FROM x)
SELECT doc_id, CASE WHEN bool_or(bad) THEN 'failed' ELSE 'ok' END AS status,
    CASE WHEN bool_or(bad) THEN concat('digit in ''', arg_min(CASE WHEN bad THEN word END, CASE WHEN bad THEN idx END), '''')
    END AS error
FROM y GROUP BY doc_id""", "X1")
def q_map_items_fail(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", S.words("text").alias("words"))
    return X.map_items(d, "doc_id", "words", samples.word_len, "long", on_error="fail").select(
        "doc_id", "status", "error")


@register("call_function", """
SELECT p_partkey, CASE WHEN list_contains(string_split(p_name, ' '), 'hot') THEN NULL
        ELSE CAST(len(string_split(p_name, ' ')) AS BIGINT) END AS value,
    CASE WHEN list_contains(string_split(p_name, ' '), 'hot') THEN 'hot parts are not accepted' END AS error,
    CASE WHEN list_contains(string_split(p_name, ' '), 'hot') THEN 'ValueError' END AS error_type
FROM part""", "X2")
def q_call_function(spark, sf):
    p = table(spark, sf, "part")
    r = X.call_function(p, "runlens.functions.samples:name_words", ["p_name"], "long")
    return p.select("p_partkey", r.alias("r")).select("p_partkey", "r.value", "r.error", "r.error_type")


@register("judge_with", """
WITH j AS (SELECT l.doc_id, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'pass' ELSE 'fail' END AS raw,
        least(1.0, length(d.text) / 5000) AS score, concat(CAST(length(d.text) AS VARCHAR), ' chars') AS reasons
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
SELECT doc_id, score, score >= 0.5 AS passed, CASE WHEN score >= 0.5 THEN 'pass' ELSE 'fail' END AS verdict,
    CASE WHEN score >= 0.5 THEN NULL ELSE reasons END AS feedback,
    CASE WHEN score >= 0.5 THEN 'publish' ELSE 'revise' END AS goto, CAST(NULL AS VARCHAR) AS error
FROM j""", "X3")
def q_judge_with(spark, sf):
    lab = table(spark, sf, "labels")
    d = table(spark, sf, "documents").select("doc_id", "text")
    j = lab.join(d, "doc_id")
    r = X.judge_with(samples.judge_doc, [F.col("text"), F.col("quality"), F.col("toxic")],
                     min_score=0.5, on_pass="publish", on_fail="revise")
    return j.select("doc_id", r.alias("r")).select("doc_id", "r.*")


def _trace_side(spark, sf, v):
    """Normalised traces of the runs of even (v=0) or odd (v=1) users, named by case.

    Each side is built from its own scan so the two plans share no lineage."""
    from .queries_payload import q_normalize_trace
    lines = q_normalize_trace(spark, sf)
    user = F.substring(F.split_part("run_id", F.lit("-"), F.lit(1)), 2, 1 << 20).cast("long")
    named = lines.select(F.concat(F.lit("u"), F.floor(user / 2).cast("string"), F.lit("-"),
                                  F.split_part("run_id", F.lit("-"), F.lit(2))).alias("name"),
                         (user % 2).alias("v"), "seq", "line")
    return named.where(F.col("v") == v).drop("v")


def _trace_sides(spark, sf):
    return _trace_side(spark, sf, 0), _trace_side(spark, sf, 1)


@register("trace_equal", with_views(f"""
WITH t AS (SELECT run_id, seq, concat('s', CAST(step AS VARCHAR), ' ', type,
        CASE WHEN node_id IS NOT NULL THEN concat(' ', node_id) ELSE '' END, {TRACE_DATA_SQL}) AS line FROM run_log),
r AS (SELECT run_id, string_agg(line, chr(10) ORDER BY seq) AS tr,
        CAST(substr(split_part(run_id, '-', 1), 2) AS BIGINT) AS u FROM t GROUP BY run_id),
s AS (SELECT concat('u', CAST(u // 2 AS VARCHAR), '-', split_part(run_id, '-', 2)) AS name, u % 2 AS v, tr FROM r)
SELECT a.name, a.tr = b.tr AS equal FROM s a JOIN s b ON a.name = b.name AND a.v = 0 AND b.v = 1""", "run_log"), "X4")
def q_trace_equal(spark, sf):
    a, b = _trace_sides(spark, sf)
    return X.trace_equal(X.trace_fingerprints(a, "name", "seq"), X.trace_fingerprints(b, "name", "seq"), "name")


@register("handoff_chain", with_views("""
WITH c AS (SELECT run_id, seq, node_id AS source, CAST(tokens // 10 AS INT) AS k FROM run_log WHERE node_id IS NOT NULL),
h AS (SELECT run_id, seq, source, concat('k=', CAST(k AS VARCHAR)) AS reason,
    CASE WHEN k % 5 = 0 THEN concat('n', CAST(k % 7 AS VARCHAR))
         WHEN k % 3 = 0 THEN concat('n', CAST((k + 1) % 7 AS VARCHAR)) END AS target FROM c),
v AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id, target ORDER BY seq) AS BIGINT) AS visit
    FROM h WHERE target IS NOT NULL)
SELECT run_id, seq, source, target, reason, visit FROM v WHERE visit <= 2""", "run_log"), "X6")
def q_handoff_chain(spark, sf):
    log = fx.run_log(spark, sf).where(F.col("node_id").isNotNull())
    k = F.floor(F.col("tokens") / 10).cast("int")
    calls = log.select("run_id", "seq", "node_id", k.alias("k")).withColumn("calls", F.array(
        F.when(F.col("k") % 5 == 0, F.concat(F.lit("handoff_to_n"), (F.col("k") % 7).cast("string")))
         .otherwise(F.lit("search")),
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("handoff_to_n"), ((F.col("k") + 1) % 7).cast("string")))
         .otherwise(F.lit("lookup"))))
    reason = F.concat(F.lit("k="), F.col("k").cast("string"))
    return X.handoff_chain(calls, ["run_id"], "seq", "node_id", "calls", reason, 2).select(
        "run_id", "seq", "source", "target", "reason", "visit")
