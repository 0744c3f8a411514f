"""Registered queries: projections, predicates and payload functions
(P1-P13, F1-F3, F5-F8, F10-F17, F19-F22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import payload as P
from ..sources import fixtures as fx
from ..sources.tables import table
from .fixture_sql import with_views
from .registry import register


@register("when_filter", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
WHERE coalesce(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice > 100000 END, true)""", "P1")
def q_when_filter(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    pred = F.when(F.col("o_orderstatus") == "F", F.lit(None)).otherwise(F.col("o_totalprice") > 100000)
    return P.when_filter(o, pred)


@register("first_match_branch", """
SELECT o_orderkey,
    CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid'
         WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END AS target,
    CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid'
         WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'low' END AS target_else
FROM orders""", "P2")
def q_first_match_branch(spark, sf):
    o = table(spark, sf, "orders")
    br = [(F.col("o_totalprice") > 300000, "high"), (F.col("o_totalprice") > 100000, "mid"),
          (F.col("o_orderpriority") == "1-URGENT", "urgent")]
    return o.select("o_orderkey", P.first_match_branch(br).alias("target"),
                    P.first_match_branch(br, "low").alias("target_else"))


CENTS = "CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR)"


@register("resolve_name", f"""
SELECT c_custkey, c_name AS name_v, CASE WHEN c_acctbal >= 0 THEN {CENTS} END AS bal_v,
    CAST(c_nationkey AS VARCHAR) AS nation_v, CAST(NULL AS VARCHAR) AS missing_v FROM customer""", "P3")
def q_resolve_name(spark, sf):
    c = table(spark, sf, "customer")
    cents = F.round(F.col("c_acctbal") * 100).cast("long").cast("string")
    state = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"),
                         F.lit("bal"), F.when(F.col("c_acctbal") >= 0, cents))
    outputs = F.create_map(F.lit("bal"), cents, F.lit("nation"), F.col("c_nationkey").cast("string"))
    return c.select("c_custkey", *[P.resolve_name(state, outputs, n).alias(f"{n}_v")
                                   for n in ("name", "bal", "nation", "missing")])


@register("interpolate", with_views("""
SELECT t.id, concat('Hello ', n.n_name, ', region <nation.name>', r.r_name, substr(t.template, instr(t.template, ': $')))
        AS text,
    CASE WHEN t.id % 3 = 0 THEN concat('"', n.n_name, '"') WHEN t.id % 3 = 1 THEN CAST(n.n_nationkey AS VARCHAR) END
        AS single_value,
    CASE WHEN t.id % 3 = 0 THEN 'string' WHEN t.id % 3 = 1 THEN 'int' END AS single_type
FROM templates t JOIN nation n ON t.id = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
                                     "templates"), "P4")
def q_interpolate(spark, sf):
    t = fx.templates(spark, sf)
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    j = t.join(n, t["id"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    # one value looks like a placeholder itself, and must stay as it is
    b = {"nation.name": F.col("n_name"), "region.name": F.concat(F.lit("<nation.name>"), "r_name"),
         "nation.key": F.col("n_nationkey")}
    single_t = F.when(F.col("id") % 3 == 0, F.lit("<nation.name>")).when(F.col("id") % 3 == 1, F.lit(" <nation.key> ")) \
        .otherwise(F.lit("x <nation.name>"))
    single = S.interpolate(single_t, b)
    return j.select("id", S.interpolate("template", b)["text"].alias("text"),
                    single["value"].alias("single_value"), single["value_type"].alias("single_type"))


NESTED_SQL = """concat('{"k": ', CAST(regexp_extract(props, '([0-9]+)', 1) AS VARCHAR), ', "tags": ["', event_type,
    '", "u', CAST(user_id AS VARCHAR), '"], "meta": {"u": ', CAST(user_id AS VARCHAR), '}}')"""


def _nested(spark, sf):
    e = table(spark, sf, "events")
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("int").cast("string")
    return e.select("event_id", F.concat(F.lit('{"k": '), k, F.lit(', "tags": ["'), F.col("event_type"),
                                         F.lit('", "u'), F.col("user_id").cast("string"),
                                         F.lit('"], "meta": {"u": '), F.col("user_id").cast("string"),
                                         F.lit("}}")).alias("j"))


@register("dig_path", f"""
WITH e AS (SELECT event_id, {NESTED_SQL} AS j FROM events)
SELECT event_id, CAST(json_extract(j, '$.k') AS VARCHAR) AS v_k, CAST(json_extract(j, '$.tags[1]') AS VARCHAR) AS v_tags1,
    '<tags.5>: bad index ''5''' AS e_tags5, CAST(json_extract(j, '$.meta.u') AS VARCHAR) AS v_metau,
    '<meta.x>: key ''x'' not found' AS e_metax, '<k.z>: cannot descend into int with ''z''' AS e_kz
FROM e""", "P5")
def q_dig_path(spark, sf):
    e = _nested(spark, sf)
    for out, path in (("a", "k"), ("b", "tags.1"), ("c", "tags.5"), ("d", "meta.u"), ("e", "meta.x"),
                      ("f", "k.z")):
        e = S.dig_path(e, "j", path, out)
    return e.select("event_id", F.col("a.value").alias("v_k"), F.col("b.value").alias("v_tags1"),
                    F.col("c.error").alias("e_tags5"), F.col("d.value").alias("v_metau"),
                    F.col("e.error").alias("e_metax"), F.col("f.error").alias("e_kz"))


@register("json_path", f"""
WITH e AS (SELECT event_id, {NESTED_SQL} AS j FROM events)
SELECT event_id, CAST(json_extract(j, '$.tags[1]') AS VARCHAR) AS v_tags1,
    CAST(json_extract(j, '$.meta.u') AS VARCHAR) AS v_metau,
    '$.tags[5]: cannot resolve ''5'' in list' AS e_tags5, '$.x: cannot resolve ''x'' in dict' AS e_x,
    '$.k[0]: cannot resolve ''0'' in int' AS e_k0
FROM e""", "F1")
def q_json_path(spark, sf):
    e = _nested(spark, sf)
    e = S.json_paths(e, "j", {"a": "$.tags[1]", "b": "$.meta.u", "c": "$.tags[5]", "d": "$.x", "e": "$.k[0]"})
    return e.select("event_id", F.col("a.value").alias("v_tags1"), F.col("b.value").alias("v_metau"),
                    F.col("c.error").alias("e_tags5"), F.col("d.error").alias("e_x"), F.col("e.error").alias("e_k0"))


NESTED_REFS_SQL = """
SELECT DISTINCT id, unnest(['nation.name', 'region.name', 'a.b', concat('n', id, '.k'), 'deep.x.y']) AS ref FROM templates"""


def _configs(spark, sf):
    """Templates inside nested values; the keys look like placeholders but are none."""
    t = fx.templates(spark, sf)
    own = F.concat(F.lit("<n"), F.col("id").cast("string"), F.lit(".k>"))
    return t.select("id", F.struct(F.array(F.col("template"), F.lit(None).cast("string"), F.lit("<a.b> <a.b>")).alias("list"),
                                   F.create_map(F.lit("<key.no>"), F.struct(own.alias("in"), F.lit(7).alias("n"))).alias("map"),
                                   F.lit('say "<deep.x.y>":').alias("text")).alias("config"))


@register("find_refs_nested", with_views(NESTED_REFS_SQL, "templates"), "P6")
def q_find_refs_nested(spark, sf):
    return P.find_refs(_configs(spark, sf), "config", ["id"])


@register("find_refs_json", with_views(NESTED_REFS_SQL, "templates"), "P6")
def q_find_refs_json(spark, sf):
    return P.find_refs(_configs(spark, sf).withColumn("config", F.to_json("config")), "config", ["id"], is_json=True)


@register("find_refs", with_views("""
SELECT DISTINCT id, unnest(regexp_extract_all(template, '<([A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z0-9_]+)+)>', 1)) AS ref
FROM templates""", "templates"), "P6")
def q_find_refs(spark, sf):
    return P.find_refs(fx.templates(spark, sf), "template", ["id"])


WORDS_SQL = "regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')"


@register("summarize_payload", f"""
WITH d AS (SELECT doc_id, text, {WORDS_SQL} AS w FROM documents)
SELECT doc_id,
    CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '… (+', CAST(length(text) - 200 AS VARCHAR), ' chars)')
         ELSE text END AS summary,
    CASE WHEN len(w) > 10 THEN concat(array_to_string(w[1:10], '|'), '|… (+', CAST(len(w) - 10 AS VARCHAR), ' items)')
         ELSE array_to_string(w, '|') END AS words_summary
FROM d""", "P7")
def q_summarize_payload(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", S.summarize_text("text").alias("summary"),
                    F.array_join(S.summarize_list(S.words("text")), "|").alias("words_summary"))


TRACE_DATA_SQL = """CASE
    WHEN type = 'node_finished' THEN concat(' {''attempts'': ', CAST(attempts AS VARCHAR), ', ''cached'': ',
        CASE WHEN cached THEN 'True' ELSE 'False' END, '}')
    WHEN type = 'run_started' THEN concat(' {''graph'': ''', graph, '''}')
    WHEN type = 'node_retrying' THEN concat(' {''attempt'': ', CAST(attempts AS VARCHAR), '}')
    ELSE '' END"""


@register("normalize_trace", with_views(f"""
SELECT run_id, seq, concat('s', CAST(step AS VARCHAR), ' ', type,
    CASE WHEN node_id IS NOT NULL THEN concat(' ', node_id) ELSE '' END, {TRACE_DATA_SQL}) AS line
FROM run_log""", "run_log"), "P8")
def q_normalize_trace(spark, sf):
    log = fx.run_log(spark, sf)
    t = F.col("type")
    empty = F.create_map().cast("map<string,string>")
    data = (F.when(t == "node_finished", F.create_map(
                F.lit("attempts"), F.col("attempts").cast("string"),
                F.lit("cached"), F.when(F.col("cached"), "True").otherwise("False"),
                F.lit("tokens"), F.col("tokens").cast("string"),
                F.lit("duration_s"), (F.col("duration_ms") / 1000).cast("string")))
            .when(t == "run_started", F.create_map(F.lit("graph"), F.concat(F.lit("'"), F.col("graph"), F.lit("'"))))
            .when(t == "node_retrying", F.create_map(F.lit("attempt"), F.col("attempts").cast("string"),
                                                     F.lit("delay_s"), F.lit("0.5")))
            .otherwise(empty))
    return P.normalize_trace(log.withColumn("data", data)).select("run_id", "seq", "line")


@register("events_after", with_views("""
WITH p AS (SELECT thread_id, event_id, CAST(row_number() OVER (PARTITION BY thread_id ORDER BY event_id) AS BIGINT)
        AS position FROM run_log),
c AS (SELECT thread_id, CAST(count(*) // 2 AS BIGINT) AS last_id FROM run_log GROUP BY thread_id)
SELECT p.thread_id, p.event_id, p.position, c.last_id FROM p JOIN c ON p.thread_id = c.thread_id
WHERE p.position > c.last_id""", "run_log"), "P9")
def q_events_after(spark, sf):
    log = fx.run_log(spark, sf).select("thread_id", "event_id")
    cursors = log.groupBy("thread_id").agg(F.floor(F.count(F.lit(1)) / 2).cast("long").alias("last_id"))
    return P.events_after(log, cursors).select("thread_id", "event_id", "position", "last_id")


@register("missing_fields", """
WITH v AS (SELECT doc_id, text, CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END AS source,
    CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS lang,
    CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_chars END AS n_chars FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN text IS NULL OR text = '' THEN 'text' END,
    CASE WHEN source IS NULL OR source = '' THEN 'source' END,
    CASE WHEN n_chars IS NULL OR n_chars = 0 THEN 'n_chars' END) AS missing,
    coalesce(lang, 'en') AS lang_filled
FROM v""", "P10")
def q_missing_fields(spark, sf):
    d = table(spark, sf, "documents")
    src = F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.col("source"))
    lang = F.when(F.col("doc_id") % 5 == 0, F.lit(None)).otherwise(F.col("lang"))
    nch = F.when(F.col("doc_id") % 3 == 0, F.lit(0)).otherwise(F.col("n_chars"))
    values = {"text": (F.col("text"), "str"), "source": (src, "str"), "lang": (lang, "str"),
              "n_chars": (nch, "num")}
    spec = [("text", True, None), ("source", True, None), ("lang", True, "en"), ("n_chars", True, None)]
    missing, filled = S.missing_fields(values, spec)
    return d.select("doc_id", F.array_join(missing, ",").alias("missing"), filled["lang"].alias("lang_filled"))


REDACT_SQL = """
WITH vals AS (SELECT DISTINCT unnest(regexp_extract_all(text, 'token\\s*=\\s*"([^"]*)"', 1)) AS v FROM documents
    UNION SELECT 'a/b+c==' UNION SELECT 'thea'),
l AS (SELECT list(v ORDER BY length(v) DESC, v) AS vs FROM vals WHERE v <> ''),
m AS (SELECT doc_id, list_reduce(list_prepend(text, (SELECT vs FROM l)), lambda acc, v: replace(acc, v, '[REDACTED]')) AS t
    FROM documents),
pat AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t,
        '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[REDACTED]', 'g'),
        '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b', '[REDACTED]', 'g'),
        '\\b\\d{16}\\b', '[REDACTED]', 'g') AS t FROM m)
SELECT doc_id, sha256(t) AS text_sha,
    CAST((length(t) - length(replace(t, '[REDACTED]', ''))) / 10 AS BIGINT) AS masks FROM pat"""


@register("redact", REDACT_SQL, "P11")
def q_redact(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    # values with any characters, and one that stands inside longer words
    known = P.secret_values(d, "text").union(spark.createDataFrame([("a/b+c==",), ("thea",)], "value string"))
    out = P.redact(d, "text", known)
    t = F.col("text")
    return out.select("doc_id", F.sha2(t, 256).alias("text_sha"),
                      ((F.length(t) - F.length(F.replace(t, F.lit(P.MASK), F.lit("")))) / 10)
                      .cast("long").alias("masks"))


# a million known values and more: 67 for every order
REDACT_NESTED_SQL = """
SELECT o_orderkey, t AS note, concat(t, '|', o_orderpriority) AS lines, t AS by_status, concat(o_orderstatus, ' [REDACTED]') AS host
FROM (SELECT *, CASE WHEN o_orderkey % 100 < 67 THEN 'see [REDACTED] ok'
    ELSE concat('see ord-', o_orderkey, '-', lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0'), '; ok') END AS t FROM orders)"""


@register("redact_nested", REDACT_NESTED_SQL, "P11")
def q_redact_nested(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    token = F.concat(F.lit("ord-"), F.col("o_orderkey").cast("string"), F.lit("-"))
    note = F.concat(F.lit("see "), token, F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit("; ok"))
    known = o.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(66)), lambda i: F.concat(
        token, F.lpad(i.cast("string"), 2, "0"), F.lit(";")))).alias("value"))
    payload = F.struct(note.alias("note"), F.array(note, F.col("o_orderpriority")).alias("lines"),
                       F.create_map("o_orderstatus", F.struct(note.alias("n"), F.concat(
                           F.col("o_orderstatus"), F.lit(" 10.0.0.1")).alias("host"))).alias("by"))
    out = P.redact(o.select("o_orderkey", "o_orderstatus", payload.alias("p")), "p", known)
    one = F.col("p.by")[F.col("o_orderstatus")]
    return out.select("o_orderkey", "p.note", F.array_join("p.lines", "|").alias("lines"), one["n"].alias("by_status"),
                      one["host"].alias("host"))


@register("review_pairs", """
SELECT conv_id, arg_min(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END) AS criteria,
    arg_max(CASE WHEN role = 'assistant' THEN text END, CASE WHEN role = 'assistant' THEN turn END) AS artifact
FROM conversations GROUP BY conv_id""", "P12")
def q_review_pairs(spark, sf):
    return P.review_pairs(table(spark, sf, "conversations"))


@register("fresh_only", """
SELECT event_id, ts FROM events
WHERE (epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(ts)) / 1e6 <= 86400.0""", "P13")
def q_fresh_only(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return P.fresh_only(e, "ts", "2024-01-20 12:00:00", 86400.0)


@register("extract_json", with_views("""
WITH b AS (SELECT item, attempt, response,
    CASE WHEN regexp_matches(response, '(?s)```(?:json)?\\s*(.*?)```')
         THEN regexp_extract(response, '(?s)```(?:json)?\\s*(.*?)```', 1) ELSE response END AS body FROM candidates),
s AS (SELECT *, instr(body, '{') AS st, length(body) - instr(reverse(body), '}') + 1 AS la,
    instr(body, '}') > 0 AS has_end FROM b),
f AS (SELECT *, st > 0 AND has_end AND la > st AS found FROM s),
g AS (SELECT *, CASE WHEN found THEN substr(body, st, la - st + 1) END AS span FROM f)
SELECT item, attempt, CASE WHEN found AND json_valid(span) THEN span END AS json,
    CASE WHEN NOT found THEN 'no JSON object found in response' WHEN NOT json_valid(span) THEN 'invalid JSON' END AS error
FROM g""", "candidates"), "F2")
def q_extract_json(spark, sf):
    c = S.with_extracted_json(fx.candidates(spark, sf), "response", "x")
    return c.select("item", "attempt", F.col("x.json").alias("json"), F.col("x.error").alias("error"))


@register("validate_schema", with_views("""
WITH b AS (SELECT item, attempt, response,
    CASE WHEN regexp_matches(response, '(?s)```(?:json)?\\s*(.*?)```')
         THEN regexp_extract(response, '(?s)```(?:json)?\\s*(.*?)```', 1) ELSE response END AS body FROM candidates),
s AS (SELECT *, instr(body, '{') AS st, length(body) - instr(reverse(body), '}') + 1 AS la,
    instr(body, '}') > 0 AS has_end FROM b),
g AS (SELECT *, CASE WHEN st > 0 AND has_end AND la > st THEN substr(body, st, la - st + 1) END AS span FROM s),
j AS (SELECT item, attempt, response, CASE WHEN json_valid(span) THEN span END AS js FROM g)
SELECT item, attempt, js IS NOT NULL AS valid, CASE WHEN js IS NULL THEN 'not JSON' END AS error,
    CAST(json_extract(js, '$.k') AS BIGINT) AS k,
    js IS NOT NULL AS valid_f, CAST(json_extract(js, '$.k') AS DOUBLE) AS kf,
    false AS valid_s, CASE WHEN js IS NULL THEN 'not JSON' ELSE 'k: not a valid str; text: field required' END AS error_s,
    CASE WHEN js IS NOT NULL THEN response END AS raw_text, false AS valid_big, 'k: not a valid int' AS error_big
FROM j""", "candidates"), "F3")
def q_validate_schema(spark, sf):
    c = S.with_extracted_json(fx.candidates(spark, sf), "response", "x").withColumn("js", F.col("x.json"))
    c = S.validate_schema(c, "js", {"k": "int"}, "v", raw="response")
    # a number beyond 64 bits is an error row, not an error
    c = c.withColumn("big", F.concat(F.lit('{"k": "9999999999999999999'), F.col("attempt").cast("string"), F.lit('"}')))
    c = S.validate_schema(c, "big", {"k": "int"}, "vb")
    c = S.validate_schema(c, "js", {"k": "float"}, "vf")
    c = S.validate_schema(c, "js", {"k": "str", "text": "str"}, "vs")
    return c.select("item", "attempt", F.col("v.valid").alias("valid"), F.col("v.error").alias("error"),
                    F.col("v.k").alias("k"), F.col("vf.valid").alias("valid_f"), F.col("vf.k").alias("kf"),
                    F.col("vs.valid").alias("valid_s"), F.col("vs.error").alias("error_s"),
                    F.col("v.text").alias("raw_text"), F.col("vb.valid").alias("valid_big"),
                    F.col("vb.error").alias("error_big"))


@register("estimate_tokens", """
SELECT doc_id, CAST(greatest(1, length(text) // 4) AS BIGINT) AS tokens FROM documents""", "F5")
def q_estimate_tokens(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", S.estimate_tokens("text").alias("tokens"))


# powers of ten, halves and whole numbers: what a float looks like when it is written out
FLOAT_SQL = """CASE o_orderkey % 6 WHEN 0 THEN '1e+20' WHEN 1 THEN '1.0' WHEN 2 THEN '1.5e-07' WHEN 3 THEN '-0.0001'
    WHEN 4 THEN concat(CAST(o_custkey AS VARCHAR), '.5') ELSE '1234567890123456.0' END"""


@register("canonical_hash", f"""
SELECT o_orderkey, sha256(concat('{{"config":{{"custkey":', CAST(o_custkey AS VARCHAR), ',"date":"',
    strftime(o_orderdate, '%Y-%m-%d'), '","floats":[', {FLOAT_SQL}, ',null],"priority":"', o_orderpriority, '","status":"', o_orderstatus,
    '","tags":{{"a":"caf\\u00e9 \\ud83d\\ude00","z":"', o_orderstatus, '"}}}},"item":', CAST(o_orderkey AS VARCHAR), ',"type":"orders"}}')) AS input_hash
FROM orders""", "F6")
def q_canonical_hash(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 6
    x = F.when(k == 0, 1e20).when(k == 1, 1.0).when(k == 2, 1.5e-7).when(k == 3, -1e-4) \
        .when(k == 4, F.col("o_custkey") + 0.5).otherwise(1234567890123456.0)
    cfg = {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority"), "custkey": F.col("o_custkey"),
           "date": F.date_format("o_orderdate", "yyyy-MM-dd"), "floats": F.array(x, F.lit(None)),
           "tags": F.create_map(F.lit("z"), F.col("o_orderstatus"), F.lit("a"), F.lit("caf\u00e9 \U0001f600"))}
    return o.select("o_orderkey", S.canonical_hash(o, "orders", cfg, F.col("o_orderkey")).alias("input_hash"))


DURATION_TXT_SQL = """CASE WHEN event_id % 17 = 0 THEN CAST(k AS VARCHAR)
    WHEN event_type = 'click' THEN concat(CAST(k AS VARCHAR), 'ms')
    WHEN event_type = 'view' THEN concat(CAST(k AS VARCHAR), 's')
    WHEN event_type = 'purchase' THEN concat(CAST(k % 60 AS VARCHAR), 'm')
    WHEN event_type = 'signup' THEN concat(CAST(k // 10 AS VARCHAR), '.', CAST(k % 10 AS VARCHAR), 'h')
    WHEN k % 2 = 0 THEN concat(' ', CAST(k AS VARCHAR), ' d ') ELSE concat('soon', CAST(k AS VARCHAR)) END"""


@register("parse_duration", f"""
WITH e AS (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, event_type FROM events),
d AS (SELECT event_id, {DURATION_TXT_SQL} AS txt FROM e),
m AS (SELECT *, regexp_matches(txt, '^\\s*(\\d+(?:\\.\\d+)?)\\s*(ms|s|m|h|d)?\\s*$') AS ok,
    CAST(NULLIF(regexp_extract(txt, '^\\s*(\\d+(?:\\.\\d+)?)\\s*(ms|s|m|h|d)?\\s*$', 1), '') AS DOUBLE) AS num,
    regexp_extract(txt, '^\\s*(\\d+(?:\\.\\d+)?)\\s*(ms|s|m|h|d)?\\s*$', 2) AS unit FROM d)
SELECT event_id, txt, CASE WHEN ok THEN num * CASE unit WHEN 'ms' THEN 0.001 WHEN 's' THEN 1.0 WHEN 'm' THEN 60.0
        WHEN 'h' THEN 3600.0 WHEN 'd' THEN 86400.0 ELSE 1.0 END END AS seconds,
    CASE WHEN NOT ok THEN concat('bad duration ', txt) END AS error
FROM m""", "F7")
def q_parse_duration(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type",
                                          F.regexp_extract("props", r"([0-9]+)", 1).cast("int").alias("k"))
    d = e.select("event_id", F.expr(DURATION_TXT_SQL.replace("k // 10", "k div 10")
                                    .replace("AS VARCHAR", "AS STRING")).alias("txt"))
    p = S.parse_duration("txt")
    return d.select("event_id", "txt", p["seconds"].alias("seconds"), p["error"].alias("error"))


# a value may look like a placeholder
ENV_ROWS = [("HOME_DIR", "${WORK_DIR}/runner"), ("WORK_DIR", "/srv/work")]


@register("fill_env", with_views("""
SELECT CASE WHEN id % 2 = 0 THEN id END AS key, replace(CASE WHEN id % 3 = 0 THEN concat(template, ' $', '{MISSING_VAR}') ELSE template END,
    concat('$', '{HOME_DIR}'), concat('$', '{WORK_DIR}/runner')) AS filled FROM templates""", "templates"), "F8")
def q_fill_env(spark, sf):
    t = fx.templates(spark, sf).withColumn(
        "template", F.when(F.col("id") % 3 == 0, F.concat("template", F.lit(" $"), F.lit("{MISSING_VAR}")))
        .otherwise(F.col("template")))
    env = spark.createDataFrame(ENV_ROWS, "name string, value string")
    # every other row has no key
    out = P.fill_env(t.withColumn("key", F.when(F.col("id") % 2 == 0, F.col("id"))), "template", env)
    return out.select("key", F.col("template").alias("filled"))


LITERAL_SQL = """CASE WHEN event_id % 19 = 0 THEN event_type ELSE concat(event_type, '=', CASE k % 6
    WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN concat('"', event_type, '"') WHEN 2 THEN 'true'
    WHEN 3 THEN concat('[', CAST(k AS VARCHAR), ']') WHEN 4 THEN concat('not json ', CAST(k AS VARCHAR))
    ELSE concat('{"a": ', CAST(k AS VARCHAR), '}') END) END"""


@register("typed_literal", f"""
WITH e AS (SELECT event_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
t AS (SELECT event_id, {LITERAL_SQL} AS txt FROM e),
s AS (SELECT event_id, instr(txt, '=') AS p, txt FROM t),
r AS (SELECT event_id, CASE WHEN p > 0 THEN substr(txt, 1, p - 1) END AS key,
    CASE WHEN p > 0 THEN substr(txt, p + 1) END AS raw, p FROM s)
SELECT event_id, key, raw,
    CASE WHEN raw IS NULL THEN NULL WHEN NOT json_valid(raw) THEN 'text' ELSE
        CASE json_type(raw) WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'bool' WHEN 'BIGINT' THEN 'int'
            WHEN 'UBIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'str' WHEN 'ARRAY' THEN 'list'
            WHEN 'OBJECT' THEN 'dict' END END AS type,
    CASE WHEN p = 0 THEN 'expects key=value' END AS error
FROM r""", "F10")
def q_typed_literal(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type",
                                          F.regexp_extract("props", r"([0-9]+)", 1).cast("int").alias("k"))
    t = e.select("event_id", F.expr(LITERAL_SQL.replace("AS VARCHAR", "AS STRING")).alias("txt"))
    x = S.typed_literal("txt")
    return t.select("event_id", x["key"].alias("key"), x["raw"].alias("raw"), x["type"].alias("type"),
                    x["error"].alias("error"))


SLUG_SQL = """CASE WHEN array_to_string(regexp_extract_all(lower({c}), '[a-z0-9]+')[1:4], '_') = '' THEN 'workflow'
    ELSE array_to_string(regexp_extract_all(lower({c}), '[a-z0-9]+')[1:4], '_') END"""


@register("slugify", f"""
SELECT 'part' AS src, p_partkey AS id, {SLUG_SQL.format(c='p_name')} AS slug FROM part
UNION ALL SELECT 'doc', doc_id, {SLUG_SQL.format(c='text')} FROM documents
UNION ALL SELECT 'punct', doc_id, {SLUG_SQL.format(c="'*** ' || lang || '!!'")} FROM documents
UNION ALL SELECT 'empty', doc_id, {SLUG_SQL.format(c="'?!'")} FROM documents""", "F11")
def q_slugify(spark, sf):
    p = table(spark, sf, "part").select(F.lit("part").alias("src"), F.col("p_partkey").alias("id"),
                                        S.slugify("p_name").alias("slug"))
    d = table(spark, sf, "documents")
    return p.unionByName(d.select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"),
                                  S.slugify("text").alias("slug"))) \
        .unionByName(d.select(F.lit("punct").alias("src"), F.col("doc_id").alias("id"),
                              S.slugify(F.concat(F.lit("*** "), F.col("lang"), F.lit("!!"))).alias("slug"))) \
        .unionByName(d.select(F.lit("empty").alias("src"), F.col("doc_id").alias("id"),
                              S.slugify(F.lit("?!")).alias("slug")))


URL_SQL = """
WITH u0 AS (SELECT page_id, 0 AS form, url AS u FROM pages
    UNION ALL SELECT page_id, 1, regexp_replace(url, '^https?://', '') FROM pages
    UNION ALL SELECT page_id, 2, concat(regexp_extract(url, '://([^/?#]*)', 1), ':', CAST(8000 + page_id % 100 AS VARCHAR),
        '/v1') FROM pages
    UNION ALL SELECT page_id, 3, concat('HTTPS://LocalHost:', CAST(9000 + page_id % 7 AS VARCHAR)) FROM pages
    UNION ALL SELECT page_id, 4, concat(regexp_extract(url, '://([^/?#]*)', 1), ':9999999999', CAST(page_id % 7 AS VARCHAR))
        FROM pages),
u1 AS (SELECT page_id, form, CASE WHEN instr(trim(u), '://') > 0 THEN trim(u) ELSE concat('http://', trim(u)) END AS raw
    FROM u0),
u2 AS (SELECT *, lower(regexp_extract(raw, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1)) AS sch,
    regexp_extract(regexp_extract(raw, '://([^/?#]*)', 1), '([^@]*)$', 1) AS hp FROM u1),
u3 AS (SELECT *, CASE WHEN sch = '' THEN 'http' ELSE sch END AS scheme,
    lower(regexp_extract(hp, '^([^:]*)', 1)) AS h0, regexp_extract(hp, ':(\\d+)$', 1) AS pt FROM u2),
u4 AS (SELECT *, CASE WHEN h0 = '' THEN 'localhost' ELSE h0 END AS host,
    CASE WHEN pt <> '' THEN TRY_CAST(pt AS INT) END AS explicit,
    form = 4 AS bad FROM u3),
u5 AS (SELECT *, coalesce(explicit, CASE WHEN scheme = 'https' THEN 443 ELSE 80 END) AS port FROM u4)
SELECT page_id, form, CASE WHEN NOT bad THEN concat(scheme, '://', CASE WHEN explicit IS NOT NULL
        THEN concat(host, ':', CAST(explicit AS VARCHAR)) ELSE host END) END AS origin, host,
    CASE WHEN NOT bad THEN port END AS port, CASE WHEN bad THEN concat('bad port ', pt) END AS error,
    CASE WHEN bad THEN NULL WHEN host IN ('127.0.0.1', 'localhost', '::1') THEN concat('openai_local_', CAST(port AS VARCHAR))
         ELSE concat('openai_', replace(host, '.', '_'), '_', CAST(port AS VARCHAR)) END AS alias
FROM u5"""


@register("normalize_url", URL_SQL, "F12")
def q_normalize_url(spark, sf):
    p = table(spark, sf, "pages")
    forms = [p.select("page_id", F.lit(0).alias("form"), F.col("url").alias("u")),
             p.select("page_id", F.lit(1).alias("form"), F.regexp_replace("url", r"^https?://", "").alias("u")),
             p.select("page_id", F.lit(2).alias("form"), F.concat(
                 F.regexp_extract("url", r"://([^/?#]*)", 1), F.lit(":"),
                 (F.lit(8000) + F.col("page_id") % 100).cast("string"), F.lit("/v1")).alias("u")),
             p.select("page_id", F.lit(3).alias("form"), F.concat(
                 F.lit("HTTPS://LocalHost:"), (F.lit(9000) + F.col("page_id") % 7).cast("string")).alias("u")),
             p.select("page_id", F.lit(4).alias("form"), F.concat(
                 F.regexp_extract("url", r"://([^/?#]*)", 1), F.lit(":9999999999"),
                 (F.col("page_id") % 7).cast("string")).alias("u"))]
    u = forms[0]
    for f in forms[1:]:
        u = u.unionByName(f)
    n = S.normalize_url("u")
    return u.select("page_id", "form", n["origin"].alias("origin"), n["host"].alias("host"),
                    n["port"].alias("port"), n["alias"].alias("alias"), n["error"].alias("error"))


@register("safe_ops", """
SELECT l_orderkey, l_linenumber,
    CAST(floor(l_quantity / 7) AS DOUBLE) AS q_floordiv, CAST(9007199254740993 + l_linenumber * 2 AS BIGINT) AS big_floordiv,
    CAST(CASE WHEN l_linenumber <> 4 THEN floor(l_linenumber / (l_linenumber - 4)) END AS BIGINT) AS zero_floordiv,
    CAST((l_linenumber - 4) - 3 * floor((l_linenumber - 4) / 3) AS BIGINT) AS mod_pos,
    CAST(l_linenumber - (-3) * floor(l_linenumber / (-3)) AS BIGINT) AS mod_neg,
    CAST(round_even(l_extendedprice / 100, 0) AS DOUBLE) AS price_round,
    l_discount <> 0 AS discount_truthy,
    CAST(length(l_returnflag || l_linestatus) AS BIGINT) AS flags_len,
    contains(l_returnflag || l_linestatus, 'A') AS has_a,
    least(l_tax, l_discount) AS min_rate, abs(l_quantity - 25) AS qty_dev,
    CASE WHEN l_linenumber = 1 THEN NULL ELSE 9223372036854775807 END AS least_floordiv,
    l_quantity * 1e300 AS huge_floordiv, 9.0::DOUBLE AS tenth_floordiv
FROM lineitem""", "F13")
def q_safe_ops(spark, sf):
    li = table(spark, sf, "lineitem")
    ln = F.col("l_linenumber")
    flags = F.concat("l_returnflag", "l_linestatus")
    return li.select(
        "l_orderkey", "l_linenumber",
        S.floordiv(F.col("l_quantity"), F.lit(7), "float").alias("q_floordiv"),
        S.floordiv(F.lit(9007199254740993) + ln * 2, F.lit(1)).cast("long").alias("big_floordiv"),
        S.floordiv(ln, ln - 4).cast("long").alias("zero_floordiv"),
        S.pymod(ln - 4, F.lit(3)).cast("long").alias("mod_pos"),
        S.pymod(ln, F.lit(-3)).cast("long").alias("mod_neg"),
        S.round_even(F.col("l_extendedprice") / 100, 0).cast("double").alias("price_round"),
        S.truthy_num(F.col("l_discount")).alias("discount_truthy"),
        S.py_len(flags).cast("long").alias("flags_len"),
        S.py_in(F.lit("A"), flags).alias("has_a"),
        F.least("l_tax", "l_discount").alias("min_rate"),
        F.abs(F.col("l_quantity") - 25).alias("qty_dev"),
        # the smallest long over -1 has no answer in 64 bits; the next one has
        S.floordiv(F.lit(-(1 << 63)) + F.when(ln == 1, 0).otherwise(1), F.lit(-1)).cast("long").alias("least_floordiv"),
        S.floordiv(F.col("l_quantity") * 1e300, F.lit(1.0), "float").alias("huge_floordiv"),
        S.floordiv(F.lit(1.0), F.lit(0.1), "float").alias("tenth_floordiv"))


TS_TXT_SQL = """CASE WHEN event_id % 13 = 0 THEN 'garbage'
    WHEN event_id % 7 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END"""


@register("parse_ts", f"""
WITH t AS (SELECT event_id, {TS_TXT_SQL} AS txt FROM events)
SELECT event_id, txt, TRY_CAST(txt AS TIMESTAMP) AS parsed FROM t""", "F14")
def q_parse_ts(spark, sf):
    e = table(spark, sf, "events")
    txt = (F.when(F.col("event_id") % 13 == 0, F.lit("garbage"))
           .when(F.col("event_id") % 7 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
           .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    t = e.select("event_id", txt.alias("txt"))
    return t.select("event_id", "txt", S.parse_ts("txt").cast("timestamp_ntz").alias("parsed"))


VERDICT_BASE_SQL = """
WITH l AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'maybe' WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS raw,
    CASE WHEN doc_id % 7 = 0 THEN NULL WHEN toxic = 0 THEN 0.9 ELSE 0.3 END AS score,
    concat('doc ', CAST(doc_id AS VARCHAR)) AS reasons FROM labels),
v AS (SELECT *, raw IN ('pass', 'fail') AS valid, coalesce(score >= 0.7, false) AS pa, raw = 'pass' AS pb FROM l)
SELECT doc_id, CASE WHEN NOT valid THEN concat('verdict must be ''pass'' or ''fail'', got ''', raw, '''') END AS error,
    valid AND pa AS passed_a, CASE WHEN valid AND pa THEN 'pass' ELSE 'fail' END AS verdict_a,
    CASE WHEN NOT (valid AND pa) THEN reasons END AS feedback_a,
    CASE WHEN valid AND pa THEN 'publish' ELSE 'revise' END AS goto_a,
    valid AND pb AS passed_b, CASE WHEN valid AND pb THEN 'pass' ELSE 'fail' END AS verdict_b,
    CAST(NULL AS VARCHAR) AS goto_b
FROM v"""


@register("verdict", VERDICT_BASE_SQL, "F15")
def q_verdict(spark, sf):
    from ..operators.judging import verdict
    lab = table(spark, sf, "labels")
    raw = (F.when(F.col("doc_id") % 11 == 0, F.lit("maybe"))
           .when(F.col("quality") == 1, F.lit("pass")).otherwise(F.lit("fail")))
    score = (F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("double"))
             .when(F.col("toxic") == 0, F.lit(0.9)).otherwise(F.lit(0.3)))
    base = lab.select("doc_id", raw.alias("raw"), score.alias("score"),
                      F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("reasons"))
    a = verdict(F.col("raw"), F.col("score"), F.col("reasons"), min_score=0.7, on_pass="publish", on_fail="revise")
    b = verdict(F.col("raw"), F.col("score"), F.col("reasons"), on_pass="publish")
    return base.select("doc_id", a["error"].alias("error"), a["passed"].alias("passed_a"),
                       a["verdict"].alias("verdict_a"), a["feedback"].alias("feedback_a"),
                       a["goto"].alias("goto_a"), b["passed"].alias("passed_b"), b["verdict"].alias("verdict_b"),
                       b["goto"].alias("goto_b"))


@register("keyed_map_to_list", """
SELECT p_partkey, 0 AS pos, concat('n', CAST(p_partkey AS VARCHAR)) AS id, p_type AS type, p_size AS size FROM part
UNION ALL SELECT p_partkey, 1, concat('m', CAST(p_partkey AS VARCHAR)), p_brand, p_size + 1 FROM part""", "F16")
def q_keyed_map_to_list(spark, sf):
    p = table(spark, sf, "part")
    m = F.create_map(F.concat(F.lit("n"), F.col("p_partkey").cast("string")),
                     F.struct(F.col("p_type").alias("type"), F.col("p_size").alias("size")),
                     F.concat(F.lit("m"), F.col("p_partkey").cast("string")),
                     F.struct(F.col("p_brand").alias("type"), (F.col("p_size") + 1).alias("size")))
    lst = S.keyed_map_to_list(m)
    return p.select("p_partkey", F.posexplode(lst).alias("pos", "e")).select(
        "p_partkey", "pos", F.col("e.id").alias("id"), F.col("e.spec.type").alias("type"),
        F.col("e.spec.size").alias("size"))


@register("flatten_leaves", """
SELECT o_orderkey AS id, o_custkey AS customer_id, o_orderstatus AS status, o_totalprice AS price,
    o_orderkey * 10 AS lines0_id, o_orderpriority AS name, o_orderdate AS date, o_custkey AS a FROM orders""", "F17")
def q_flatten_leaves(spark, sf):
    o = table(spark, sf, "orders")
    nested = o.select(F.struct(
        F.col("o_orderkey").alias("id"),
        F.struct(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status")).alias("customer"),
        F.array(F.struct(F.col("o_totalprice").alias("price"), (F.col("o_orderkey") * 10).alias("id"))).alias("lines"),
        F.struct(F.struct(F.col("o_orderpriority").alias("name"), F.struct(
            F.col("o_orderdate").alias("date"), F.struct(F.lit(1).alias("x")).alias("deeper")).alias("deep"))
            .alias("priority")).alias("meta"),
        F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b")).alias("doc"))
    return P.flatten_leaves(nested, "doc", max_leaves=8, max_depth=4)


@register("secret_refs", with_views("""
SELECT DISTINCT id, unnest(regexp_extract_all(template, 'secret://([A-Za-z_][A-Za-z0-9_]*)', 1)) AS name
FROM templates""", "templates"), "F19")
def q_secret_refs(spark, sf):
    return P.secret_refs(fx.templates(spark, sf), "template", ["id"])


@register("env_refs", with_views("""
WITH t AS (SELECT id, CASE WHEN id % 3 = 0 THEN concat(template, ' $', '{MISSING_VAR}') ELSE template END AS template
    FROM templates)
SELECT DISTINCT id, unnest(regexp_extract_all(template, '\\$\\{([A-Za-z_][A-Za-z0-9_]*)\\}', 1)) AS name FROM t""",
                                  "templates"), "F20")
def q_env_refs(spark, sf):
    t = fx.templates(spark, sf).withColumn(
        "template", F.when(F.col("id") % 3 == 0, F.concat("template", F.lit(" $"), F.lit("{MISSING_VAR}")))
        .otherwise(F.col("template")))
    return P.env_refs(t, "template", ["id"])


@register("text_of", """
SELECT doc_id, CAST(length(substr(text, 1, 8000)) AS INT) AS chars, sha256(substr(text, 1, 8000)) AS text_sha
FROM documents""", "F21")
def q_text_of(spark, sf):
    d = table(spark, sf, "documents")
    t = S.text_of("text", 8000)
    return d.select("doc_id", F.length(t).alias("chars"), F.sha2(t, 256).alias("text_sha"))


@register("word_fanout", f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d)
SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS chars,
    arg_min(word, pos) AS first_word, arg_max(word, pos) AS last_word
FROM x GROUP BY doc_id""", "F22")
def q_word_fanout(spark, sf):
    d = table(spark, sf, "documents")
    w = P.word_fanout(d, "doc_id", "text")
    # texts in an aggregate make Spark sort all words of a task; as grouping keys they do not, so the words at
    # the ends of a text are told apart by key first, which leaves three rows of a text
    end = (F.col("pos") == 0) | (F.col("pos") == F.col("last_pos"))
    parts = w.groupBy("doc_id", F.when(end, F.col("pos")).alias("end_pos"), F.when(end, F.col("word")).alias("end_word")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("word")).alias("chars"))
    return parts.groupBy("doc_id").agg(F.sum("n").alias("n_words"), F.sum("chars").cast("long").alias("chars"),
                                       F.min_by("end_word", "end_pos").alias("first_word"),
                                       F.max_by("end_word", "end_pos").alias("last_word"))


CRON_SPARK = """CASE pmod(p_partkey, 8)
    WHEN 0 THEN concat(CAST(p_size % 60 AS STRING), ' ', CAST(p_partkey % 24 AS STRING), ' * * *')
    WHEN 4 THEN concat(CAST(p_size % 60 AS STRING), ' ', CAST(p_partkey % 24 AS STRING), ' * * *')
    WHEN 1 THEN concat('*/15 ', CAST(p_partkey % 24 AS STRING), ' * * *')
    WHEN 5 THEN concat('*/15 ', CAST(p_partkey % 24 AS STRING), ' * * *')
    WHEN 2 THEN '0 9 * * MON-FRI'
    WHEN 6 THEN '30 6 1,15 jan-dec Sun'
    ELSE concat('bad ', p_name) END"""
CRON_START, CRON_END, CRON_NOW = "2024-01-01 00:00:00", "2024-01-08 00:00:00", "2024-01-03 10:20:00"

CRON_FIRES_SQL = """
WITH p AS (SELECT p_partkey, p_size, p_partkey % 8 AS t FROM part),
d AS (SELECT CAST(range AS TIMESTAMP) AS day FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-08', INTERVAL 1 DAY)),
q AS (SELECT * FROM (VALUES (0), (15), (30), (45)) x(q)),
f AS (
    SELECT p_partkey, day + to_hours(p_partkey % 24) + to_minutes(p_size % 60) AS fire_at FROM p, d WHERE t IN (0, 4)
    UNION ALL SELECT p_partkey, day + to_hours(p_partkey % 24) + to_minutes(q) FROM p, d, q WHERE t IN (1, 5)
    UNION ALL SELECT p_partkey, day + to_hours(9) FROM p, d WHERE t = 2 AND dayofweek(day) BETWEEN 1 AND 5
    UNION ALL SELECT p_partkey, day + to_hours(6) + to_minutes(30) FROM p, d
        WHERE t = 6 AND (day(day) IN (1, 15) OR dayofweek(day) = 0))
"""


def _cron(spark, sf):
    from ..functions import cron as C
    p = table(spark, sf, "part").select("p_partkey", F.expr(CRON_SPARK).alias("cron"))
    return C.cron_expand(p, "p_partkey", "cron", CRON_START, CRON_END)


@register("cron_expand", CRON_FIRES_SQL + "SELECT p_partkey, fire_at FROM f", "F18")
def q_cron_expand(spark, sf):
    return _cron(spark, sf)[0]


@register("cron_next", CRON_FIRES_SQL + f"""
SELECT p_partkey, min(fire_at) AS next_fire,
    (epoch_us(min(fire_at)) - epoch_us(TIMESTAMP '{CRON_NOW}')) / 1e6 AS delay_s
FROM f WHERE fire_at > TIMESTAMP '{CRON_NOW}' GROUP BY p_partkey""", "F18")
def q_cron_next(spark, sf):
    from ..functions import cron as C
    p = table(spark, sf, "part").select("p_partkey", F.expr(CRON_SPARK).alias("cron"))
    return C.next_fire(p, "p_partkey", "cron", CRON_NOW)


@register("cron_invalid", "SELECT p_partkey, concat('bad ', p_name) AS cron FROM part WHERE p_partkey % 8 IN (3, 7)",
          "F18")
def q_cron_invalid(spark, sf):
    return _cron(spark, sf)[1]
