"""Registered queries: streaming operators.

Each query gets the events table as several drops in event-time order; after
each drop it starts from its checkpoint in the shared folder, catches up and
stops.  The result is the landed table, folded by the operator's batch step.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..sources import sinks as K
from ..sources.tables import table
from ..streaming import streams as T
from .registry import register

N_DROPS = 4
EVENTS_K = "(SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events)"
RUN_ID_SQL = "concat('t', CAST(user_id AS VARCHAR), '-w', CAST(CAST(floor((day(ts) - 1) / 7) AS INT) AS VARCHAR))"


def _events(spark, sf):
    return table(spark, sf, "events")


def _drops(df, n=N_DROPS):
    return T.drops(df, "ts", n)


def _ntz(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def _closing(ev, **over):
    """A drop with one far-future row, which moves the watermark past every real event."""
    far = ev.limit(1).withColumn("ts", F.lit("2100-01-01 00:00:00").cast("timestamp_ntz")) \
        .withColumn("event_id", F.lit(10 ** 12).cast("long")).withColumn("user_id", F.lit(-1).cast("long"))
    for k, v in over.items():
        far = far.withColumn(k, F.lit(v))
    return far


@register("live_run_report", f"""
SELECT {RUN_ID_SQL} AS run_id, count(*) AS events, min(ts) AS started, max(ts) AS last_seen,
    CAST(count_if(event_type = 'error') AS BIGINT) AS errors,
    CAST(count_if(event_type = 'purchase') AS BIGINT) AS finished_nodes,
    CAST(sum(k * 10) AS BIGINT) AS tokens, arg_max(event_type, event_id) AS last_type
FROM {EVENTS_K} e GROUP BY 1""", "T1")
def q_live_run_report(spark, sf):
    landed = T.replay([_drops(_events(spark, sf))], T.live_run_report, "update", "live-report")
    return _ntz(T.run_reports(landed), "started", "last_seen")


TICKS_SQL = """
SELECT time_bucket(INTERVAL 15 MINUTES, ts) AS window_start,
    time_bucket(INTERVAL 15 MINUTES, ts) + INTERVAL 15 MINUTES AS window_end,
    count(*) AS events, CAST(count_if(event_type = 'error') AS BIGINT) AS errors
FROM events GROUP BY 1"""


@register("interval_ticks", TICKS_SQL, "T2")
def q_interval_ticks(spark, sf):
    landed = T.replay([_drops(_events(spark, sf))], T.interval_ticks, "update", "ticks")
    return _ntz(T.latest(landed, ["window_start", "window_end"]), "window_start", "window_end")


@register("watchdog", f"""
WITH t AS ({TICKS_SQL})
SELECT window_start, window_end, events, errors,
    concat('errors ', CAST(errors AS VARCHAR), ' of ', CAST(events AS VARCHAR)) AS status, 'slack' AS channel,
    CAST(json_object('text', concat('errors ', CAST(errors AS VARCHAR), ' of ', CAST(events AS VARCHAR))) AS VARCHAR)
        AS payload
FROM t WHERE errors / events > 0.3""", "T3")
def q_watchdog(spark, sf):
    ev = _events(spark, sf)
    landed = T.replay([[*_drops(ev), _closing(ev)]], lambda s: T.watchdog(T.interval_ticks(s), 0.3), "append", "watchdog")
    return _ntz(landed.drop("batch_id"), "window_start", "window_end").where("window_start < '2099-01-01'")


@register("dedup_replay", "SELECT event_id, user_id, event_type FROM events", "T4")
def q_dedup_replay(spark, sf):
    ev = _events(spark, sf)
    landed = T.replay([_drops(ev.unionByName(ev))], lambda s: T.dedup_replay(s, ["event_id"], "1 hour")
                      .select("event_id", "user_id", "event_type"), "append", "dedup")
    return landed.select("event_id", "user_id", "event_type")


WRITES_SQL = f"""
SELECT concat('t', CAST(user_id AS VARCHAR)) AS thread_id, concat('c', CAST(event_id % 4 AS VARCHAR)) AS channel,
    ts, event_id AS seq, CAST(k * 10 AS BIGINT) AS value, concat('n', CAST(event_id % 7 AS VARCHAR)) AS map_key,
    CASE WHEN event_id % 2 = 0 THEN [CAST(k * 10 AS BIGINT), CAST(k AS BIGINT)] ELSE [CAST(k * 10 AS BIGINT)] END AS elements
FROM {EVENTS_K} e WHERE event_type IN ('click', 'purchase')"""


def _writes(events):
    """Channel writes of raw events, batch or stream."""
    k = F.regexp_extract("props", r"([0-9]+)", 1).cast("long")
    return events.where(F.col("event_type").isin("click", "purchase")).select(
        F.col("ts").cast("timestamp").alias("event_time"), F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("thread_id"),
        F.concat(F.lit("c"), (F.col("event_id") % 4).cast("string")).alias("channel"),
        F.concat(F.lit("n"), (F.col("event_id") % 7).cast("string")).alias("map_key"), F.col("event_id").alias("seq"),
        (k * 10).alias("value"), F.when(F.col("event_id") % 2 == 0, F.array(k * 10, k)).otherwise(F.array(k * 10)).alias("elements"))


def fold(spark, sf, n_drops=N_DROPS):
    ev = _events(spark, sf)
    far, n = _closing(ev, event_type="click"), T.bucket_count(ev)
    landed = T.replay([[*_drops(ev, n_drops), far]], lambda s: T.stateful_fold(_writes(s), buckets=n), "append", "fold", keyed=True)
    return T.folded_contents(landed, _writes(ev))


@register("stateful_fold", f"""
WITH w AS ({WRITES_SQL}),
x AS (SELECT thread_id, channel, ts, seq, unnest(elements) AS value, generate_subscripts(elements, 1) AS i FROM w)
SELECT thread_id, channel, 'append' AS reducer, row_number() OVER (PARTITION BY thread_id, channel ORDER BY ts, seq) AS pos,
    NULL AS map_key, value FROM w
UNION ALL SELECT thread_id, channel, 'extend', row_number() OVER (PARTITION BY thread_id, channel ORDER BY ts, seq, i), NULL, value FROM x
UNION ALL SELECT thread_id, channel, 'merge_dict', NULL, map_key, arg_max(value, (ts, seq)) FROM w GROUP BY thread_id, channel, map_key
UNION ALL SELECT thread_id, channel, 'sum', NULL, NULL, CAST(sum(value) AS BIGINT) FROM w GROUP BY thread_id, channel
UNION ALL SELECT thread_id, channel, 'last', NULL, NULL, arg_max(value, (ts, seq)) FROM w GROUP BY thread_id, channel""", "T5")
def q_stateful_fold(spark, sf):
    return fold(spark, sf)


BARRIER_HOURS, RUN_DAYS = 6, 8
BARRIER_SQL = """
WITH e AS (SELECT {RUN_ID_SQL} AS thread_id, concat('n', CAST(event_id % 7 AS VARCHAR)) AS source, ts, event_id,
        CASE WHEN event_type IN ('click', 'purchase') THEN 'ok' WHEN event_type = 'error' THEN 'failed'
             ELSE 'skipped' END AS state FROM events),
a AS (SELECT *, min(epoch_ms(ts)) OVER (PARTITION BY thread_id) AS t0 FROM e WHERE source IN ('n0', 'n1', 'n2')),
i AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY epoch_ms(ts), event_id) AS pos
    FROM a WHERE epoch_ms(ts) <= t0 + 6 * 3600000),
f AS (SELECT thread_id, source, min(pos) AS first_pos FROM i GROUP BY thread_id, source),
c AS (SELECT thread_id, count(*) AS arrived, max(first_pos) AS done_pos FROM f GROUP BY thread_id),
l AS (SELECT i.thread_id, i.source, arg_max(i.state, i.pos) AS state, any_value(c.arrived) AS arrived
    FROM i JOIN c ON i.thread_id = c.thread_id WHERE c.arrived < 3 OR i.pos <= c.done_pos GROUP BY i.thread_id, i.source)
SELECT thread_id, CAST(sum(CASE WHEN state = 'ok' THEN 1 ELSE 0 END) AS BIGINT) AS ok,
    CAST(sum(CASE WHEN state = 'failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
    CAST(sum(CASE WHEN state = 'skipped' THEN 1 ELSE 0 END) + 3 - count(*) AS BIGINT) AS skipped,
    CASE WHEN any_value(arrived) = 3 THEN 'complete' ELSE 'timeout' END AS fired FROM l GROUP BY thread_id"""


def barrier(spark, sf, n_drops=N_DROPS):
    ev = _events(spark, sf)
    edges = spark.createDataFrame([("n0", "m"), ("n1", "m"), ("n2", "m")], "source string, merge string")
    expected = T.merge_sources(edges, "m")

    def arrivals(events):
        return T.with_event_time(events).select(
            F.col("run_id").alias("thread_id"), F.concat(F.lit("n"), (F.col("event_id") % 7).cast("string")).alias("source"),
            F.when(F.col("event_type").isin("click", "purchase"), "ok")
             .when(F.col("event_type") == "error", "failed").otherwise("skipped").alias("state"), "event_id", "event_time")

    n = T.bucket_count(ev)
    landed = T.replay([[*_drops(ev, n_drops), _closing(ev)]], lambda s: T.stream_barrier(
        arrivals(s), expected, BARRIER_HOURS * T.HOUR_MS, RUN_DAYS * T.DAY_MS, "1 hour", buckets=n), "append", "barrier", keyed=True)
    return T.barrier_states(landed, arrivals(ev), expected)


@register("stream_barrier", BARRIER_SQL.replace("{RUN_ID_SQL}", RUN_ID_SQL), "T6")
def q_stream_barrier(spark, sf):
    return barrier(spark, sf)


def deadlines(spark, sf, n_drops=N_DROPS):
    ev = _events(spark, sf)
    n = T.bucket_count(ev)
    landed = T.replay([[*_drops(ev, n_drops), _closing(ev)]], lambda s: T.deadline_monitor(
        s, 2 * T.DAY_MS, RUN_DAYS * T.DAY_MS, "1 hour", ["purchase"], buckets=n), "append", "deadline", keyed=True)
    return landed.where(~F.col("run_id").startswith("t-1")).drop("batch_id")


@register("deadline_monitor", f"""
WITH r AS (SELECT {RUN_ID_SQL} AS run_id, min(epoch_us(ts) // 1000) AS started_ms,
    min(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) // 1000 END) AS done_ms FROM events GROUP BY 1)
SELECT run_id, started_ms, started_ms + 172800000 AS deadline_ms FROM r
WHERE done_ms IS NULL OR done_ms >= started_ms + 172800000""", "T7")
def q_deadline_monitor(spark, sf):
    return deadlines(spark, sf)


GATE_CHOICES, GATE_HOURS = ["approve", "reject"], 48


@register("gate_join", f"""
WITH RECURSIVE e AS (
    SELECT concat('t', CAST(user_id AS VARCHAR)) AS thread_id, epoch_us(ts) // 1000 AS ms, event_type = 'view' AS answers,
        event_id AS id, CASE k % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'maybe' END AS answer
    FROM {EVENTS_K} x WHERE event_type IN ('signup', 'view')),
n AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY ms, answers, id) AS no FROM e),
s AS (SELECT DISTINCT thread_id, CAST(0 AS BIGINT) AS no, CAST([] AS STRUCT(ms BIGINT, id BIGINT)[]) AS queue,
        CAST(NULL AS BIGINT) AS gate_id, CAST(NULL AS BIGINT) AS answer_id, CAST(NULL AS VARCHAR) AS answer FROM e
    UNION ALL
    SELECT thread_id, no, CASE WHEN answers THEN live[2:] ELSE list_append(live, {{'ms': ms, 'id': id}}) END,
        CASE WHEN answers THEN live[1].id END, CASE WHEN answers THEN id END, CASE WHEN answers THEN answer END
    FROM (SELECT n.*, list_filter(s.queue, lambda g: g.ms + 172800000 >= n.ms) AS live
        FROM s JOIN n ON n.thread_id = s.thread_id AND n.no = s.no + 1) t),
g AS (SELECT e.id AS gate_id, e.thread_id, s.answer_id, s.answer FROM e LEFT JOIN s ON s.gate_id = e.id WHERE NOT e.answers)
SELECT gate_id, thread_id, answer_id,
    CASE WHEN answer IS NULL THEN 'open' WHEN answer IN ('approve', 'reject') THEN 'answered' ELSE 'error' END AS status,
    CASE WHEN answer IN ('approve', 'reject') THEN answer END AS answer,
    CASE WHEN answer IS NOT NULL AND answer NOT IN ('approve', 'reject')
         THEN concat('answer \'\'', answer, '\'\' is not one of the allowed choices') END AS error
FROM g""", "T8")
def q_gate_join(spark, sf):
    return gates(spark, sf)


def gates(spark, sf, n_drops=N_DROPS):
    ev = _events(spark, sf)
    n = T.bucket_count(ev)

    def build(asked, given):
        g = T.with_event_time(asked).select(F.col("event_id").alias("gate_id"), "thread_id", F.col("event_time").alias("gate_time"))
        a = T.with_event_time(given).select(
            F.col("event_id").alias("answer_id"), F.col("thread_id").alias("answer_thread"),
            F.col("event_time").alias("answer_time"), F.when(F.col("k") % 3 == 0, "approve")
            .when(F.col("k") % 3 == 1, "reject").otherwise("maybe").alias("answer"))
        return T.gate_join(g, a, GATE_HOURS * T.HOUR_MS, "1 hour", n)

    # both sources arrive by the same stretches of event time
    parts = _drops(ev, n_drops)
    sides = [[*[p.where(F.col("event_type") == t) for p in parts], _closing(ev, event_type=t)] for t in ("signup", "view")]
    landed = T.replay(sides, build, "append", "gates", keyed=True).where(F.col("thread_id") != "t-1")
    return T.gate_results(landed, GATE_CHOICES)


@register("resumable_run", TICKS_SQL, "T9")
def q_resumable_run(spark, sf):
    """The intervals of T2 over input in twice as many drops: restarts do not show in the result."""
    landed = T.replay([_drops(_events(spark, sf), 2 * N_DROPS)], T.interval_ticks, "update", "resume")
    return _ntz(T.latest(landed, ["window_start", "window_end"]), "window_start", "window_end")


@register("append_events_stream", "SELECT event_id, user_id, event_type, ts, CAST(ts AS DATE) AS event_date FROM events", "S3")
def q_append_events_stream(spark, sf):
    return append_stream(spark, sf)


def append_stream(spark, sf, fail_at=None):
    """The events in drops, appended by a stream that starts anew for each; one that fails is started again."""
    ev = _events(spark, sf).select("event_id", "user_id", "event_type", "ts")
    source, path, checkpoint = (K.scratch_path(spark, f"append-{k}") for k in ("in", "out", "ckpt"))
    left = [fail_at]

    def crash(batch_id: int) -> None:
        if batch_id == left[0]:
            left[0] = None
            raise RuntimeError("lost between data and ledger")
    for i, part in enumerate(_drops(ev)):
        part.write.mode("overwrite").parquet(f"{source}/b{i:04d}")
        while True:
            try:
                K.append_stream(T.file_stream(spark, source, ev.schema), path, checkpoint, before_commit=crash).awaitTermination()
                break
            except StreamingQueryException:
                if fail_at is None:
                    raise
    return K.read_appended(spark, path, ev.schema)
