"""Keyed processors work on buckets of keys (T5-T8): the number of buckets shows neither in results nor across restarts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from runlens.plans import queries_streaming as Q
from runlens.streaming import streams as T

START = dt.datetime(2024, 1, 1)
MS0 = int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


def _events(spark, types, n=400, users=60, hours=160):
    r = random.Random(7)
    rows = [(i, START + dt.timedelta(seconds=r.randrange(hours * 3600)), r.randrange(users), r.choice(types), 1.0,
             '{"k": %d}' % r.randrange(50)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
                                             "props string").coalesce(2)


def _ms(ts):
    return MS0 + (ts - START) // dt.timedelta(milliseconds=1)


def test_deadlines_of_all_runs_of_a_bucket(spark):
    rows, ev = _events(spark, ["view", "purchase"])
    landed = T.replay([[*Q._drops(ev, 2), Q._closing(ev)]], lambda s: T.deadline_monitor(
        s, T.DAY_MS, 30 * T.DAY_MS, "1 hour", ["purchase"], buckets=3), "append", "t", keyed=True)
    runs = {}
    for _, ts, user, kind, *_ in rows:
        runs.setdefault(f"t{user}-w{(ts.day - 1) // 7}", []).append((_ms(ts), kind))
    want = {}
    for run, got in runs.items():
        start, ends = min(got)[0], [m for m, kind in got if kind == "purchase"]
        if not ends or min(ends) >= start + T.DAY_MS:
            want[run] = start
    got = landed.where("run_id NOT LIKE 't-1%'").collect()
    assert {r.run_id: r.started_ms for r in got} == want and len(got) == len(want) > 10


def test_gates_of_all_threads_of_a_bucket(spark):
    rows, ev = _events(spark, ["signup", "view"], users=30)

    def side(stream, kind, names):
        e = T.with_event_time(stream).where(F.col("event_type") == kind)
        return e.select(F.col("event_id").alias(names[0]), F.col("thread_id").alias(names[1]), F.col("event_time").alias(names[2]),
                        *([F.lit("yes").alias("answer")] if kind == "view" else []))
    parts = Q._drops(ev, 2)
    landed = T.replay(
        [[*parts, Q._closing(ev, event_type="signup")], [*parts, Q._closing(ev, event_type="view")]],
        lambda g, a: T.gate_join(side(g, "signup", ["gate_id", "thread_id", "gate_time"]),
                                 side(a, "view", ["answer_id", "answer_thread", "answer_time"]), T.DAY_MS, "1 hour", 3),
        "append", "t", keyed=True)
    want, queues = {}, {}
    for ms, kind, ident, user in sorted((_ms(r[1]), r[3] == "view", r[0], r[2]) for r in rows):
        queue = queues.setdefault(user, [])
        while queue and queue[0][0] + T.DAY_MS < ms:
            queue.pop(0)
        if not kind:
            want[ident] = None
            queue.append((ms, ident))
        elif queue:
            want[queue.pop(0)[1]] = ident
    got = landed.where("thread_id != 't-1'").collect()
    assert {r.gate_id: r.answer_id for r in got} == want and len(got) == len(want)
    assert any(want.values()) and None in want.values()


def test_offsets_of_all_channels_of_a_bucket(spark):
    rows, ev = _events(spark, ["click", "purchase"], users=12)
    landed = T.replay([[*Q._drops(ev, 3), Q._closing(ev, event_type="click")]], lambda s: T.stateful_fold(
        Q._writes(s), buckets=3), "append", "t", keyed=True)
    want = {}
    for i, _, user, _, _, props in rows:
        n, total = want.get((f"t{user}", f"c{i % 4}"), (0, 0))
        want[f"t{user}", f"c{i % 4}"] = n + 1, total + 10 * int(props[6:-1])
    got = landed.where("thread_id != 't-1'").groupBy("thread_id", "channel").agg(
        F.max_by(F.struct("writes", "total"), "part").alias("s"), F.sum(F.col("writes") - F.col("writes_before")).alias("n")).collect()
    assert {(r.thread_id, r.channel): tuple(r.s) for r in got} == want
    assert all(r.n == r.s.writes for r in got)


def test_barriers_of_all_threads_of_a_bucket(spark):
    rows, ev = _events(spark, ["view"], n=300, users=40)
    rows = [r for r in rows if r[0] % 4 < 2]

    def arrivals(e):
        return T.with_event_time(e).select("thread_id", F.concat(F.lit("n"), (F.col("event_id") % 4).cast("string")).alias("source"),
                                           "event_id", "event_time")
    landed = T.replay([[*Q._drops(ev, 2), Q._closing(ev)]], lambda s: T.stream_barrier(
        arrivals(s), ["n0", "n1"], T.DAY_MS, 30 * T.DAY_MS, "1 hour", buckets=3), "append", "t", keyed=True)
    threads = {}
    for i, ts, user, *_ in rows:
        threads.setdefault(f"t{user}", []).append((_ms(ts), i))
    want = {}
    for thread, got in threads.items():
        start = min(got)[0]
        firsts = [min((a for a in got if a[1] % 4 == k and a[0] <= start + T.DAY_MS), default=None) for k in (0, 1)]
        want[thread] = ("timeout", start + T.DAY_MS) if None in firsts else ("complete", max(firsts)[0])
    got = landed.where("thread_id != 't-1'").collect()
    assert {r.thread_id: (r.fired, r.upto_ms) for r in got} == want and len(got) == len(want)
    assert {w[0] for w in want.values()} == {"complete", "timeout"}


def test_the_number_of_buckets_follows_the_events(spark):
    assert T.bucket_count(spark.range(10)) == T.BUCKETS
    assert T.bucket_count(spark.range(T.BUCKET_ROWS * 100 + 1)) == 101
