"""Keyed stream state (T5, T8) and hot keys: contents equal the batch reducers, answers are taken once."""

import pytest
from pyspark.sql import functions as F

from runlens.operators import state as B
from runlens.plans import queries_streaming as Q
from runlens.streaming import streams as T

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("drops", [1, 3])
def test_fold_contents_equal_the_batch_reducers(spark, drops):
    got = Q.fold(spark, SF, drops).collect()
    w = Q._writes(spark.read.parquet(f"{SF}/events.parquet"))
    keys = ("thread_id", "channel")
    append = {(r.thread_id, r.channel, r.pos, r.value) for r in B.reduce_append(w, keys).collect()}
    extend = {(r.thread_id, r.channel, r.pos, r.value) for r in B.reduce_extend(w, keys).collect()}
    merged = {(r.thread_id, r.channel, r.key, r.value) for r in B.reduce_merge_map(w, keys).collect()}
    last = {(r.thread_id, r.channel, r.value) for r in B.reduce_last(w, keys).collect()}
    total = {(r.thread_id, r.channel, r.value) for r in B.reduce_sum(w, keys).collect()}

    def of(kind, *cols):
        rows = [tuple(r[c] for c in ("thread_id", "channel", *cols)) for r in got if r.reducer == kind]
        assert len(rows) == len(set(rows))
        return set(rows)
    assert of("append", "pos", "value") == append and of("extend", "pos", "value") == extend
    assert of("merge_dict", "map_key", "value") == merged and of("last", "value") == last and of("sum", "value") == total


def _gates(rows, within):
    """(gate, answer) by a plain queue."""
    out, queue = {}, {}
    for ms, kind, ident, thread, answer in sorted(rows):
        q = queue.setdefault(thread, [])
        if kind == 0:
            out[ident] = None
            q.append((ms, ident))
        else:
            while q and q[0][0] + within < ms:
                q.pop(0)
            if q:
                out[q.pop(0)[1]] = ident
    return out


def test_gates_take_each_answer_once_for_any_number_of_drops(spark):
    ev = T.with_event_time(spark.read.parquet(f"{SF}/events.parquet")).where("event_type IN ('signup', 'view')")
    rows = [(r.ms, int(r.event_type == "view"), r.event_id, r.thread_id, "") for r in
            ev.withColumn("ms", T._millis("event_time")).collect()]
    want = _gates(rows, Q.GATE_HOURS * T.HOUR_MS)
    for n in (1, 4):
        got = Q.gates(spark, SF, n).collect()
        assert {r.gate_id: r.answer_id for r in got} == want and len(got) == len(want)
        used = [r.answer_id for r in got if r.answer_id is not None]
        assert len(used) == len(set(used)) > 0


def test_hot_keys_send_one_row_per_window(spark, tmp_path):
    # one run holds two thirds of 30,000 events within two days
    ev = spark.range(30_000).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 5)").alias("ts"),
        F.when(F.col("id") % 3 < 2, F.lit(1)).otherwise(F.col("id") % 50 + 2).cast("long").alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"))
    landed = T.replay([[ev, Q._closing(ev)]], lambda s: T.deadline_monitor(
        s, T.HOUR_MS, 10 * T.DAY_MS, "1 hour", ["purchase"]), "append", "hot", keyed=True)
    rows = landed.where("run_id NOT LIKE 't-1%'").collect()
    assert len(rows) == 51 and {r.run_id for r in rows} == {f"t{u}-w0" for u in range(1, 52)}
    per = T.with_event_time(ev).where("thread_id = 't1'").groupBy(F.window("event_time", "1 hour")).count()
    assert per.count() <= 42   # what the timer of the hot run got: a row per window
