"""Cron expansion, user-function maps and a resumed stream on small inputs."""

from pyspark.sql import functions as F

from runlens.functions import cron as C
from runlens.functions import samples
from runlens.operators import udf as X
from runlens.streaming import streams as T


def test_cron_fields_and_day_rule(spark):
    t = spark.createDataFrame([(1, "*/20 9 * * *"), (2, "0 0 1,15 * 0"), (3, "61 * * * *"), (4, "0 7 * *")],
                              "id int, cron string")
    fires, invalid = C.cron_expand(t, "id", "cron", "2024-01-01 00:00:00", "2024-01-16 00:00:00")
    got = {}
    for r in fires.collect():
        got.setdefault(r.id, []).append(r.fire_at.strftime("%d %H:%M"))
    assert sorted(got[1])[:3] == ["01 09:00", "01 09:20", "01 09:40"] and len(got[1]) == 45
    # day of month 1 or 15, or any Sunday (Jan 7, Jan 14)
    assert sorted(got[2]) == ["01 00:00", "07 00:00", "14 00:00", "15 00:00"]
    assert sorted(r.id for r in invalid.collect()) == [3, 4]
    far = spark.createDataFrame([(1, "@daily"), (2, "0 12 29 FEB *"), (3, "0 0 30 2 *"), (4, "15 8 * * tue,sat"), (5, "bad")],
                                "id int, cron string")
    nxt = {r.id: r.next_fire and str(r.next_fire) for r in C.next_fire(far, "id", "cron", "2025-01-01 00:00:00").collect()}
    assert nxt == {1: "2025-01-02 00:00:00", 2: "2028-02-29 12:00:00", 3: None, 4: "2025-01-04 08:15:00"}
    nxt = C.next_delay(fires, "id", "2024-01-01 09:10:00").where("id = 1").first()
    assert nxt.delay_s == 600.0


def test_map_items_skip_and_fail(spark):
    df = spark.createDataFrame([(1, ["ab", "c", "x1", "def"])], "id int, items array<string>")
    skip = X.map_items(df, "id", "items", samples.word_len, "long", "skip").first()
    assert skip.results == [2, None, 3] and skip["count"] == 3 and skip.errors[0].idx == 2
    fail = X.map_items(df, "id", "items", samples.word_len, "long", "fail").first()
    assert fail.status == "failed" and "digit" in fail.error
    nulls = spark.createDataFrame([(1, ["ab", None]), (1, ["abc"]), (2, None)], "id int, items array<string>")
    got = sorted((r.id, r["items"], r["count"], len(r.errors)) for r in X.map_items(
        nulls, "id", "items", lambda w: len(w), "long", "skip").collect())
    assert got == [(1, 1, 1, 0), (1, 2, 1, 1), (2, 0, 0, 0)]  # a null item is run; equal keys stay apart


def test_resumed_stream_equals_batch(spark):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    landed = T.replay([T.drops(ev, "ts", 3)], T.interval_ticks, "update", "t")
    got = {(r.window_start, r.events) for r in T.latest(landed, ["window_start", "window_end"]).collect()}
    batch = ev.groupBy(F.window(F.col("ts").cast("timestamp"), "15 minutes").alias("w")).count()
    exp = {(r.w.start, r["count"]) for r in batch.collect()}
    assert got == exp


def test_drops_keep_rows_without_a_time(spark):
    df = spark.createDataFrame([(i if i % 5 else None,) for i in range(40)], "ts long")
    assert sum(d.count() for d in T.drops(df, "ts", 4)) == 40


def test_appended_stream_survives_a_crash_between_data_and_ledger(spark):
    from runlens.plans.queries_streaming import append_stream
    want = sorted(r.event_id for r in spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id").collect())
    for fail_at in (None, 2):
        rows = append_stream(spark, "/root/testdata/sf0.001", fail_at).collect()
        assert sorted(r.event_id for r in rows) == want and all(r.event_date == r.ts.date() for r in rows)


def test_cron_text_is_parsed_once_in_few_steps(spark):
    t = spark.createDataFrame([(1, "*/20 9 * * *"), (1, "5 8 * * *"), (2, "0 0 30 2 *"), (2, "0 0 31 4 *"), (3, "x"), (4, None),
                               (5, "5-1 * * * *"), (6, "1-9/4,3 0 * * *"), (7, "7/20 0 * * *"), (8, "0/0 * * * *"), (9, "99999999999 * * * *"),
                               (10, "59 23 3 1 *")], "id int, cron string")
    # the parts of a field used to be cut again for every use, the field for every use of its set
    plan = t.select(C.parse_cron(F.col("cron")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("rlike") + plan.count("RLIKE") + plan.count("regexp") <= 60
    fires, invalid = C.cron_expand(t, "id", "cron", "2024-01-01 00:00:00", "2024-01-02 00:00:00")
    got = {}
    for r in fires.collect():
        got.setdefault(r.id, set()).add(r.fire_at.strftime("%d %H:%M"))
    assert got == {1: {"01 09:00", "01 09:20", "01 09:40", "01 08:05"}, 6: {"01 00:01", "01 00:03", "01 00:05", "01 00:09"},
                   7: {"01 00:07", "01 00:27", "01 00:47"}}
    assert sorted(r.id for r in invalid.collect()) == [3, 4, 5, 8, 9]
    nxt = sorted((r.id, str(r.next_fire), r.delay_s) for r in C.next_fire(t, "id", "cron", "2024-01-03 23:58:30").collect())
    # one row for a key that fires, rows that never fire stay apart
    assert nxt == [(1, "2024-01-04 08:05:00", 29190.0), (2, "None", None), (2, "None", None), (6, "2024-01-04 00:01:00", 150.0),
                   (7, "2024-01-04 00:07:00", 510.0), (10, "2024-01-03 23:59:00", 30.0)]


def test_map_items_gives_results_back_in_stretches(spark, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(X, "MAP_ITEMS", 4)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([["a"] * 3, ["b"], None, ["c"] * 9, [], ["d"]])], names=["k", "l"])
    assert [p.num_rows for p in X._row_slices(batch, 1)] == [3, 1, 2]
    assert [p.column(0).to_pylist() for p in X._row_slices(batch.slice(1), 1)] == [[1, 2], [3], [4, 5]]
    df = spark.createDataFrame([(i, ["w" * (i % 5 + 1)] * (i % 7)) for i in range(60)], "id int, items array<string>")
    got = {r.id: (r["items"], r["count"], r.results) for r in X.map_items(df, "id", "items", samples.word_len, "long").collect()}
    assert got == {i: (i % 7, i % 7, [None if i % 5 == 0 else i % 5 + 1] * (i % 7)) for i in range(60)}
