"""Event-time timers (T6, T7): against brute force, and alike for one drop and for several."""

from runlens.plans.queries_streaming import barrier, deadlines
from runlens.streaming import streams as T

SF = "/root/testdata/sf0.001"


def _rows(spark):
    ev = T.with_event_time(spark.read.parquet(f"{SF}/events.parquet"))
    p = ev.select("run_id", "event_id", "event_type", "ts").toPandas()
    p["ms"] = p.ts.astype("int64") // {"datetime64[ns]": 10 ** 6, "datetime64[us]": 1000}[str(p.ts.dtype)]
    return p.sort_values(["ms", "event_id"])


def _barriers(p):
    out = {}
    for run, g in p[(p.event_id % 7) < 3].groupby("run_id"):
        got = {}
        for ms, i, kind in zip(g.ms, g.event_id, g.event_type):
            if ms > g.ms.iloc[0] + 6 * 3_600_000:
                break
            got[i % 7] = "ok" if kind in ("click", "purchase") else "failed" if kind == "error" else "skipped"
            if len(got) == 3:
                break
        s = [got.get(k, "skipped") for k in range(3)]
        out[run] = (s.count("ok"), s.count("failed"), s.count("skipped"), "complete" if len(got) == 3 else "timeout")
    return out


def test_stream_barrier_matches_brute_force_for_any_number_of_drops(spark):
    want = _barriers(_rows(spark))
    assert {v[3] for v in want.values()} == {"complete", "timeout"} or len(want) > 20
    for n in (1, 4):
        rows = barrier(spark, SF, n).collect()
        assert len(rows) == len(want)   # one row per key
        assert {r.thread_id: (r.ok, r.failed, r.skipped, r.fired) for r in rows} == want


def test_deadline_monitor_matches_brute_force_for_any_number_of_drops(spark):
    want = {}
    for run, g in _rows(spark).groupby("run_id"):
        end = g.ms[g.event_type == "purchase"].min()
        if not end < g.ms.min() + 2 * T.DAY_MS:
            want[run] = int(g.ms.min())
    for n in (1, 4):
        rows = deadlines(spark, SF, n).collect()
        assert len(rows) == len(want) and {r.run_id: r.started_ms for r in rows} == want
