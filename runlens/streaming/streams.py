"""Structured Streaming operators.

Sources are file streams (parquet) so every query can be replayed from its
checkpoint; sinks write a folder per batch id, overwritten if the batch is
replayed, so a restarted query lands on the same table.  Event time is the
event ``ts`` cast to TIMESTAMP (watermarks reject TIMESTAMP_NTZ).

State is bounded by event time everywhere: totals are kept per key and window
and leave the state once the watermark has passed it; the batch step that goes
with each operator folds what has landed.  Folds and timers (T5-T7) are two
chained stateful operators: a streaming aggregate per key and window, combined
map-side, and behind it a keyed processor that gets one row per window, source
and key, however hot the key is.  Timers keep what they have decided until a run
cannot get any more events.

Keyed processors (T5-T8) work on buckets of keys: a call into Python and a trip to
the state store cost the same for one key as for thousands.  The state of a
bucket's keys is one Arrow table, read and written once a batch, with one timer.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager, nullcontext

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StructField, StructType

from ..plans.ordered import _WITHIN, Slices, plan_slices, with_slice
from ..sources.sinks import outbox_payloads, scratch_path

DAY_MS = 86_400_000
HOUR_MS = 3_600_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 64                # buckets of keys at least
BUCKET_ROWS = 50_000        # events that a bucket is meant for, about


# ------------------------------------------------------------------ drops and tables

def drops(df: DataFrame, order: str, n: int) -> list[DataFrame]:
    """``df`` cut into ``n`` consecutive stretches of ``order``; rows without a value go last."""
    plan = Slices(plan_slices(df, [order], n).bounds)
    no = F.when(F.col(order).isNull(), n - 1).otherwise(F.least(F.floor(F.col("_rl_slice") / _WITHIN), F.lit(n - 1)))
    sliced = with_slice(df, [order], plan)
    return [sliced.where(no == i).drop("_rl_slice") for i in range(n)]


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(f"{path}/b*")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Keyed processors need the RocksDB state store; the session's own choice comes back afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_to_table(df: DataFrame, mode: str, out: str, checkpoint: str) -> None:
    """Process everything that has arrived, then stop.  Each batch writes its own folder of the table."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def replay(inputs: Sequence[Sequence[DataFrame]], build: Callable[..., DataFrame], mode: str, name: str,
           keyed: bool = False) -> DataFrame:
    """Input that arrives in drops; after each drop the query starts from its checkpoint, catches
    up and stops.  ``inputs`` holds the drops of every source, ``build`` makes the query from
    one stream per source; ``keyed`` says that it has keyed state.  Returns the landed rows with their ``batch_id``.
    """
    spark = inputs[0][0].sparkSession
    paths = [scratch_path(spark, f"{name}-in{k}") for k in range(len(inputs))]
    out, checkpoint = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    schema = None
    for i in range(max(map(len, inputs))):
        for path, some in zip(paths, inputs):
            if i < len(some):
                some[i].write.mode("overwrite").parquet(f"{path}/b{i:04d}")
        df = build(*[file_stream(spark, p, some[0].schema) for p, some in zip(paths, inputs)])
        schema = StructType([*df.schema.fields, StructField("batch_id", IntegerType())])
        with keyed_state(spark) if keyed else nullcontext():
            run_to_table(df, mode, out, checkpoint)
    return spark.read.schema(schema).parquet(f"{out}/batch=*")


def latest(landed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest landed row of every key of an update-mode table."""
    rest = [c for c in landed.columns if c not in (*keys, "batch_id")]
    top = landed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r"))
    return top.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


# ------------------------------------------------------------------ event shaping

def with_event_time(events: DataFrame) -> DataFrame:
    """Event time, run and thread ids of raw events (all columns a stream can compute per row)."""
    return events.select(
        "*", F.col("ts").cast("timestamp").alias("event_time"),
        F.concat(F.lit("t"), F.col("user_id").cast("string")).alias("thread_id"),
        F.concat(F.lit("t"), F.col("user_id").cast("string"), F.lit("-w"),
                 F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").cast("string")).alias("run_id"),
        F.regexp_extract("props", r"([0-9]+)", 1).try_cast("int").alias("k"))


def _millis(ts: str) -> Column:
    return F.floor(F.unix_micros(ts) / 1000).cast("long")


# ------------------------------------------------------------------ T1-T4, T8

def live_run_report(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """A report per run and day, kept current while events arrive (algebraic aggregates only)."""
    e = with_event_time(stream).withWatermark("event_time", delay)
    return e.groupBy("run_id", F.window("event_time", "1 day").alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.min("event_time").alias("started"),
        F.max("event_time").alias("last_seen"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.count_if(F.col("event_type") == "purchase").alias("finished_nodes"),
        F.sum(F.col("k") * 10).cast("long").alias("tokens"),
        F.max(F.struct("event_id", "event_type")).alias("last"))


def run_reports(landed: DataFrame) -> DataFrame:
    """The report of each run so far, from the landed days of T1."""
    d = latest(landed, ["run_id", "day"])
    return d.groupBy("run_id").agg(
        F.sum("events").alias("events"), F.min("started").alias("started"), F.max("last_seen").alias("last_seen"),
        F.sum("errors").cast("long").alias("errors"), F.sum("finished_nodes").cast("long").alias("finished_nodes"),
        F.sum("tokens").cast("long").alias("tokens"), F.max("last").getField("event_type").alias("last_type"))


def interval_ticks(stream: DataFrame, every: str = "15 minutes", delay: str = "1 hour") -> DataFrame:
    """One row per fixed interval of event time with event and error counts; intervals leave the
    state once the watermark has passed them."""
    e = with_event_time(stream).withWatermark("event_time", delay)
    g = e.groupBy(F.window("event_time", every).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", "errors")


def watchdog(ticks: DataFrame, max_error_rate: float) -> DataFrame:
    """Per interval a status: ``ok`` or an alert text; only alerts go to the outbox.  In append mode
    an interval is judged once, when it is over."""
    rate = F.col("errors") / F.col("events")
    alert = F.concat(F.lit("errors "), F.col("errors").cast("string"), F.lit(" of "),
                     F.col("events").cast("string"))
    t = ticks.withColumn("status", F.when(rate > max_error_rate, alert).otherwise(F.lit("ok")))
    alerts = t.where(F.col("status") != "ok")
    return outbox_payloads(alerts, "slack", {"message": F.col("status")})


def dedup_replay(stream: DataFrame, keys: Sequence[str], delay: str) -> DataFrame:
    """T4: stored and live rows merged without repeats of ``keys``; a key is kept for ``delay``."""
    e = with_event_time(stream).withWatermark("event_time", delay)
    return e.dropDuplicatesWithinWatermark(list(keys))


def bucket_count(events: DataFrame) -> int:
    """Buckets of keys for a stream of about as many events; fixed for the life of a checkpoint."""
    return max(BUCKETS, -(-events.count() // BUCKET_ROWS))


def _by_bucket(rows: DataFrame, keys: Sequence[str], buckets: int):
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).groupBy("bucket")


class _Bucket(StatefulProcessor):
    """All keys of a bucket at once.  ``take`` gets the rows kept for them, the new rows and the watermark; it returns
    what comes out, the rows to keep and the time at which it must be called again (or None)."""

    INPUT: Sequence[str] = ()
    OUTPUT = ""
    KEPT: pa.Schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "due long, rows binary")

    def take(self, kept: list[tuple], new: list[tuple], now: int) -> tuple[list[tuple], list[tuple], int | None]:
        raise NotImplementedError

    def _step(self, new: list[tuple], now: int, expired: int | None = None) -> Iterator[pd.DataFrame]:
        due, packed = self.kept.get() if self.kept.exists() else (None, None)
        kept = [] if packed is None else list(zip(*(c.to_pylist() for c in pa.ipc.open_stream(bytes(packed)).read_all().columns)))
        out, rows, at = self.take(kept, new, now)
        at = None if at is None else max(at, now + 1)
        if due is not None and due not in (at, expired):
            self.handle.deleteTimer(due)
        if at is not None and (at != due or due == expired):
            self.handle.registerTimer(at)
        if rows:
            table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), self.KEPT)], schema=self.KEPT)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.KEPT) as writer:
                writer.write_table(table)
            self.kept.update((at, sink.getvalue().to_pybytes()))
        elif packed is not None:
            self.kept.clear()
        if out:
            made = pd.DataFrame(out, columns=[c.split()[0] for c in self.OUTPUT.split(", ")])
            yield made.astype({c.split()[0]: "Int64" for c in self.OUTPUT.split(", ") if c.endswith(" long")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for pdf in rows for r in zip(*(pdf[c].tolist() for c in self.INPUT))]
        yield from self._step(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step([], timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def _whole(value) -> int | None:
    """A long of a pandas column, where nulls make floats of the others."""
    return None if value is None or value != value else int(value)


GATES_OUT = "gate_id long, thread_id string, answer_id long, answer string"
_WAITING_GATE, _WAITING_ANSWER, _OPEN_GATE = range(3)


class _Gates(_Bucket):
    """Open gates of every thread as a queue.  Rows wait until the watermark has passed them, so that they are taken in
    event order; an answer goes to the gate that has been open longest, and to no other."""

    INPUT = ("ms", "kind", "id", "answer", "thread_id")
    OUTPUT = GATES_OUT
    KEPT = pa.schema([("ms", pa.int64()), ("kind", pa.int8()), ("id", pa.int64()), ("answer", pa.string()), ("thread_id", pa.string())])

    def __init__(self, within_ms: int):
        self.within_ms = within_ms

    def take(self, kept, new, now):
        rows = [r for r in kept if r[1] != _OPEN_GATE] + [(int(ms), int(kind), int(ident), *r) for ms, kind, ident, *r in new]
        queues: dict[str | None, deque] = {}
        for ms, kind, ident, _, thread in kept:
            if kind == _OPEN_GATE:
                queues.setdefault(thread, deque()).append((ms, ident))
        out = []

        def expire(thread: str | None, queue: deque, before: int) -> None:
            while queue and queue[0][0] + self.within_ms < before:
                out.append((queue.popleft()[1], thread, None, None))
        for ms, kind, ident, answer, thread in sorted((r for r in rows if r[0] <= now), key=lambda r: (*r[:3], r[3] or "")):
            queue = queues.setdefault(thread, deque())
            expire(thread, queue, ms)
            if kind == _WAITING_GATE:
                queue.append((ms, ident))
            elif queue:
                out.append((queue.popleft()[1], thread, ident, answer))
        for thread, queue in queues.items():
            expire(thread, queue, now + 1)
        rest = [r for r in rows if r[0] > now]
        still = [(ms, _OPEN_GATE, ident, None, thread) for thread, queue in queues.items() for ms, ident in queue]
        return out, rest + still, min([r[0] for r in rest] + [r[0] + self.within_ms for r in still], default=None)


def gate_join(gates: DataFrame, answers: DataFrame, within_ms: int, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """Each answer is taken once, by the gate of its thread that has been open longest, within ``within_ms`` of it.

    ``gates``: gate_id, thread_id, gate_time; ``answers``: answer_id, answer_thread, answer_time, answer.  Every gate
    comes out once, when it is answered or when the watermark has passed its window (answer_id null).  Answers that
    find no open gate are not used.  Of rows with one millisecond gates come first, then smaller ids.
    """
    none = F.lit(None).cast("string")
    rows = gates.select("thread_id", F.col("gate_time").alias("at"), F.lit(0).alias("kind"), F.col("gate_id").alias("id"),
                        none.alias("answer")).union(
        answers.select("answer_thread", "answer_time", F.lit(1), "answer_id", "answer"))
    rows = rows.withWatermark("at", delay).withColumn("ms", _millis("at"))
    return _by_bucket(rows, ["thread_id"], buckets).transformWithStateInPandas(_Gates(within_ms), GATES_OUT, "append", "eventTime")


def gate_results(landed: DataFrame, choices: Sequence[str]) -> DataFrame:
    """The outcome of every landed gate; an answer outside the choices is an error."""
    ok = F.col("answer").isin(*choices)
    return landed.select("gate_id", "thread_id", "answer_id",
                         F.when(F.col("answer").isNull(), F.lit("open"))
                          .when(ok, F.lit("answered")).otherwise(F.lit("error")).alias("status"),
                         F.when(ok, F.col("answer")).alias("answer"),
                         F.when(F.col("answer").isNotNull() & ~ok, F.concat(
                             F.lit("answer '"), F.col("answer"), F.lit("' is not one of the allowed choices")))
                          .alias("error"))


# ------------------------------------------------------------------ T5: reducers

FOLD_OUT = ("thread_id string, channel string, part timestamp, writes_before long, elements_before long, "
            "writes long, elements long, total long, last_value long")


class _Offsets(_Bucket):
    """Running state of every channel: how many writes and elements its lists hold, its sum and its last value."""

    INPUT = ("part", "thread_id", "channel", "n", "n_elements", "added", "last_value")
    OUTPUT = FOLD_OUT
    KEPT = pa.schema([("thread_id", pa.string()), ("channel", pa.string()), ("writes", pa.int64()), ("elements", pa.int64()),
                      ("total", pa.int64())])

    def take(self, kept, new, now):
        so_far = {r[:2]: r[2:] for r in kept}
        out = []
        for part, thread, channel, n, n_elements, added, last in sorted(new, key=lambda r: r[0]):
            writes, elements, total = so_far.get((thread, channel), (0, 0, 0))
            after = writes + int(n), elements + int(n_elements), total + int(added)
            so_far[thread, channel] = after
            out.append((thread, channel, part, writes, elements, *after, _whole(last)))
        return out, [(*k, *v) for k, v in so_far.items()], None


def stateful_fold(writes: DataFrame, delay: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """T5: the reducers of every (thread, channel), carried on from batch to batch.

    ``writes``: event_time, thread_id, channel, seq, value, elements.  A window of one hour is folded by a streaming
    aggregate; the keyed state behind it holds the list offsets, the sum and the last value, and every window comes
    out with the offsets at which its writes (append) and elements (extend) begin.
    """
    w = writes.withWatermark("event_time", delay)
    per = w.groupBy("thread_id", "channel", F.window("event_time", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.size("elements"), F.lit(0))).alias("n_elements"),
        F.sum(F.coalesce("value", F.lit(0))).alias("added"), F.max(F.struct("event_time", "seq", "value")).alias("last"))
    rows = per.select("thread_id", "channel", F.col("w.start").alias("part"), "n", "n_elements", "added",
                      F.col("last.value").alias("last_value"), F.window_time("w").alias("at"))
    return _by_bucket(rows, ["thread_id", "channel"], buckets).transformWithStateInPandas(_Offsets(), FOLD_OUT, "append", "eventTime")


def folded_contents(landed: DataFrame, writes: DataFrame) -> DataFrame:
    """Contents of every channel under each reducer, in long form: thread_id, channel, reducer, pos, map_key, value.

    ``landed`` is T5's table, ``writes`` the writes that have landed (with map_key).  List positions are the
    window's offset plus the place inside the window, so a hot channel is numbered window by window; the merged
    map and the scalars are algebraic.
    """
    keys = ["thread_id", "channel"]
    none = F.lit(None).cast("string").alias("map_key")
    starts = landed.select(*keys, "part", "writes_before", "elements_before")
    placed = writes.withColumn("part", F.date_trunc("hour", "event_time")).join(starts, [*keys, "part"])
    order = Window.partitionBy(*keys, "part").orderBy("event_time", "seq")
    before = F.coalesce(F.sum(F.coalesce(F.size("elements"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.select(*keys, "value", "elements", (F.col("writes_before") + F.row_number().over(order)).alias("pos"),
                           (F.col("elements_before") + before).alias("first"))
    append = placed.select(*keys, F.lit("append").alias("reducer"), "pos", none, "value")
    extend = placed.select(*keys, "first", F.posexplode("elements").alias("i", "value")).select(
        *keys, F.lit("extend").alias("reducer"), (F.col("first") + F.col("i") + 1).alias("pos"), none, "value")
    merged = writes.groupBy(*keys, "map_key").agg(F.max_by("value", F.struct("event_time", "seq")).alias("value")).select(
        *keys, F.lit("merge_dict").alias("reducer"), F.lit(None).cast("long").alias("pos"), "map_key", "value")
    newest = landed.groupBy(*keys).agg(F.max_by(F.struct("total", "last_value"), "part").alias("s"))
    scalars = newest.select(*keys, F.explode(F.array(
        F.struct(F.lit("sum").alias("reducer"), F.col("s.total").alias("value")),
        F.struct(F.lit("last").alias("reducer"), F.col("s.last_value").alias("value")))).alias("x")).select(
        *keys, "x.reducer", F.lit(None).cast("long").alias("pos"), none, "x.value")
    return append.unionByName(extend).unionByName(merged).unionByName(scalars)


# ------------------------------------------------------------------ T6, T7: timers

BARRIER_OUT = "thread_id string, fired string, upto_ms long, upto_id long"
_ANY_ID = (1 << 63) - 1


class _Barrier(_Bucket):
    """First arrival of every source, for every thread; fires once, when all are there or the time is over."""

    INPUT = ("thread_id", "source", "ms", "id")
    OUTPUT = BARRIER_OUT
    # a thread that has fired is one row without a source, which is kept until ``ms``
    KEPT = pa.schema([("thread_id", pa.string()), ("source", pa.string()), ("ms", pa.int64()), ("id", pa.int64())])

    def __init__(self, n_expected: int, timeout_ms: int, keep_ms: int, window_ms: int):
        self.n_expected, self.timeout_ms, self.keep_ms, self.window_ms = n_expected, timeout_ms, keep_ms, window_ms

    def take(self, kept, new, now):
        fired = {thread: ms for thread, source, ms, _ in kept if source is None}
        first: dict[str | None, dict[str, tuple[int, int]]] = {}
        for thread, source, ms, ident in [r for r in kept if r[1] is not None] + new:
            if thread not in fired:
                at, known = (int(ms), int(ident)), first.setdefault(thread, {})
                known[source] = min(known.get(source, at), at)
        # later arrivals of this batch find the decision; it ends when no more can come
        left = {thread: until for thread, until in fired.items() if until >= now}
        out, dues = [], []
        for thread, known in first.items():
            start = min(known.values())[0]
            # a window that reaches over the deadline is complete one window later
            due = start + self.timeout_ms + self.window_ms
            in_time = [at for at in known.values() if at[0] <= start + self.timeout_ms]
            if len(in_time) == self.n_expected:
                out.append((thread, "complete", *max(in_time)))
            elif now >= due:
                out.append((thread, "timeout", start + self.timeout_ms, _ANY_ID))
            else:
                dues.append(due)
                continue
            left[thread] = max(out[-1][2] + self.keep_ms, now + 1)
            first[thread] = {}
        rows = [(thread, source, *at) for thread, known in first.items() for source, at in known.items()]
        return out, rows + [(thread, None, until, None) for thread, until in left.items()], min([*dues, *left.values()], default=None)


def stream_barrier(arrivals: DataFrame, expected: Sequence[str], timeout_ms: int, keep_ms: int, delay: str,
                   window: str = "1 hour", window_ms: int = HOUR_MS, buckets: int = BUCKETS) -> DataFrame:
    """A merge fires once.  ``complete`` when the last expected source arrives within ``timeout_ms`` of the first
    arrival; otherwise ``timeout``.  ``upto_ms``, ``upto_id`` say which arrivals count (``barrier_states``).

    ``arrivals``: thread_id, source, event_id, event_time; ``expected`` are the sources of the merge's in-edges
    (``merge_sources``).  A streaming aggregate keeps the first arrival per source and window, so a hot thread sends a
    row per source and window to its timer.  A key that has fired is remembered for ``keep_ms``, so that later
    arrivals do not fire it again.
    """
    a = arrivals.where(F.col("source").isin(*expected)).withWatermark("event_time", delay)
    firsts = a.groupBy("thread_id", "source", F.window("event_time", window).alias("w")).agg(
        F.min(F.struct(_millis("event_time").alias("ms"), F.col("event_id").alias("id"))).alias("f"))
    rows = firsts.select("thread_id", "source", "f.ms", "f.id", F.window_time("w").alias("at"))
    return _by_bucket(rows, ["thread_id"], buckets).transformWithStateInPandas(
        _Barrier(len(expected), timeout_ms, keep_ms, window_ms), BARRIER_OUT, "append", "eventTime")


def barrier_states(landed: DataFrame, arrivals: DataFrame, expected: Sequence[str]) -> DataFrame:
    """What each fired merge has: the state of every source at that moment, missing sources counting as skipped."""
    a = arrivals.where(F.col("source").isin(*expected)).withColumn("event_ms", _millis("event_time"))
    at = F.struct("event_ms", "event_id")
    had = a.join(landed.select("thread_id", "fired", "upto_ms", "upto_id"), "thread_id").where(
        at <= F.struct(F.col("upto_ms").alias("event_ms"), F.col("upto_id").alias("event_id"))) \
        .groupBy("thread_id", "fired", "source").agg(F.max_by("state", at).alias("state"))
    return had.groupBy("thread_id", "fired").agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in ("ok", "failed")],
        (F.count_if(F.col("state") == "skipped") + len(expected) - F.count(F.lit(1))).alias("skipped"))


def merge_sources(edges: DataFrame, merge: str) -> list[str]:
    """Declared sources of a merge node (a handful per graph)."""
    return sorted(r[0] for r in edges.where(F.col("merge") == merge).select("source").distinct().collect())


DEADLINE_OUT = "run_id string, started_ms long, deadline_ms long"


class _Deadline(_Bucket):
    """Start and first terminal event of every run; judged once, when all windows up to the deadline are complete."""

    INPUT = ("run_id", "ms", "done_ms")
    OUTPUT = DEADLINE_OUT
    # a run that has been judged is kept until ``until``
    KEPT = pa.schema([("run_id", pa.string()), ("started", pa.int64()), ("done", pa.int64()), ("until", pa.int64())])

    def __init__(self, deadline_ms: int, keep_ms: int, window_ms: int):
        self.deadline_ms, self.keep_ms, self.window_ms = deadline_ms, keep_ms, window_ms

    def take(self, kept, new, now):
        runs = {r[0]: r[1:] for r in kept}
        for run, ms, done_ms in new:
            started, done, until = runs.get(run, (_ANY_ID, None, None))
            done_ms = _whole(done_ms)
            if done_ms is not None and (done is None or done_ms < done):
                done = done_ms
            runs[run] = min(started, int(ms)), done, until
        out, rows, dues = [], [], []
        for run, (started, done, until) in runs.items():
            due = started + self.deadline_ms + self.window_ms
            if until is None and now >= due:
                until = max(started + self.keep_ms + self.window_ms, now + 1)
                # reaching the deadline trips, so a terminal event must come before it
                if done is None or done >= started + self.deadline_ms:
                    out.append((run, started, started + self.deadline_ms))
            if until is None or until >= now:
                rows.append((run, started, done, until))
                dues.append(due if until is None else until)
        return out, rows, min(dues, default=None)


def deadline_monitor(events: DataFrame, deadline_ms: int, keep_ms: int, delay: str, terminal: Sequence[str],
                     window: str = "1 hour", window_ms: int = HOUR_MS, buckets: int = BUCKETS) -> DataFrame:
    """Runs whose first terminal event does not come before start + deadline, told once, when the watermark has
    passed the deadline's window.  A streaming aggregate sends one row per run and window to the timer.  What was told
    is remembered for ``keep_ms`` after the start."""
    e = with_event_time(events).withWatermark("event_time", delay)
    per = e.groupBy("run_id", F.window("event_time", window).alias("w")).agg(
        F.min(_millis("event_time")).alias("ms"),
        F.min(F.when(F.col("event_type").isin(*terminal), _millis("event_time"))).alias("done_ms"))
    rows = per.select("run_id", "ms", "done_ms", F.window_time("w").alias("at"))
    return _by_bucket(rows, ["run_id"], buckets).transformWithStateInPandas(
        _Deadline(deadline_ms, keep_ms, window_ms), DEADLINE_OUT, "append", "eventTime")
