"""Event-log sources and sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

# Schema of one event line in a JSONL event log.
EVENT_SCHEMA = ("seq long, ts string, run_id string, thread_id string, step int, type string, "
                "node_id string, data string")

# The event vocabulary (21 types).
EVENT_TYPES = (
    "run_started", "superstep_started", "node_started", "node_output_chunk", "node_retrying",
    "node_fallback", "node_reask", "node_cached", "node_finished", "node_failed", "state_updated",
    "interrupt_raised", "run_resumed", "checkpoint_saved", "budget_warning", "guard_tripped",
    "superstep_finished", "run_finished", "run_failed", "run_interrupted", "run_cancelled",
)


def read_run_events(spark: SparkSession, path: str, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """(good, bad) from JSON lines or parquet.

    JSON is read with an explicit schema in PERMISSIVE mode: blank lines are
    skipped by the reader, and lines that do not parse or miss a required
    field (or carry an unknown event type) go to the quarantine output with
    their raw text -- they never stop the read.
    """
    if fmt == "parquet":
        df = spark.read.parquet(path)
        ok = F.coalesce(F.col("run_id").isNotNull() & F.col("type").isin(*EVENT_TYPES), F.lit(False))
        return df.where(ok), df.where(~ok)
    raw = spark.read.text(path).where(F.trim("value") != "")
    parsed = raw.select(F.col("value").alias("raw"), F.from_json("value", EVENT_SCHEMA).alias("e"))
    ok = (F.col("e").isNotNull() & F.col("e.run_id").isNotNull() & F.col("e.seq").isNotNull()
          & F.col("e.type").isin(*EVENT_TYPES) & F.try_to_timestamp(F.col("e.ts")).isNotNull())
    good = parsed.where(ok).select("e.*").withColumn("ts", F.try_to_timestamp("ts"))
    bad = parsed.where(~F.coalesce(ok, F.lit(False))).select("raw")
    return good, bad


def append_events(df: DataFrame, path: str, date_col: str = "ts") -> None:
    """S3: append-only write, partitioned by event date (readers prune by date and
    filter by run or thread through parquet statistics).  The rebalance hint brings a date's
    rows together but splits a date that is too large for one task."""
    (df.withColumn("event_date", F.to_date(F.col(date_col)))
       .hint("rebalance", "event_date")
       .write.mode("append").partitionBy("event_date").parquet(path))


def append_stream(stream: DataFrame, path: str, checkpoint: str, date_col: str = "ts",
                  before_commit: Callable[[int], None] | None = None) -> StreamingQuery:
    """S3 as a stream: batches are appended by event date, and a batch that is replayed after a crash is not written twice.

    A batch lands in a folder of its own (overwritten when it is written again) and counts once it stands in
    the ledger beside the data, one small file per batch; a batch that the ledger has is skipped.
    ``read_appended`` reads what the ledger has.  ``before_commit`` is called between the two writes.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id in _committed(spark, path):
            return
        batch.withColumn("event_date", F.to_date(F.col(date_col))).hint("rebalance", "event_date") \
            .write.mode("overwrite").partitionBy("event_date").parquet(f"{path}/data/batch={batch_id}")
        if before_commit is not None:
            before_commit(batch_id)
        # a range needs no Python worker on the executors, as local rows would
        spark.range(batch_id, batch_id + 1, numPartitions=1).withColumnRenamed("id", "batch").write.mode("overwrite").parquet(f"{path}/ledger/entry={batch_id}")
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_LEDGER = "batch long"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _committed(spark: SparkSession, path: str) -> set[int]:
    """Batches in the ledger; a number per batch, dropped by the user together with batches that are compacted."""
    if not _exists(spark, f"{path}/ledger"):
        return set()
    return {r.batch for r in spark.read.schema(_LEDGER).parquet(f"{path}/ledger/entry=*").collect()}


def read_appended(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all batches in the ledger, with event_date; ``schema`` is that of the stream."""
    done = sorted(_committed(spark, path))
    if not done:
        return spark.createDataFrame([], schema).withColumn("event_date", F.lit(None).cast("date"))
    full = spark.createDataFrame([], schema).withColumn("event_date", F.lit(None).cast("date")).schema
    return spark.read.schema(full).option("basePath", f"{path}/data").parquet(*[f"{path}/data/batch={b}" for b in done]) \
        .select(*full.names)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    from ..session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def upsert_keep_last(base: DataFrame, delta: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keyed upsert; for each key the row with the highest ``order`` wins.

    ``max_by`` over the whole row is combined map-side, so a hot key never
    gathers its history in one task."""
    u = base.unionByName(delta)
    cols = [c for c in u.columns if c not in keys]
    g = u.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_r"))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def outbox_payloads(df: DataFrame, channel: str, fields: dict[str, Column]) -> DataFrame:
    """One JSON message per row in the shape the named channel expects.

    ``fields`` maps the connector's value names (message, chat_id, to,
    from_email, subject, body, title, comment) to columns.  Sending is not
    done here; the result is an outbox table.
    """
    f = fields
    if channel == "slack":
        msg = F.struct(f["message"].alias("text"))
    elif channel == "discord":
        msg = F.struct(f["message"].alias("content"))
    elif channel == "telegram":
        msg = F.struct(f["chat_id"].alias("chat_id"), f["message"].alias("text"))
    elif channel == "webhook":
        msg = F.when(F.coalesce(f["message"], F.lit("")) != "", F.struct(f["message"].alias("text")))
    elif channel == "sendgrid":
        msg = F.struct(
            F.array(F.struct(F.array(F.struct(f["to"].alias("email"))).alias("to"))).alias("personalizations"),
            F.struct(f["from_email"].alias("email")).alias("from"), f["subject"].alias("subject"),
            F.array(F.struct(F.lit("text/plain").alias("type"), f["body"].alias("value"))).alias("content"))
    elif channel == "github_issue":
        msg = F.struct(f["title"].alias("title"), F.coalesce(f.get("body", F.lit("")), F.lit("")).alias("body"))
    elif channel == "github_comment":
        msg = F.struct(f["comment"].alias("body"))
    elif channel == "gitlab_issue":
        msg = F.struct(f["title"].alias("title"),
                       F.coalesce(f.get("body", F.lit("")), F.lit("")).alias("description"))
    else:
        raise ValueError(f"unknown channel {channel!r}")
    return df.select("*", F.lit(channel).alias("channel"), F.to_json(msg).alias("payload"))
