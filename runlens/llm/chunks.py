"""Texts packed into chunks, and the exchange of packed names between chunks and buckets.

A corpus-wide statistic of short strings (does it occur elsewhere, how often)
would need one shuffled row for each string.  Here a task packs the distinct
names of its chunk into one array per bucket; a bucket sorts the arrays of all
chunks and answers each array with one small value per name, in its order.
Chunks stay where they are: the table is bucketed by chunk, and only the
answers are shuffled to it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

PACKED = "chunk long, kind int, bucket long, packed binary"


def chunk_table(docs: DataFrame, scratch: Scratch, chunk_bytes: int) -> DataFrame:
    """Write ``docs`` (id, text) as chunks of about ``chunk_bytes`` of whole texts: chunk, ids, sizes, body."""
    id_type = docs.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, no, ids, texts, total = TaskContext.get().partitionId() << 33, 0, [], [], 0

        def row() -> pd.DataFrame:
            return pd.DataFrame({"chunk": [base + no], "ids": [ids], "sizes": [[len(t) for t in texts]],
                                 "body": [b"".join(texts)]})
        for pdf in batches:
            for i, t in zip(pdf["id"], pdf["text"]):
                t = t.encode()
                if texts and total + len(t) > chunk_bytes:
                    yield row()
                    no, ids, texts, total = no + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                total += len(t)
        if texts:
            yield row()

    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"chunks_{uuid.uuid4().hex}"
    # ids travel as text, so that a null does not turn whole numbers into floats
    docs.select(F.col("id").cast("string").alias("id"), "text") \
        .mapInPandas(pack, "chunk long, ids array<string>, sizes array<long>, body binary") \
        .withColumn("ids", F.col("ids").cast(f"array<{id_type}>")) \
        .write.format("parquet").option("compression", "zstd").option("path", f"{scratch.base}/chunks") \
        .bucketBy(shards, "chunk").saveAsTable(name)
    return spark.table(name)


def packed_rows(chunk: int, kind: int, bucket: np.ndarray, *values: np.ndarray) -> Iterator[pd.DataFrame]:
    """Values that are sorted by bucket, as one packed array per bucket (several value arrays one after the other);
    nothing where there are none."""
    if len(bucket):
        nos, at = np.unique(bucket, return_index=True)
        ends = [*at[1:].tolist(), len(bucket)]
        yield pd.DataFrame({"chunk": chunk, "kind": kind, "bucket": nos.astype(np.int64), "packed": [
            b"".join(v[a:b].tobytes() for v in values) for a, b in zip(at.tolist(), ends)]})


def with_answers(chunks: DataFrame, answers: DataFrame, *fields: str) -> DataFrame:
    """The chunk table with the list of each chunk's answers; its texts are not shuffled."""
    by = answers.groupBy("chunk").agg(F.collect_list(F.struct(*fields)).alias("answers"))
    return chunks.join(by.hint("shuffle_hash"), "chunk", "left")
