"""Stages of the corpus pipeline: (name, function of (spark, docs, sf_dir)).

All but the last return the columns of ``documents``.  Null texts count as
empty wherever a stage reads them, null sources are a source of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import segments
from .common import Scratch
from .mixing import mix
from .nbsvm import fit
from .ngram_join import jaccard_classes
from .pieces import encode_decode
from .queries import held_out, n_words


# bytes of an Arrow batch: with whole texts in a batch, this is what bounds a Python worker
BATCH_BYTES = "4m"


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more; it learns from labels outside the held-out third."""
    _small_batches(spark)
    labels = table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "quality")
    model = fit(docs.where(~held_out()), labels)
    return docs.where(model.score(F.col("text")) >= 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked rows the one with the smallest id; among equal ids, or without any, the first row.

    Rows are told apart by a number of their own, not by their ids, which may
    be null or repeat.  Rows without words are in no group and stay.
    """
    _small_batches(spark)
    no = "__row"
    while no in docs.columns:
        no += "_"
    rows = Scratch(spark, "near").keep(docs.withColumn(no, F.monotonically_increasing_id()), "rows")
    classes = jaccard_classes(rows, id_col=no, chunk_bytes=2 << 20).where("n_shingles > 0").select(no, "component_id")
    stays = rows.select(no, "doc_id").join(classes, no).groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", no)).alias("least"))
    goes = classes.join(stays.select(F.col("least").getField(no).alias(no)), no, "left_anti").select(no)
    return rows.join(goes, no, "left_anti").select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind; n_chars follows the text."""
    _small_batches(spark)
    out = docs.withColumn("text", segments.masked(F.col("text"), segments.fit(docs)))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    _small_batches(spark)
    taken = mix(docs, n_words(F.col("text")))
    return taken.where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of every document."""
    _small_batches(spark)
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"),
                         outputs=("ids", "ids_sha256", "decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("private", private), ("mixing", mixing),
          ("pieces", pieces)]
