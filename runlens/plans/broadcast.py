"""Broadcast only what is proven small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructField, StructType

DEFAULT_MAX_ROWS = 100_000
DEFAULT_MAX_BYTES = 64 << 20


def _width(field: StructField) -> Column:
    """Bytes of a value, about."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(field.dataType, (StructType, ArrayType, MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return F.lit(8)


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_ROWS, max_bytes: int = DEFAULT_MAX_BYTES) -> DataFrame:
    """Return ``broadcast(df)`` when it has at most ``max_rows`` rows and ``max_bytes`` bytes, else ``df``.

    The check reads at most ``max_rows + 1`` rows (a LIMIT job), so it is
    cheap for the small dimension tables it is meant for, and a table that
    outgrows a bound silently falls back to a shuffle join.
    """
    width = sum((_width(f) for f in df.schema.fields), F.lit(0))
    n, size = df.limit(max_rows + 1).select(width.cast("long").alias("w")).agg(F.count(F.lit(1)), F.sum("w")).first()
    return F.broadcast(df) if n <= max_rows and (size or 0) <= max_bytes else df
