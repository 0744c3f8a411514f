"""Masking of known values and patterns in text and nested columns.

Known values are rows of a table, however many.  They are written once and read
three times, not shuffled.  A Bloom filter of bounded size over their first and
last bytes (1, 2, 4, 8 or 16 of each, the most that the filter can hold) goes to
the tasks, which look up every position of every text and send on only the pieces
that have the length, the first and the last bytes of values.  A second filter,
over those pieces, goes to the values; those that pass are joined to the pieces,
byte for byte, which gives the spans of each text.  So what is shuffled grows with
the places in the texts, not with the values; neither texts, values nor spans
reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType
from pyspark.sql.window import Window

from ..session import cut_lineage

# Patterns masked by ``redact`` (mail address, IPv4 address, 16-digit
# number) and the mask text.  The mail pattern starts only at the beginning of a
# run of address characters and never backtracks into it (same matches, linear time).
REDACT_PATTERNS = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    r"\b\d{16}\b",
)
MASK = "[REDACTED]"

MAX_FILTER_BITS = 1 << 28      # 32 MB; with more in a filter only more places or values are compared in vain
SAMPLE_BYTES = 1 << 24         # with fewer bytes of values than this, their ends fit into the filter and need not be counted
_SIZES = (1, 2, 4, 8, 16)      # bytes of an end
_RUN = 1 << 20                 # bytes of texts that are hashed at once
_PAGE, _LOOKS = 1 << 15, 4     # bits of one bitmap row, and bits that stand for a hash in its row
_BITMAPS = "page long, b binary"
_PLACES = "row_key binary, leaf binary, start int, value binary"


def redact_patterns(text: Column, patterns: Sequence[str] = REDACT_PATTERNS, mask: str = MASK) -> Column:
    out = text
    for p in patterns:
        out = F.regexp_replace(out, p, mask)
    return out


def secret_values(df: DataFrame, col: str) -> DataFrame:
    """Values assigned in ``token = "..."`` pairs anywhere in a text column (distinct)."""
    return df.select(F.explode(F.regexp_extract_all(F.col(col), F.lit(r'token\s*=\s*"([^"]*)"'), 1))
                     .alias("value")).where(F.col("value") != "").distinct()


# ------------------------------------------------------------------ text leaves of a column

def text_leaves(value: Column, dtype: DataType, keys: bool = True) -> Column | None:
    """All texts inside a value (struct fields, list elements, map values and, with ``keys``, map keys) as one array."""
    if isinstance(dtype, StringType):
        return F.array(value)
    parts: list[Column] = []
    if isinstance(dtype, StructType):
        parts = [x for f in dtype.fields if (x := text_leaves(value.getField(f.name), f.dataType, keys)) is not None]
        parts = [F.coalesce(p, F.array().cast("array<string>")) for p in parts]
    elif isinstance(dtype, ArrayType) and _has_text(dtype.elementType):
        parts = [_all_leaves(value, dtype.elementType, keys)]
    elif isinstance(dtype, MapType):
        for side, t in ((F.map_keys(value), dtype.keyType), (F.map_values(value), dtype.valueType))[0 if keys else 1:]:
            if _has_text(t):
                parts.append(_all_leaves(side, t, keys))
    parts = [p for p in parts if p is not None]
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else F.concat(*[_full(p) for p in parts])


def _all_leaves(items: Column, dtype: DataType, keys: bool) -> Column | None:
    if not keys and text_leaves(F.lit(None), dtype, keys) is None:
        return None
    return F.flatten(F.transform(items, lambda x: _full(text_leaves(x, dtype, keys))))


def _full(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def _has_text(dtype: DataType) -> bool:
    if isinstance(dtype, StructType):
        return any(_has_text(f.dataType) for f in dtype.fields)
    if isinstance(dtype, ArrayType):
        return _has_text(dtype.elementType)
    if isinstance(dtype, MapType):
        return _has_text(dtype.keyType) or _has_text(dtype.valueType)
    return isinstance(dtype, StringType)


def map_texts(value: Column, dtype: DataType, fn: Callable[[Column], Column]) -> Column:
    """The value with ``fn`` applied to every text in it; of map entries whose keys become equal the first stays."""
    if isinstance(dtype, StringType):
        return fn(value)
    if not _has_text(dtype):
        return value
    if isinstance(dtype, StructType):
        made = F.struct(*[map_texts(value.getField(f.name), f.dataType, fn).alias(f.name) for f in dtype.fields])
        return F.when(value.isNotNull(), made)
    if isinstance(dtype, ArrayType):
        return F.transform(value, lambda x: map_texts(x, dtype.elementType, fn))
    if not _has_text(dtype.keyType):
        return F.transform_values(value, lambda _, v: map_texts(v, dtype.valueType, fn))
    keys = F.transform(F.map_keys(value), lambda k: map_texts(k, dtype.keyType, fn))
    values = F.transform(F.map_values(value), lambda v: map_texts(v, dtype.valueType, fn))
    first = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v"), F.sequence(F.lit(1), F.size(keys)).alias("i")),
                     lambda e: F.array_position(keys, e["k"]) == e["i"])
    return F.when(F.size(value) > 0, F.map_from_entries(F.transform(first, lambda e: F.struct(e["k"], e["v"])))) \
        .otherwise(value)


# ------------------------------------------------------------------ known values

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _grams(data: np.ndarray, at: np.ndarray | slice, size: int, family: int) -> np.ndarray:
    """The hashed ``size`` bytes from each of some places on; ``family`` tells kinds and ends of values apart."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    some = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, size)[at])
    wide = some.view(f">u{min(size, 8)}").astype(np.uint64)
    gram = _mix(wide[:, 0]) ^ wide[:, 1] if size == 16 else wide[:, 0]
    return _mix(gram + np.uint64(family * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text of a column starts and the last one ends, and the bytes that these count."""
    starts = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return starts, np.frombuffer(column.buffers()[2] or b"", np.uint8)


def _bit(hashes: np.ndarray, nth: int, bits: int) -> np.ndarray:
    """One of the ``_LOOKS`` bits that stand for each hash; all lie in one page, so that a page can be made by one task."""
    inside = _mix(hashes) >> np.uint64(15 * nth) & np.uint64(_PAGE - 1)
    return (hashes & np.uint64(bits // _PAGE - 1)) * np.uint64(_PAGE) + inside


def _set_bits(pages: np.ndarray, hashes: np.ndarray) -> None:
    for nth in range(_LOOKS):
        at = _bit(hashes, nth, len(pages) * 8)
        np.bitwise_or.at(pages, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def _held(pages: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The places of the hashes that may be in the filter: all that are, and few others."""
    found = np.arange(len(hashes))
    for nth in range(_LOOKS):
        at = _bit(hashes[found] if nth else hashes, nth, len(pages) * 8)
        found = found[(pages[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
    return found


def _pages_of(pages: np.ndarray) -> pa.RecordBatch:
    rows = pages.reshape(-1, _PAGE // 8)
    held = np.flatnonzero(rows.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(held), pa.array([rows[i].tobytes() for i in held], pa.binary())], names=["page", "b"])


def _filter(pages: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter from the pages that tasks made of it, at most ``MAX_FILTER_BITS`` bits whatever it stands for."""
    out = np.zeros(bits // 8, np.uint8)
    for page, bitmap in pages.groupBy("page").agg(F.bitmap_or_agg("b").alias("b")).collect():
        part = np.frombuffer(bitmap, np.uint8)[:_PAGE // 8]
        out[page * (_PAGE // 8):page * (_PAGE // 8) + len(part)] = part
    return out


def _filter_bits(n: int) -> int:
    return min(MAX_FILTER_BITS, max(_PAGE, 1 << (16 * n).bit_length()))


def _ends(values: DataFrame) -> tuple[dict[int, tuple[list[int], int, int]], int]:
    """By kind (its length in powers of two), the lengths of the values and how many of their first and last bytes go into
    the filter; and how many different such ends there are, about.

    Longer ends are left out where there are too many different ones for the filter; then more places are compared in vain.
    """
    kind, size = F.expr("length(bin(octet_length(value))) - 1").alias("kind"), F.octet_length("value")
    seen = values.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("long")).alias("bytes"),
                                    F.collect_set(size).alias("sizes")).collect()
    fit, some = MAX_FILTER_BITS // 4, {}
    # (kind, last, size): how many different ones; a byte has 256 values
    many = {(r.kind, last, s): min(r.n, 256 ** s) for r in seen for last in (0, 1) for s in _SIZES if s <= 1 << r.kind}
    if sum(r.bytes for r in seen) > SAMPLE_BYTES:
        parts = {(last, s): F.approx_count_distinct(F.expr(f"substring(value, {-s if last else 1}, {s})")).alias(f"n{last}_{s}")
                 for last in (0, 1) for s in _SIZES if s > 2}
        for r in values.groupBy(kind).agg(*parts.values()).collect():
            many |= {(r.kind, last, s): r[f"n{last}_{s}"] for last, s in parts if (r.kind, last, s) in many}
    for (k, last, s), n in sorted(many.items(), key=lambda x: (x[1], x[0])):
        held = some.get((k, last), (0, 0))
        if s > held[0] and (s == 1 or sum(n for _, n in some.values()) - held[1] + n <= fit):
            some[k, last] = s, n
    return {r.kind: (sorted(r.sizes), some[r.kind, 0][0], some[r.kind, 1][0]) for r in seen}, sum(n for _, n in some.values())


def _end_pages(kinds: dict[int, tuple[list[int], int, int]], bits: int):
    """The pages of the filter of the first and last bytes of a task's values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            starts, data = _bytes_of(batch.column(0))
            kind = np.frexp(np.diff(starts).astype(float))[1] - 1
            for k, (_, first, last) in kinds.items():
                mine = np.flatnonzero(kind == k)
                for family, size, at in ((2 * k, first, starts[mine]), (2 * k + 1, last, starts[mine + 1] - last)):
                    if len(mine):
                        _set_bits(pages, np.unique(_grams(data, at, size, family)))
        yield _pages_of(pages)
    return run


def _places(pages: np.ndarray, kinds: dict[int, tuple[list[int], int, int]]):
    """Pieces of texts that have the length, the first and the last bytes of values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PLACES.split(", ")]
        for batch in batches:
            # the texts of a batch are one run of bytes; it is hashed stretch by stretch
            row_keys, leaves, texts = batch.columns
            starts, data = _bytes_of(texts)
            data = data[:starts[-1]]
            for begin in range(int(starts[0]), len(data), _RUN):
                for kind, (sizes, first, last) in kinds.items():
                    at = _held(pages, _grams(data, slice(begin, begin + _RUN), first, 2 * kind)) + begin
                    row = np.searchsorted(starts, at, "right") - 1
                    left = starts[row + 1] - at
                    for size in sizes:
                        fit = np.flatnonzero(left >= size)
                        fit = fit[_held(pages, _grams(data, at[fit] + (size - last), last, 2 * kind + 1))]
                        step = max(1, min(10_000, _RUN // size))
                        for k in range(0, len(fit), step):
                            a, rows = at[fit[k:k + step]], row[fit[k:k + step]]
                            pieces = [data[x:x + size].tobytes() for x in a.tolist()]
                            yield pa.RecordBatch.from_arrays(
                                [row_keys.take(pa.array(rows)), leaves.take(pa.array(rows)),
                                 pa.array((a - starts[rows]).astype(np.int32)), pa.array(pieces, pa.binary())], names=names)
    return run


def _hash_pages(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            _set_bits(pages, batch.column(0).to_numpy().view(np.uint64))
        yield _pages_of(pages)
    return run


def _in_filter(pages: np.ndarray):
    """The values whose hash may be in the filter, once for a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _held(pages, batch.column(1).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found)).unique()], names=["value"])
    return run


def value_places(leaves: DataFrame, values: DataFrame) -> DataFrame | None:
    """Where values stand in texts: row_key, leaf, start (byte), value.  None where there are no values.

    ``leaves``: row_key, leaf, text (bytes).  What is joined grows with the places where values may stand: a value that
    stands nowhere is read, but not sent on, unless the filter of those places takes it for another.
    """
    values = cut_lineage(values.select(F.col(values.columns[0]).cast("string").cast("binary").alias("value"))
                         .where("octet_length(value) > 0"), "zstd")
    kinds, n = _ends(values)
    if not kinds:
        return None
    bits = _filter_bits(n)
    ends = _filter(values.mapInArrow(_end_pages(kinds, bits), _BITMAPS), bits)
    places = cut_lineage(leaves.select("row_key", "leaf", "text").mapInArrow(_places(ends, kinds), _PLACES), "zstd")
    bits = _filter_bits(places.count())
    hashed = F.xxhash64("value").alias("h")
    # a page is made by one task
    pages = places.select(hashed).distinct().repartition(F.pmod("h", F.lit(bits // _PAGE)))
    found = _filter(pages.mapInArrow(_hash_pages(bits), _BITMAPS), bits)
    return places.join(values.select("value", hashed).mapInArrow(_in_filter(found), "value binary"), "value", "left_semi")


def value_spans(leaves: DataFrame, values: DataFrame) -> DataFrame | None:
    """What is left between the values of every text that holds any: row_key, leaf, gaps (from, upto), tail; in bytes.

    ``leaves``: row_key, leaf, text (bytes).  None where there are no values.
    """
    places = value_places(leaves, values)
    if places is None:
        return None
    # equal rows have equal places; what follows needs them by row
    spans = places.select("row_key", "leaf", F.col("start").alias("a"), (F.col("start") + F.octet_length("value")).alias("b")) \
        .distinct().repartition("row_key")
    before = Window.partitionBy("row_key", "leaf").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.max("b").over(before), F.lit(0))
    fresh = F.when(F.col("a") >= F.col("upto"), F.struct(F.col("upto").alias("from"), F.col("a").alias("upto")))
    return spans.withColumn("upto", upto).groupBy("row_key", "leaf").agg(
        F.sort_array(F.collect_list(fresh)).alias("gaps"), F.max("b").alias("tail"))


def _cut(text: Column, spans: Column, mask: str) -> Column:
    """What lies between the values, joined by masks.  Bytes are cut, so a piece costs its own length."""
    data = text.cast("binary")
    pieces = F.transform(spans["gaps"], lambda g: data.substr(g["from"] + 1, g["upto"] - g["from"]).cast("string"))
    rest = data.substr(spans["tail"] + 1, F.octet_length(data)).cast("string")
    return F.array_join(F.concat(pieces, F.array(rest)), mask)


def redact(df: DataFrame, cols: str | Sequence[str], values: DataFrame | None = None,
           patterns: Sequence[str] = REDACT_PATTERNS, mask: str = MASK) -> DataFrame:
    """Mask known sensitive values and patterns in columns of any type.

    Every text in a column is masked: the column itself, or struct fields, list
    elements, map keys and map values at any depth (nulls and other types stay).
    Every occurrence of every known value (``values``: one column, any characters,
    any number) is masked, inside longer words too; where occurrences overlap,
    all their characters go under one mask.  Then the patterns are replaced in
    what is left.  Without values, or with empty and null ones only, only the
    patterns are.  Rows are found again by a digest of the column's texts, so the
    table needs no key and rows may repeat.
    """
    for col in [cols] if isinstance(cols, str) else cols:
        dtype = df.schema[col].dataType
        texts = text_leaves(F.col(col), dtype)
        if texts is None:
            continue
        cut = None
        if values is not None:
            key = F.unhex(F.md5(F.concat_ws(",", F.transform(texts, lambda x: F.md5(x.cast("binary"))))))
            leaves = df.select(key.alias("row_key"), F.explode(F.array_distinct(texts)).alias("t")).where("t IS NOT NULL") \
                .select("row_key", _digest(F.col("t")).alias("leaf"), F.col("t").cast("binary").alias("text"))
            cut = value_spans(leaves, values)
        if cut is not None:
            by_row = cut.groupBy("row_key").agg(F.map_from_entries(F.collect_list(
                F.struct("leaf", F.struct("gaps", "tail")))).alias("_cuts")).withColumnRenamed("row_key", "_cut_key")
            df = df.withColumn("_row_key", key)
            df = df.join(by_row, F.col("_row_key") == F.col("_cut_key"), "left").drop("_row_key", "_cut_key")

        def masked(x: Column, known: bool = cut is not None) -> Column:
            if known:
                spans = F.try_element_at(F.col("_cuts"), _digest(x))
                x = F.when(spans.isNotNull(), _cut(x, spans, mask)).otherwise(x)
            return redact_patterns(x, patterns, mask)
        df = df.withColumn(col, map_texts(F.col(col), dtype, masked))
        if cut is not None:
            df = df.drop("_cuts")
    return df


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))
