"""Per-key ordered scans that stay balanced when one key is hot.

A plain ``row_number() OVER (PARTITION BY key ORDER BY o)`` sends every row
of a key to one task.  When a single run or thread holds a third of the
log, that task holds a third of the data.  ``ordered_scan`` splits the work:

1. cut the order axis into slices at global quantiles (computed once, a handful
   of numbers, embedded in the plan as literals): of the leading order column,
   numbers and times by value, texts by their first bytes; where one value holds
   several slices' worth of rows, also of what follows it, the next bytes of the
   text or the next order column.  The number of slices follows the number of
   rows, so no (key, slice) group is much larger than ``SLICE_ROWS``, however
   hot the key is;
2. number rows and take running sums inside each (key, slice);
3. total each (key, slice) -- at most one row per key and slice, so the
   offset window over slices is small per key;
4. add the offsets of earlier slices back with an equi-join on
   (key, slice).

The slice of a row is a pure function of its values, so every branch of the
plan and every recomputed partition after an executor loss agree on it.
Bucketing is a JVM binary search (``Bucketizer``); everything else is
built-in window / aggregate / join operators.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DateType, StringType, TimestampNTZType, TimestampType

_SLICE = "_rl_slice"
_AXIS, _NEXT = "_rl_axis", "_rl_next"
SLICE_ROWS = 1_000_000      # rows that a slice of the order axis holds, about
MAX_SLICES = 1 << 16
_WITHIN = 1 << 20           # slices inside one value of the leading column
_CHUNK = 6                  # bytes of a text that a double holds exactly


def _axis(df: DataFrame, name: str, chunk: int = 0) -> Column:
    """A number that never falls while the column rises; of texts the ``chunk``-th six bytes."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, (StringType, BinaryType)):
        some = F.hex(c.cast("binary").substr(F.lit(chunk * _CHUNK + 1), F.lit(_CHUNK)))
        return F.conv(F.rpad(some, 2 * _CHUNK, "0"), 16, 10).cast("double")
    if isinstance(dtype, (TimestampType, TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(dtype, DateType):
        return F.unix_date(c).cast("double")
    return c.cast("double")


@dataclass(frozen=True)
class Slices:
    """Cut points of the leading column, and inside some of its values cut points of what follows."""
    bounds: tuple[float, ...] = ()
    by_column: tuple[tuple[float, tuple[float, ...]], ...] = ()
    by_chunk: tuple[tuple[float, tuple[float, ...]], ...] = ()


def materialize_if_shuffled(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder when its plan already shuffles.

    An ordered scan reads its input three times (quantiles, rows, totals).
    A plain scan plus projections is cheap to read again; an input built by
    joins or aggregations is written once instead of being recomputed.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(op in plan for op in ("Join ", "Aggregate ", "Window ", "Repartition", "Distinct", "Deduplicate",
                                 "Sort [")):
        from ..session import cut_lineage
        return cut_lineage(df)
    return df


_SLICES_CACHE: dict[tuple, Slices] = {}


def plan_slices(df: DataFrame, order: Sequence[str], slices: int | None = None) -> Slices:
    """Global quantile cut points of the order columns (the driver gets about two numbers per slice).

    Without ``slices`` their number follows the rows.  Cached per (plan, columns,
    slices) for the session: cut points only balance the work -- offsets are
    always computed from the data -- so a cached value can never change a result.
    """
    key = (df.semanticHash(), tuple(order), slices)
    if key not in _SLICES_CACHE:
        if len(_SLICES_CACHE) > 1024:
            _SLICES_CACHE.clear()
        _SLICES_CACHE[key] = _planned(df, order, slices)
    return _SLICES_CACHE[key]


def _planned(df: DataFrame, order: Sequence[str], slices: int | None) -> Slices:
    first = order[0]
    if slices is None:
        least = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        slices = min(MAX_SLICES, max(least, -(-df.count() // SLICE_ROWS)))
    if slices <= 1:
        return Slices()
    text = isinstance(df.schema[first].dataType, (StringType, BinaryType))
    second = _axis(df, order[1]) if len(order) > 1 else F.lit(0.0)
    axes = df.select(_axis(df, first).alias(_AXIS), F.col(first).alias("c"), second.alias(_NEXT),
                     (_axis(df, first, 1) if text else F.lit(0.0)).alias("chunk")).where(F.col(_AXIS).isNotNull())
    cuts = axes.approxQuantile(_AXIS, [i / slices for i in range(1, slices)], 1.0 / (4 * slices))
    times = Counter(cuts)
    many = {v: n for v, n in times.items() if n > 1}
    inner: dict[str, list] = {"by_column": [], "by_chunk": []}
    if many and (text or len(order) > 1):
        most = max(many.values()) + 1
        at = F.array(*[F.lit(i / most) for i in range(1, most)])
        rows = axes.join(F.broadcast(df.sparkSession.createDataFrame([(v,) for v in many], f"{_AXIS} double")), _AXIS) \
            .groupBy(_AXIS).agg(F.min("c").eqNullSafe(F.max("c")).alias("same"), F.percentile_approx(_NEXT, at, 4 * most).alias("n"),
                                F.percentile_approx("chunk", at, 4 * most).alias("t")).collect()
        for r in rows:
            # what follows may decide only where the leading value itself is one
            kind, found = ("by_column", r.n) if r.same else ("by_chunk", r.t if text else None)
            points = tuple(sorted(set(found or ())))
            if len(points) > 1:
                inner[kind].append((float(r[_AXIS]), points))
    return Slices(tuple(sorted(times)), tuple(inner["by_column"]), tuple(inner["by_chunk"]))


def _inside(points: tuple, axis: Column) -> Column:
    """How many cut points of the row's own leading value lie at or below ``axis``."""
    table = F.create_map(*[F.lit(x) for v, cuts in points for x in (v, list(cuts))])
    return F.size(F.filter(F.coalesce(F.try_element_at(table, F.col(_AXIS)), F.array().cast("array<double>")), lambda b: b <= axis))


def with_slice(df: DataFrame, order: Sequence[str], plan: Slices, descending: bool = False) -> DataFrame:
    """Add the slice of every row, a number that never falls along the order; rows without a leading value come first."""
    if not plan.bounds:
        return df.withColumn(_SLICE, F.lit(0).cast("long"))
    axis = df.withColumn(_AXIS, _axis(df, order[0]))
    b = Bucketizer(splits=[float("-inf"), *plan.bounds, float("inf")], inputCol=_AXIS, outputCol=_SLICE, handleInvalid="keep")
    no = F.col(_SLICE).cast("long") * _WITHIN
    if plan.by_column:
        no = no + _inside(plan.by_column, F.coalesce(_axis(df, order[1]), F.lit(float("-inf"))))
    if plan.by_chunk:
        no = no + _inside(plan.by_chunk, _axis(df, order[0], 1))
    no = F.when(F.col(_AXIS).isNull(), F.lit(-1)).otherwise(no).cast("long")
    return b.transform(axis).withColumn(_SLICE, -no if descending else no).drop(_AXIS)


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
                 descending: bool = False,
                 index: str | None = None, total: str | None = None,
                 running: dict[str, str | Column] | None = None,
                 running_before: dict[str, str | Column] | None = None,
                 slices: int | None = None) -> DataFrame:
    """Add per-key ordered columns.

    ``order``: column names; all ascending, or all descending with ``descending``.
    ``index``: 1-based position within the key (row_number).
    ``total``: row count of the key.
    ``running``: name -> value, sum of value over rows up to and including this one.
    ``running_before``: name -> value, sum over rows strictly before this one.
    ``order`` must be unique within a key for a deterministic result.
    """
    running = dict(running or {})
    running_before = dict(running_before or {})
    keys = list(keys)
    order = list(order)

    sums = {f"_rl_v{i}": (F.col(v) if isinstance(v, str) else v)
            for i, v in enumerate(list(running.values()) + list(running_before.values()))}
    base = materialize_if_shuffled(df.select("*", *[v.alias(k) for k, v in sums.items()]))
    sliced = with_slice(base, order, plan_slices(base, order, slices), descending)

    ocols = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    w_local = Window.partitionBy(*keys, _SLICE).orderBy(*ocols)
    w_upto = w_local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local_cols = [F.row_number().over(w_local).alias("_rl_idx")]
    local_cols += [F.sum(k).over(w_upto).alias(f"{k}_run") for k in sums]
    local = sliced.select("*", *local_cols)

    # totals come from the windowed rows: same (key, slice) partitioning, so the
    # input is shuffled once and both branches read that shuffle
    stats = local.groupBy(*keys, _SLICE).agg(
        F.count(F.lit(1)).alias("_rl_n"), *[F.sum(k).alias(f"{k}_tot") for k in sums])
    w_prev = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*keys)
    offsets = stats.select(
        *[F.col(k).alias(f"_rl_k{i}") for i, k in enumerate(keys)],
        F.col(_SLICE).alias("_rl_kslice"),
        F.coalesce(F.sum("_rl_n").over(w_prev), F.lit(0)).alias("_rl_off"),
        F.sum("_rl_n").over(w_all).alias("_rl_total"),
        *[F.sum(f"{k}_tot").over(w_prev).alias(f"{k}_off") for k in sums])

    cond = [F.col(k).eqNullSafe(F.col(f"_rl_k{i}")) for i, k in enumerate(keys)]
    cond.append(F.col(_SLICE).eqNullSafe(F.col("_rl_kslice")))
    joined = local.join(offsets, cond, "inner")

    out = []
    names = list(running) + list(running_before)
    for i, name in enumerate(names):
        k = f"_rl_v{i}"
        upto = F.coalesce(F.col(f"{k}_off"), F.lit(0)) + F.coalesce(F.col(f"{k}_run"), F.lit(0))
        if name in running:
            out.append(upto.alias(name))
        else:
            out.append((upto - F.coalesce(F.col(k), F.lit(0))).alias(name))
    if index:
        out.append((F.col("_rl_idx") + F.col("_rl_off")).cast("long").alias(index))
    if total:
        out.append(F.col("_rl_total").cast("long").alias(total))
    return joined.select(*df.columns, *out)


def asof_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, is_source: Column,
              out: str, slices: int | None = None) -> DataFrame:
    """For every row, the ``value`` of the latest source row at or before it (same keys).

    Skew-safe as-of: inside each (key, slice) a running ``last(ignorenulls)``;
    across slices the last source value of every earlier slice is carried
    forward on a table with at most one row per (key, slice), then joined back.
    """
    keys = list(keys)
    order = list(order)
    base = materialize_if_shuffled(df.select("*", F.when(is_source, value).alias("_rl_val")))
    sliced = with_slice(base, order, plan_slices(base, order, slices))
    w = Window.partitionBy(*keys, _SLICE).orderBy(*[F.col(c) for c in order]) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sliced.withColumn("_rl_local", F.last("_rl_val", ignorenulls=True).over(w))
    # one row per (key, slice) that has rows: the slice's last source value (or null)
    marks = sliced.groupBy(*keys, _SLICE).agg(
        F.max_by("_rl_val", F.when(F.col("_rl_val").isNotNull(), F.struct(*[F.col(c) for c in order])))
        .alias("_rl_slice_last"))
    ws = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    prev = marks.select(*[F.col(k).alias(f"_rl_k{i}") for i, k in enumerate(keys)],
                        F.col(_SLICE).alias("_rl_kslice"),
                        F.last("_rl_slice_last", ignorenulls=True).over(ws).alias("_rl_prev"))
    cond = [F.col(k).eqNullSafe(F.col(f"_rl_k{i}")) for i, k in enumerate(keys)]
    cond.append(F.col(_SLICE) == F.col("_rl_kslice"))
    j = local.join(prev, cond, "left")
    return j.select(*df.columns, F.coalesce(F.col("_rl_local"), F.col("_rl_prev")).alias(out))


def concat_ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, sep: str = "",
                   out: str = "text", aggs: dict[str, Column] | None = None, slices: int | None = None) -> DataFrame:
    """One text per key, its pieces in order, joined by ``sep``; null pieces are left out.

    A tree of slices: the pieces of a (key, slice) group are sorted and joined first, then the slices'
    texts of a key, so no task sorts a key's pieces; a task holds a slice, or one finished text.
    ``aggs`` are further sums per key (name -> value).
    """
    keys, aggs = list(keys), dict(aggs or {})
    base = materialize_if_shuffled(df.select(*keys, *order, F.col(text).alias("_rl_text"), *[v.alias(k) for k, v in aggs.items()]))
    sliced = with_slice(base, order, plan_slices(base, order, slices))

    def joined(by: Sequence[str], piece: str) -> Column:
        pieces = F.array_sort(F.collect_list(F.struct(*by, piece)))
        return F.array_join(F.transform(pieces, lambda p: p[piece]), sep)
    totals = [F.sum(k).alias(k) for k in aggs]
    level = sliced.groupBy(*keys, _SLICE).agg(joined(order, "_rl_text").alias("_rl_part"), F.count("_rl_text").alias("_rl_n"), *totals)
    # a slice without a piece must not add a separator
    level = level.withColumn("_rl_part", F.when(F.col("_rl_n") > 0, F.col("_rl_part")))
    return level.groupBy(*keys).agg(joined([_SLICE], "_rl_part").alias(out), *totals)
