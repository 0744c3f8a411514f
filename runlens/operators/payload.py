"""DataFrame-level projection, filter and payload operators (P1-P3, P6, P8, P9, P11-P13,
F8, F17, F19, F20, F22)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType, VariantType

from ..functions import scalars as S
from ..plans.broadcast import bounded_broadcast
from ..plans.ordered import ordered_scan
from .redaction import MASK, REDACT_PATTERNS, redact, redact_patterns, secret_values, text_leaves  # noqa: F401


def when_filter(df: DataFrame, pred: str | Column) -> DataFrame:
    """Keep rows whose predicate is null (an unconditional edge) or true."""
    p = F.col(pred) if isinstance(pred, str) else pred
    return df.where(F.coalesce(p, F.lit(True)))


def first_match_branch(branches: Sequence[tuple[Column, str]], else_: str | None = None) -> Column:
    """Target of the first true branch, in order; ``else`` always matches; none gives null."""
    expr = None
    for cond, target in branches:
        expr = F.when(cond, F.lit(target)) if expr is None else expr.when(cond, F.lit(target))
    if expr is None:
        return F.lit(else_)
    return expr.otherwise(F.lit(else_)) if else_ is not None else expr


def resolve_name(state: Column, outputs: Column, name: str | Column) -> Column:
    """Look a name up in state first, then node outputs; state wins on a collision
    even when its value is null (presence, not value, decides)."""
    n = F.lit(name) if isinstance(name, str) else name
    return (F.when(F.map_contains_key(state, n), F.element_at(state, n))
            .when(F.map_contains_key(outputs, n), F.element_at(outputs, n)))


# a JSON string with the colon that makes it a key
_JSON_STRING = r'"(?:[^"\\]|\\.)*+"\s*:?'


def find_refs(df: DataFrame, col: str, keys: Sequence[str], is_json: bool = False) -> DataFrame:
    """One row per distinct placeholder of each row.

    ``col`` is a text, a struct, list or map at any depth (their texts are searched, map keys are not), a variant,
    or with ``is_json`` a JSON text, whose strings are searched wherever they stand, keys left out.
    """
    dtype = df.schema[col].dataType
    if is_json or isinstance(dtype, VariantType):
        # written anew by the parser, so that escapes are plain; a text that is no JSON has no strings
        text = F.to_json(F.try_parse_json(col) if is_json else F.col(col))
        texts = F.filter(F.regexp_extract_all(text, F.lit(_JSON_STRING), 0), lambda t: ~t.endswith(":"))
    else:
        texts = text_leaves(F.col(col), dtype, keys=False)
    if texts is None:
        return df.select(*keys, F.lit(None).cast("string").alias("ref")).limit(0)
    refs = F.array_distinct(F.flatten(F.transform(F.filter(texts, lambda t: t.isNotNull()), S.refs_in)))
    return df.select(*keys, F.explode(refs).alias("ref"))


def env_refs(df: DataFrame, col: str, keys: Sequence[str]) -> DataFrame:
    """one row per distinct ${NAME} of each row."""
    return df.select(*keys, F.explode(S.env_names(col)).alias("name"))


def secret_refs(df: DataFrame, col: str, keys: Sequence[str]) -> DataFrame:
    """one row per distinct secret://NAME of each row."""
    return df.select(*keys, F.explode(S.secret_names(col)).alias("name"))


# Event types left out of a normalised trace, and data keys that
# vary between runs of the same graph.
TRACE_SKIP_TYPES = ("node_output_chunk", "checkpoint_saved")
TRACE_VOLATILE_KEYS = ("duration_s", "tokens", "cost_usd", "interrupt_id", "chunk", "run_id",
                       "thread_id", "output", "state", "inputs", "delay_s", "input_hash")


def normalize_trace(events: DataFrame, data: str = "data") -> DataFrame:
    """One line per kept event: ``s{step} {type}[ {node}][ {data}]``.

    ``data`` is a map<string,string> whose values are already rendered as
    Python literals; volatile keys are dropped, a ``changed`` entry is
    expected to hold the sorted channel list.  The data part renders like a
    Python dict: ``{'k': v, ...}`` in insertion order.
    """
    kept = F.map_filter(F.col(data), lambda k, v: ~k.isin(*TRACE_VOLATILE_KEYS))
    rendered = F.concat(F.lit("{"), F.array_join(F.transform(
        F.map_entries(kept), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), e["value"])), ", "),
        F.lit("}"))
    line = F.concat(F.lit("s"), F.col("step").cast("string"), F.lit(" "), F.col("type"),
                    F.when(F.col("node_id").isNotNull(), F.concat(F.lit(" "), F.col("node_id"))).otherwise(""),
                    F.when(F.size(kept) > 0, F.concat(F.lit(" "), rendered)).otherwise(""))
    return events.where(~F.col("type").isin(*TRACE_SKIP_TYPES)).withColumn("line", line)


def events_after(events: DataFrame, cursors: DataFrame, thread: str = "thread_id",
                 order: str = "event_id") -> DataFrame:
    """Rows after each thread's replay position; positions count over all runs of the
    thread (skew-safe ordered numbering), ``cursors`` holds (thread, last_id)."""
    numbered = ordered_scan(events, [thread], [order], index="position")
    return numbered.join(cursors, thread, "inner").where(F.col("position") > F.col("last_id"))


def review_pairs(conv: DataFrame, key: str = "conv_id") -> DataFrame:
    """Independent-review view: the criteria (first user turn) and the artifact
    (last assistant turn) only; both are algebraic ``min_by``/``max_by`` aggregates."""
    return conv.groupBy(key).agg(
        F.min_by(F.when(F.col("role") == "user", F.col("text")),
                 F.when(F.col("role") == "user", F.col("turn"))).alias("criteria"),
        F.max_by(F.when(F.col("role") == "assistant", F.col("text")),
                 F.when(F.col("role") == "assistant", F.col("turn"))).alias("artifact"))


def fresh_only(df: DataFrame, ts: str, now: str, ttl_s: float = 86400.0) -> DataFrame:
    """Keep rows whose age at ``now`` is at most ``ttl_s`` seconds.

    Written as ``ts >= now - ttl`` with the cut-off computed once on the
    driver, so the predicate is a plain comparison the parquet scan can push
    down (row groups older than the cut-off are skipped)."""
    cutoff = datetime.fromisoformat(now) - timedelta(seconds=ttl_s)
    dtype = df.schema[ts].dataType.simpleString()
    return df.where(F.col(ts) >= F.lit(cutoff.isoformat(sep=" ")).cast(dtype))


def fill_env(df: DataFrame, col: str, env: DataFrame) -> DataFrame:
    """F8: ``${NAME}`` replaced from an (name, value) table, in one pass; unknown names stay as they are.

    The names of each distinct text are exploded, joined to the env table (broadcast
    after a size check) and come back by the text's digest as its map of values, so rows
    need no key; a value that looks like a placeholder is not filled again.
    """
    digest = F.md5(F.col(col).cast("binary"))
    names = df.select(digest.alias("_text"), F.explode(S.env_names(col)).alias("name")).distinct()
    known = env.groupBy("name").agg(F.max("value").alias("value"))
    hit = names.join(bounded_broadcast(known), "name", "inner")
    pairs = hit.groupBy("_text").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_values"))
    values = F.coalesce(F.col("_values"), F.create_map().cast("map<string,string>"))
    return df.withColumn("_digest", digest).join(pairs, F.col("_digest") == F.col("_text"), "left").withColumn(
        col, S.fill_once(F.col(col), S.ENV_PATTERN, "${", "}", values)).drop("_values", "_text", "_digest")


def leaf_paths(schema: DataType) -> list[tuple[tuple[str | int, ...], tuple[int, ...]]]:
    """Every leaf below a type, in schema order: its steps (field names, 0 for a list's first
    element) and the positions that order it."""
    todo: list[tuple[DataType, tuple, tuple]] = [(schema, (), ())]
    leaves = []
    for dtype, steps, place in todo:   # grows while it is read: a flat queue, level by level
        if isinstance(dtype, StructType):
            todo += [(f.dataType, (*steps, f.name), (*place, n)) for n, f in enumerate(dtype.fields)]
        elif isinstance(dtype, ArrayType):
            todo.append((dtype.elementType, (*steps, 0), (*place, 0)))
        elif steps:
            leaves.append((steps, place))
    return sorted(leaves, key=lambda leaf: leaf[1])


def leaf_names(paths: Sequence[tuple[str | int, ...]]) -> list[str | None]:
    """A name per path: its last field; where that is taken, the whole path; None where that is taken too."""
    given: dict[str, int] = {}
    out: list[str | None] = []
    for steps in paths:
        fields = [s for s in steps if isinstance(s, str)]
        long = "".join(str(s) if isinstance(s, int) else f"_{s}" for s in steps).lstrip("_")
        free = [n for n in ([fields[-1]] if fields else []) + [long] if n and n not in given]
        out.append(free[0] if free else None)
        if free:
            given[free[0]] = len(out)
    return out


def flatten_leaves(df: DataFrame, col: str, max_leaves: int | None = None, max_depth: int | None = None) -> DataFrame:
    """nested struct column -> leaf columns, all of them unless a bound is given.

    Lists are followed through their first element (null where a list is
    empty); a name clash uses the joined path.  Only the schema is walked on
    the driver; the data is one ``select``.
    """
    paths = [steps for steps, _ in leaf_paths(df.schema[col].dataType) if max_depth is None or len(steps) <= max_depth]
    named = [(n, steps) for n, steps in zip(leaf_names(paths), paths) if n is not None][:max_leaves]
    out = []
    for name, steps in named:
        value = F.col(col)
        for s in steps:
            value = F.get(value, s) if isinstance(s, int) else value.getField(s)
        out.append(value.alias(name))
    return df.select(*out)


def word_fanout(df: DataFrame, key: str, col: str) -> DataFrame:
    """one row per whitespace-separated word, upper-cased, with its position and the text's last one."""
    d = df.select(key, S.words(col).alias("_words")).withColumn("last_pos", F.size("_words") - 1)
    return d.select(key, "last_pos", F.posexplode("_words").alias("pos", "word")).withColumn(
        "word_upper", F.upper("word"))
