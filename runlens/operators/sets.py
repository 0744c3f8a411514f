"""Sets, dedup, preference picks and category reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.ordered import _SLICE, concat_ordered, materialize_if_shuffled, ordered_scan, plan_slices, with_slice


def dedup_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row per key in arrival order (``min_by`` over the whole row:
    combined map-side, so a key with millions of copies costs one row per task).

    Rows are grouped by a 256-bit digest of the key columns, so long keys are
    neither compared nor shuffled more than once per task and key."""
    digest = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    g = df.groupBy(digest.alias("_key")).agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("_r"),
                                             F.count(F.lit(1)).alias("copies"))
    cols = [*keys, *[c for c in df.columns if c not in keys]]
    return g.select(*[F.col(f"_r.{c}").alias(c) for c in cols], "copies")


def implicit_edges(implied: DataFrame, declared: DataFrame) -> DataFrame:
    """Edges implied by branch and exhaustion targets, minus the declared ones."""
    return implied.select("src", "dst", "kind").distinct().join(
        declared.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def set_gap(want: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Wanted keys that are not had (anti join)."""
    return want.select(key).distinct().join(have.select(key).distinct(), key, "left_anti")


def ref_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Union of two reference sets without repeats."""
    return a.select(key).unionByName(b.select(key)).distinct()


def pick_preferred(df: DataFrame, group: str, prefs: Sequence[Column], has_models: Column,
                   tie: str) -> DataFrame:
    """K2: best row per group: rows with models first, then each preference (true
    first) in order, ties by input order.  ``row_number() = 1`` plans a partial
    WindowGroupLimit, so each map task sends one candidate per group."""
    order = [has_models.desc()] + [p.desc() for p in prefs] + [F.col(tie).asc()]
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def preferred_order(df: DataFrame, local: Column, latency: str, tie: str, groups: Sequence[str]) -> DataFrame:
    """K2: the full ordering per group: local rows first, then by latency, ties by ``tie``; ``place`` from 1."""
    far = df.withColumn("_far", F.coalesce((~local).cast("int"), F.lit(-1)))
    return ordered_scan(far, list(groups), ["_far", latency, tie], index="place").drop("_far")


def category_list(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column, sorted."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def category_breakdown(df: DataFrame, batch: str, category: Column, priority: Column,
                       needs_reply: Column, draft: Column) -> DataFrame:
    """Per batch: count per category, one sorted text ``n cat, ...``, and the number
    of drafts (reply wanted and draft text not blank).  Missing category is
    ``other``, missing priority ``normal``."""
    d = df.select(batch, F.coalesce(category, F.lit("other")).alias("category"),
                  F.coalesce(priority, F.lit("normal")).alias("priority"),
                  (F.coalesce(needs_reply, F.lit(False))
                   & (F.trim(F.coalesce(draft, F.lit(""))) != "")).alias("_draft"))
    per_cat = d.groupBy(batch, "category").agg(F.count(F.lit(1)).alias("n"),
                                               F.count_if("_draft").alias("drafts"))
    # categories per batch are a small bounded set
    return per_cat.groupBy(batch).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "n"))),
                                 lambda s: F.concat(s["n"].cast("string"), F.lit(" "), s["category"])), ", ")
        .alias("breakdown"),
        F.sum("n").cast("long").alias("items"), F.sum("drafts").cast("long").alias("draft_count"))


def first_valid_attempt(responses: DataFrame, keys: Sequence[str], order: str, valid: str, error: str,
                        reasks: int = 2) -> DataFrame:
    """Re-ask loop over recorded responses: the first valid one within ``reasks + 1``
    attempts, else failed with the last error seen inside that budget.  ``row_number() <= n``
    plans a partial WindowGroupLimit: a task sends that many rows per key."""
    w = Window.partitionBy(*keys).orderBy(order)
    r = responses.withColumn("_try", F.row_number().over(w)).where(F.col("_try") <= reasks + 1)
    g = r.groupBy(*keys).agg(
        F.min(F.when(F.col(valid), F.col("_try"))).alias("_first"),
        F.max("_try").alias("_tries"),
        F.max_by(F.col(error), F.col("_try")).alias("_last_error"))
    ok = F.col("_first").isNotNull()
    return g.select(*keys, F.when(ok, "ok").otherwise("failed").alias("status"),
                    F.when(ok, F.col("_first")).otherwise(F.col("_tries")).cast("long").alias("attempts"),
                    F.when(~ok, F.col("_last_error")).alias("error"))


def concat_chunks(pieces: DataFrame, key: str, order: str, text: str, reported: Column | None = None
                  ) -> DataFrame:
    """Streamed pieces joined in order per message; token usage as reported by the
    stream, estimated (max(1, chars div 4)) when it reports none.

    Pieces are joined slice by slice (``concat_ordered``), so no task sorts all pieces of a hot message."""
    rep = reported if reported is not None else F.lit(None).cast("long")
    g = concat_ordered(pieces, [key], [order], text, aggs={"_reported": rep})
    return g.select(key, "text", F.when(F.coalesce(F.col("_reported"), F.lit(0)) > 0, F.col("_reported"))
                    .otherwise(S.estimate_tokens(F.col("text"))).cast("long").alias("tokens"))


def coalesce_turns(conv: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                   text: str = "text", merge_role: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """(turns, system).

    System messages are pulled out and joined by a blank line per conversation.
    Of the rest, consecutive messages with ``merge_role`` are merged into one
    turn.  One ordered pass finds the islands: inside a (key, slice) group by the
    previous message, between slices from each slice's first and last role, on a
    table with one row per (key, slice).  Texts are joined slice by slice.
    """
    system = concat_ordered(conv.where(F.col(role) == "system"), [key], [order], text, "\n\n", out="system")
    rest = materialize_if_shuffled(conv.where(F.col(role) != "system").select(key, order, role, text))
    sliced = with_slice(rest, [order], plan_slices(rest, [order]))
    here = Window.partitionBy(key, _SLICE).orderBy(order)
    before = F.lag(role).over(here)
    starts = F.when(F.row_number().over(here) > 1, (~((F.col(role) == merge_role) & (before == merge_role))).cast("long"))
    local = sliced.withColumn("_start", F.coalesce(starts, F.lit(0))).withColumn(
        "_in_slice", F.sum("_start").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = local.groupBy(key, _SLICE).agg(F.min_by(role, order).alias("_first"), F.max_by(role, order).alias("_last"),
                                          F.sum("_start").alias("_starts"))
    along = Window.partitionBy(key).orderBy(_SLICE)
    opens = (~((F.col("_first") == merge_role) & (F.coalesce(F.lag("_last").over(along), F.lit("")) == merge_role))).cast("long")
    ends = ends.withColumn("_opens", opens).withColumn(
        "_before", F.col("_opens") + F.coalesce(F.sum(F.col("_opens") + F.col("_starts")).over(
            along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = local.join(ends.select(F.col(key).alias("_k"), F.col(_SLICE).alias("_s"), "_before"),
                        F.col(key).eqNullSafe(F.col("_k")) & (F.col(_SLICE) == F.col("_s")))
    part = placed.withColumn("island", F.col("_before") + F.col("_in_slice")).groupBy(key, "island", _SLICE).agg(
        F.min(role).alias(role), F.min(order).alias("first_turn"), F.count(F.lit(1)).alias("merged"), F.count(text).alias("_n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))),
                                 lambda s: s["t"]), "\n").alias("_text"))
    turns = part.groupBy(key, "island").agg(
        F.min(role).alias(role), F.min("first_turn").alias("first_turn"), F.sum("merged").alias("merged"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") > 0, F.struct(
            F.col(_SLICE).alias("s"), F.col("_text").alias("t"))))), lambda s: s["t"]), "\n").alias(text))
    return turns, system
