"""Quality rules whose cut-offs adapt to language and source.

No fixed cut-off fits every language and source, so the limits of a rule come
from the data: a mergeable quantile sketch of each measure per (language,
source), fences around its quartiles, and a join that holds every document
against the fences of its own group.  Only DataFrame functions are used.

The sketch is a table of counts per bucket.  Buckets are whole numbers below 64
and 32 equal parts of every further power of two, so a quantile read from the
sketch is at most 1/32 too high, and two sketches merge by adding counts, in any
order and with the same result: a hot group is pre-aggregated by every task, and
a rerun agrees.  (Spark's own KLL sketches choose at random.)  A group of fewer
than ``least_rows`` documents takes the merged sketch of its language, and where
that is as small, the merged sketch of all.

Fences are ``q75 + reach * (q75 - q25) + slack`` and, for measures that can also
be too low, ``q25 - reach * (q75 - q25) - slack``.  They depend on quartiles, so a
quarter of a group may be junk before the fence gives way, and a group without
junk loses next to nothing, where a fixed share would always be cut.

Null and empty texts have no words: all counts are 0 and ``base_failed`` is true.
Null languages and sources are groups of their own.  Rows are judged one by one,
so null and repeated ids stay as they are; an empty table gives an empty result.
Texts are read whole; one text must fit into a task, as it does in any row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.broadcast import bounded_broadcast
from .common import Scratch

_SPACE = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Measure:
    """A whole number per document; ``slack`` is what the fences add to the spread of a group."""
    name: str
    value: Column
    slack: int
    both_sides: bool = False


def _share(part: str, whole: str, unit: int = 1000) -> Column:
    return F.expr(f"({unit} * {part}) div greatest({whole}, 1)")


def measures() -> list[Measure]:
    return [Measure("symbols", _share("n_symbols", "n_words"), 50),
            Measure("capitals", _share("n_capitals", "word_chars"), 150),
            Measure("word_length", _share("word_chars", "n_words", 100), 100, both_sides=True),
            Measure("repeat_words", _share("n_repeat_words", "n_words"), 200),
            Measure("dup_lines", _share("n_dup_lines", "n_lines"), 300)]


def _count_of(chars: str) -> Column:
    return (F.length("text") - F.length(F.translate("text", chars, ""))).cast("long")


def features(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and the counts of every text: n_words, word_chars, n_symbols, n_capitals, n_lines, n_dup_lines, n_repeat_words.

    Equal windows of a text are found by sorting its window hashes; neighbours
    with one hash are compared word by word.  Every repeated window covers the
    words up to the next repeated one, eight at most.
    """
    split = docs.select(*keys, F.coalesce("text", F.lit("")).alias("text")) \
        .withColumn("words", F.array_remove(F.split("text", _SPACE), "")) \
        .withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0))
    hashed = split.select(
        *keys, "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        _count_of(_SYMBOLS).alias("n_symbols"), _count_of(_CAPITALS).alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") > _WINDOW, F.transform(
            F.sequence(F.lit(1), F.size("words") - (_WINDOW - 1)),
            lambda i: F.xxhash64(F.slice("words", i, _WINDOW)))).alias("hashes"))
    plain = [*keys, "n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines"]
    order = F.when(F.size("hashes") > F.size(F.array_distinct("hashes")), F.sort_array(F.transform(
        "hashes", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("at")))))
    # two references to each list below keep Spark from folding its making into the lambdas
    sorted_ = hashed.select(*plain, "words", order.alias("sorted"))

    def same(x: Column, other: Column) -> Column:
        y = F.get(F.col("sorted"), other)
        return F.coalesce((y["h"] == x["h"]) & (F.slice("words", y["at"], _WINDOW) == F.slice("words", x["at"], _WINDOW)),
                          F.lit(False))

    twice = F.filter("sorted", lambda x, j: same(x, j - 1) | same(x, j + 1))
    found = sorted_.select(*plain, F.when(F.size("sorted") > 0, F.sort_array(
        F.transform(twice, lambda x: x["at"]))).alias("found"))
    covered = F.aggregate("found", F.struct(F.lit(0).alias("last"), F.lit(0).alias("n")), lambda s, x: F.struct(
        x.alias("last"), (s["n"] + F.when(s["last"] == 0, _WINDOW).otherwise(F.least(x - s["last"], F.lit(_WINDOW)))).alias("n")))
    return found.select(*plain, F.coalesce(covered["n"], F.lit(0)).cast("long").alias("n_repeat_words"))


def bucket_of(v: Column) -> Column:
    """Bucket of a whole number: itself below 64, else 32 buckets for every power of two."""
    e = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (e * 32 + F.call_function("shiftright", v, e)).cast("int")


def top_of(bucket: Column) -> Column:
    """The largest value of a bucket."""
    e = F.greatest(F.floor(bucket / 32).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", (bucket - e * 32 + 1).cast("long"), e) - 1


def sketch(values: DataFrame, by: list[str], named: list[Measure]) -> DataFrame:
    """Quantile sketches of all measures: ``by``, measure, bucket, n."""
    pairs = F.array(*[F.struct(F.lit(m.name).alias("measure"), bucket_of(F.col(f"m_{m.name}")).alias("bucket"))
                      for m in named])
    return values.select(*by, F.explode(pairs).alias("p")).groupBy(*by, "p.measure", "p.bucket") \
        .agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of coarser groups."""
    return sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """``by``, measure, rows, q25, q75 from the running counts of each sketch."""
    whole = Window.partitionBy(*by, "measure")
    ranked = sketches.withColumn("upto", F.sum("n").over(whole.orderBy("bucket"))) \
        .withColumn("total", F.sum("n").over(whole))

    def at(q: int) -> Column:
        return F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, top_of(F.col("bucket"))))
    return ranked.groupBy(*by, "measure").agg(F.max("total").alias("rows"), at(25).alias("q25"), at(75).alias("q75"))


def fences(sketches: DataFrame, named: list[Measure], reach: int, least_rows: int) -> DataFrame:
    """lang, source, and per measure ``hi_`` and ``lo_``: the limits of the smallest group with ``least_rows`` documents."""
    own = quartiles(sketches, ["lang", "source"])
    tongue = quartiles(merge(sketches, ["lang"]), ["lang"]).toDF("l_lang", "l_measure", "l_rows", "l_q25", "l_q75")
    every = quartiles(merge(sketches, []), []).toDF("e_measure", "e_rows", "e_q25", "e_q75")
    joined = own.join(bounded_broadcast(tongue), F.col("lang").eqNullSafe(F.col("l_lang"))
                      & (F.col("measure") == F.col("l_measure"))).join(F.broadcast(every), F.col("measure") == F.col("e_measure"))

    def chosen(q: str) -> Column:
        return F.when(F.col("rows") >= least_rows, F.col(q)).when(F.col("l_rows") >= least_rows, F.col(f"l_{q}")) \
            .otherwise(F.col(f"e_{q}"))
    slack = F.create_map(*[F.lit(x) for m in named for x in (m.name, m.slack)])[F.col("measure")]
    spread = (F.col("b") - F.col("a")) * reach + slack
    limits = joined.select("lang", "source", "measure", chosen("q25").alias("a"), chosen("q75").alias("b")) \
        .select("lang", "source", "measure", (F.col("b") + spread).alias("hi"), (F.col("a") - spread).alias("lo"))
    return limits.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m.name, F.col(side))).alias(f"{side}_{m.name}")
                                                  for m in named for side in ("hi", "lo")])


def judge(docs: DataFrame, keys: list[str], lang: str = "lang", source: str = "source", reach: int = 6,
          least_rows: int = 100) -> DataFrame:
    """``keys``, the counts, base_failed, failed (names of the measures beyond a fence) and kept, one row per document.

    ``docs`` needs a column ``text``; other columns are not read.
    """
    named = measures()
    ids = [f"key_{k}" for k in range(len(keys))]
    read = docs.select(*[F.col(k).alias(i) for k, i in zip(keys, ids)], F.col(lang).alias("lang"),
                       F.col(source).alias("source"), "text")
    scratch = Scratch(docs.sparkSession, "quality-rules")
    valued = scratch.keep(features(read, [*ids, "lang", "source"]).select(
        "*", *[m.value.alias(f"m_{m.name}") for m in named]), "features")
    limits = fences(scratch.keep(sketch(valued, ["lang", "source"], named), "sketches"), named, reach, least_rows)
    limits = bounded_broadcast(scratch.keep(limits.withColumnsRenamed({"lang": "of_lang", "source": "of_source"}), "fences"))
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    beyond = []
    for m in named:
        v = F.col(f"m_{m.name}")
        out = v > F.col(f"hi_{m.name}")
        beyond.append(F.when(out | (v < F.col(f"lo_{m.name}")) if m.both_sides else out, F.lit(m.name)))
    return valued.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left") \
        .withColumn("base_failed", base).withColumn("failed", F.array_compact(F.array(*beyond))).select(
            *[F.col(i).alias(k) for k, i in zip(keys, ids)], "n_words", "word_chars", "n_symbols", "n_dup_lines",
            "n_repeat_words", "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))
