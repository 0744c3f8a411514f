"""Five-field cron expressions as columns.

Each field is expanded to its sorted set of allowed values with built-in
array functions (``split``/``sequence``/``flatten``), then fire times in a
range are generated from the matching days x hours x minutes only -- no
minute-by-minute scan and no cross product with the trigger table.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import let

# Cron fields with their value ranges (day of week 0-7, 0 and 7 are Sunday).
CRON_FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("dom", 1, 31), ("month", 1, 12), ("dow", 0, 7))
PART_PATTERN = r"^(\*|\d+|\d+-\d+)(/\d+)?$"


# Names that may stand for numbers, and shorthands for whole texts.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
WEEKDAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
SHORTHANDS = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0",
              "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}


def _numbered(field: Column, names: tuple[str, ...], first: int) -> Column:
    def replaced(text: Column) -> Column:
        out = text
        for n, name in enumerate(names, first):
            out = F.regexp_replace(out, rf"\b{name}\b", str(n))
        return F.when(text.rlike("[a-z]"), out).otherwise(text)
    return let(field, replaced)


def _part_values(p: Column, lo: int, hi: int) -> Column:
    # the pattern holds for the whole part, so that its pieces are cut without further patterns
    def limits(cut: Column) -> Column:
        base, step = F.get(cut, F.lit(0)), F.when(F.size(cut) > 1, F.get(cut, F.lit(1)).try_cast("int")).otherwise(F.lit(1))
        ends = F.split(base, "-")
        a = F.when(base == "*", F.lit(lo)).otherwise(F.get(ends, F.lit(0)).try_cast("int"))
        b = F.when(base == "*", F.lit(hi)).when(F.size(ends) > 1, F.get(ends, F.lit(1)).try_cast("int")) \
            .when(F.size(cut) > 1, F.lit(hi)).otherwise(F.get(ends, F.lit(0)).try_cast("int"))
        return F.struct(a.alias("a"), b.alias("b"), step.alias("step"))

    def values(v: Column) -> Column:
        valid = (v["step"] > 0) & (v["a"] >= lo) & (v["b"] <= hi) & (v["a"] <= v["b"])
        return F.when(F.coalesce(valid, F.lit(False)), F.sequence(v["a"], v["b"], v["step"]))
    return F.when(p.rlike(PART_PATTERN), let(let(F.split(p, "/"), limits), values))


def field_values(text: Column, lo: int, hi: int) -> Column:
    """Allowed values of one cron field, or null when the field is invalid."""
    return let(F.transform(F.split(text, ","), lambda p: _part_values(p, lo, hi)), lambda vals: F.when(
        F.forall(vals, lambda v: v.isNotNull()), F.array_sort(F.array_distinct(F.flatten(vals)))))


def parse_cron(cron: Column) -> Column:
    """struct(minute, hour, dom, month, dow arrays, dom_star, dow_star, valid)."""
    whole = F.create_map(*[F.lit(x) for pair in SHORTHANDS.items() for x in pair])

    def parsed(f: Column) -> Column:
        parts = [F.get(f, F.lit(i)) for i in range(5)]
        parts[3], parts[4] = _numbered(parts[3], MONTHS, 1), _numbered(parts[4], WEEKDAYS, 0)
        return F.struct(*[F.when(F.size(f) == 5, field_values(parts[i], lo, hi)).alias(name)
                          for i, (name, lo, hi) in enumerate(CRON_FIELDS)],
                        parts[2].startswith("*").alias("dom_star"), F.get(f, F.lit(4)).startswith("*").alias("dow_star"))

    def judged(c: Column) -> Column:
        valid = F.lit(True)
        for name, _, _ in CRON_FIELDS:
            valid = valid & c[name].isNotNull()
        dow = F.array_distinct(F.transform(c["dow"], lambda d: d % 7))
        return F.struct(*[c[n].alias(n) for n in ("minute", "hour", "dom", "month")], dow.alias("dow"),
                        c["dom_star"].alias("dom_star"), c["dow_star"].alias("dow_star"),
                        F.coalesce(valid, F.lit(False)).alias("valid"))
    fields = let(F.lower(F.trim(cron)), lambda text: F.split(F.coalesce(F.try_element_at(whole, text), text), r"\s+"))
    return let(let(fields, parsed), judged)


def _spread(triggers: DataFrame) -> DataFrame:
    """Triggers over all tasks: a few bytes each, they lie in few files, but their texts take time."""
    return triggers.repartition(max(8, int(triggers.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _day_matches(c: Column, day: Column) -> Column:
    """The day rule of cron: when both day fields are restricted a day matches either; otherwise both must match."""
    dom_ok, dow_ok = F.array_contains(c["dom"], F.dayofmonth(day)), F.array_contains(c["dow"], F.dayofweek(day) - 1)
    day_ok = F.when(~c["dom_star"] & ~c["dow_star"], dom_ok | dow_ok).otherwise(dom_ok & dow_ok)
    return F.array_contains(c["month"], F.month(day)) & day_ok


def _at(day: Column, hour: Column, minute: Column) -> Column:
    return F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), hour, minute, F.lit(0))


def cron_expand(triggers: DataFrame, key: str, cron: str, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """(fires, invalid).  ``fires``: (key, fire_at) for every fire time in [start, end);
    ``invalid``: rows whose cron text does not parse (the valid rows are still expanded).
    """
    p = _spread(triggers.select(key, cron)).select(key, cron, parse_cron(F.col(cron)).alias("c"))
    invalid = p.where(~F.col("c.valid")).select(key, cron)
    days = F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 day"))
    d = p.where(F.col("c.valid")).select(
        key, F.col("c.hour").alias("hours"), F.col("c.minute").alias("minutes"),
        F.explode(let(F.col("c"), lambda c: F.filter(days, lambda day: _day_matches(c, day)))).alias("day"))
    h = d.select(key, "minutes", "day", F.explode("hours").alias("h"))
    m = h.select(key, "day", "h", F.explode("minutes").alias("m"))
    fires = m.select(key, _at(F.col("day"), F.col("h"), F.col("m")).alias("fire_at")).where(
        (F.col("fire_at") >= F.lit(start).cast("timestamp_ntz")) & (F.col("fire_at") < F.lit(end).cast("timestamp_ntz")))
    return fires, invalid


# Days ahead that are looked at, one after the other: the last holds a 29 February across a century.
HORIZONS = (8, 400, 3000)


def next_fire(triggers: DataFrame, key: str, cron: str, now: str) -> DataFrame:
    """(key, next_fire, delay_s) of every valid trigger, its first fire strictly after ``now``, however far.

    A row finds its own: a later time on the day of ``now``, else the first time of the next matching day.  Most
    find that day soon; only the others look further.  One that never fires (30 February) has nulls.  Of rows with
    one key the earliest fire counts.
    """
    at, today = F.lit(now).cast("timestamp_ntz"), F.to_date(F.lit(now).cast("timestamp_ntz"))
    ends = [(datetime.fromisoformat(now) + timedelta(days=days)).isoformat(sep=" ") for days in HORIZONS]

    def later_today(c: Column) -> Column:
        times = F.flatten(F.transform(c["hour"], lambda h: F.transform(c["minute"], lambda m: _at(today, h, m))))
        return F.when(_day_matches(c, today), F.array_min(F.filter(times, lambda t: t > at)))

    def on_day(c: Column, first: Column, end: str) -> Column:
        days = F.sequence(first, F.to_date(F.lit(end)), F.expr("interval 1 day"))
        found = F.array_min(F.filter(days, lambda d: _day_matches(c, d)))
        return let(_at(found, F.array_min(c["hour"]), F.array_min(c["minute"])),
                   lambda t: F.when(t < F.lit(end).cast("timestamp_ntz"), t))

    def first_after(c: Column) -> Column:
        starts = [F.date_add(today, 1), *[F.to_date(F.lit(e)) for e in ends[:-1]]]
        return F.coalesce(later_today(c), *[on_day(c, s, e) for s, e in zip(starts, ends)])
    p = _spread(triggers.select(key, cron)).select(key, parse_cron(F.col(cron)).alias("c")).where(F.col("c.valid"))
    found = p.select(key, let(F.col("c"), first_after).alias("fire_at"))
    per = found.groupBy(key).agg(F.min("fire_at").alias("fire_at"), F.count(F.lit(1)).alias("n"))
    # rows of a key that never fires stay rows of their own
    per = per.select(key, "fire_at", F.explode(F.sequence(F.lit(1).cast("long"), F.when(
        F.col("fire_at").isNull(), F.col("n")).otherwise(F.lit(1).cast("long")))).alias("_i"))
    return per.select(key, F.col("fire_at").alias("next_fire"), _delay(F.col("fire_at"), now).alias("delay_s"))


def _delay(fire_at: Column, now: str) -> Column:
    return (F.unix_micros(fire_at.cast("timestamp")) - F.unix_micros(F.lit(now).cast("timestamp_ntz").cast("timestamp"))) / 1e6


def next_delay(fires: DataFrame, key: str, now: str) -> DataFrame:
    """Seconds from ``now`` to each trigger's next fire time strictly after it."""
    nxt = fires.where(F.col("fire_at") > F.lit(now).cast("timestamp_ntz")).groupBy(key).agg(
        F.min("fire_at").alias("next_fire"))
    return nxt.select(key, "next_fire", _delay(F.col("next_fire"), now).alias("delay_s"))
