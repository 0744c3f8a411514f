"""Sets, zips, upserts, cache probes and frontier order on small tables."""

from runlens.operators import joins as J
from runlens.operators import sets as U
from runlens.operators import state as S
from runlens.sources import sinks as K


def test_dedup_first_keeps_arrival_order(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "id long, text string")
    got = {r.text: (r.id, r.copies) for r in U.dedup_first(df, ["text"], "id").collect()}
    assert got == {"a": (1, 2), "b": (2, 1)}


def test_zip_by_position_cuts_to_shorter(spark):
    a = spark.createDataFrame([(1, 10), (1, 11), (1, 12)], "k long, t long")
    b = spark.createDataFrame([(1, 20), (1, 21)], "k long, t long")
    got = sorted((r.pos, r.a_t, r.b_t) for r in J.zip_by_position(a, b, "k", "t").collect())
    assert got == [(1, 10, 20), (2, 11, 21)]


def test_upsert_keep_last_and_cache_probe(spark):
    base = spark.createDataFrame([(1, "old", 1), (2, "old", 1)], "k long, v string, ver int")
    delta = spark.createDataFrame([(2, "new", 2), (3, "new", 2)], "k long, v string, ver int")
    got = {r.k: r.v for r in K.upsert_keep_last(base, delta, ["k"], "ver").collect()}
    assert got == {1: "old", 2: "new", 3: "new"}
    cached, todo = J.cache_probe(base, delta.select("k"), ["k"])
    assert [r.k for r in cached.collect()] == [2] and [r.k for r in todo.collect()] == [1]


def test_frontier_order_restores_declared_order(spark):
    done = spark.createDataFrame([("r", 0, "c"), ("r", 0, "a"), ("r", 0, "b")], "run string, step int, node_id string")
    frontier = spark.createDataFrame([("r", 0, ["b", "c", "a"])], "run string, step int, frontier array<string>")
    got = sorted((r.pos, r.node_id) for r in S.frontier_order(done, frontier, ["run", "step"]).collect())
    assert got == [(0, "b"), (1, "c"), (2, "a")]


def test_set_gap_and_union(spark):
    want = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    have = spark.createDataFrame([(2,)], "k long")
    assert [r.k for r in U.set_gap(want, have, "k").collect()] == [1, 3]
    assert sorted(r.k for r in U.ref_union(want, have, "k").collect()) == [1, 2, 3]


def test_broadcast_is_bounded_in_rows_and_bytes(spark):
    from pyspark.sql import functions as F

    from runlens.plans.broadcast import bounded_broadcast
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array(F.lit("yy")).alias("a"))

    def hinted(d):
        return "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(bounded_broadcast(df)) and not hinted(bounded_broadcast(df, max_rows=99))
    assert not hinted(bounded_broadcast(df, max_bytes=50_000)) and hinted(bounded_broadcast(df.limit(0), max_bytes=1))
