"""Skew-safe ordered scans agree with plain per-key windows, also for a hot key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from runlens.plans.ordered import asof_last, concat_ordered, ordered_scan, plan_slices, with_slice


def _hot(spark):
    # key 0 holds most rows; the order column spans every slice
    rows = [(0 if i % 3 else i % 7, i, i % 5) for i in range(3000)]
    return spark.createDataFrame(rows, "k int, o long, v long")


def test_index_total_and_running_match_windows(spark):
    df = _hot(spark)
    got = ordered_scan(df, ["k"], ["o"], index="idx", total="n", running={"run": "v"},
                       running_before={"before": "v"}, slices=16)
    w = Window.partitionBy("k").orderBy("o")
    exp = df.select("k", "o", F.row_number().over(w).alias("idx"), F.count("*").over(Window.partitionBy("k")).alias("n"),
                    F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    a = {(r.k, r.o): (r.idx, r.n, r.run, r.before) for r in got.collect()}
    b = {(r.k, r.o): (r.idx, r.n, r.run) for r in exp.collect()}
    assert len(a) == len(b) == 3000
    for key, (idx, n, run, before) in a.items():
        assert (idx, n, run) == b[key]
        assert before == run - (key[1] % 5)


def test_descending_index(spark):
    df = _hot(spark)
    got = ordered_scan(df, ["k"], ["o"], descending=True, index="idx", slices=8)
    w = Window.partitionBy("k").orderBy(F.col("o").desc())
    exp = {(r.k, r.o): r.idx for r in df.select("k", "o", F.row_number().over(w).alias("idx")).collect()}
    assert {(r.k, r.o): r.idx for r in got.collect()} == exp


def test_asof_last_carries_across_slices(spark):
    rows = [("t", i, i % 10 == 0, f"c{i}" if i % 10 == 0 else None) for i in range(1, 400)]
    df = spark.createDataFrame(rows, "k string, o long, src boolean, v string")
    got = asof_last(df, ["k"], ["o"], F.col("v"), F.col("src"), "last", slices=16)
    res = {r.o: r.last for r in got.collect()}
    for i in range(1, 400):
        exp = None if i < 10 else f"c{(i // 10) * 10}"
        assert res[i] == exp


def test_ordered_scan_on_text_order_with_shared_prefixes_and_nulls(spark):
    import random
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "cold"]), f"common-prefix-{i:05d}") for i in range(400)] + [("hot", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o string")
    for down in (False, True):
        got = ordered_scan(df, ["k"], ["o"], index="idx", slices=16, descending=down).collect()
        for key in ("hot", "cold"):
            mine = sorted((o for k, o in rows if k == key), key=lambda o: (o is not None, o or ""), reverse=down)
            assert [r.o for r in sorted(got, key=lambda r: r.idx) if r.k == key] == mine


def test_slices_are_cut_inside_a_hot_leading_value(spark):
    df = spark.range(20_000).selectExpr("'k' AS k", "CAST(id % 3 AS INT) AS turn", "id * 7919 % 20011 AS pos")
    sizes = [r["count"] for r in with_slice(df, ["turn", "pos"], plan_slices(df, ["turn", "pos"], 24)).groupBy("_rl_slice").count().collect()]
    assert len(sizes) >= 18 and max(sizes) <= 2500
    got = ordered_scan(df, ["k"], ["turn", "pos"], index="idx", slices=24).orderBy("idx").collect()
    assert [(r.turn, r.pos) for r in got] == sorted((i % 3, i * 7919 % 20011) for i in range(20_000))
    text = spark.range(20_000).selectExpr("concat('start-', format_string('%07d', id)) AS t")
    sizes = [r["count"] for r in with_slice(text, ["t"], plan_slices(text, ["t"], 20)).groupBy("_rl_slice").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 3000


def test_concat_ordered_joins_slices_in_order(spark):
    df = spark.range(3000).selectExpr("id % 2 AS k", "id AS o", "if(id % 7 = 0, null, CAST(id AS STRING)) AS t")
    got = {r.k: r.text for r in concat_ordered(df, ["k"], ["o"], "t", "|", slices=12).collect()}
    assert got == {k: "|".join(str(i) for i in range(k, 3000, 2) if i % 7) for k in (0, 1)}
