"""Guards, retries, barrier, cycles on small tables."""

from pyspark.sql import functions as F

from runlens.operators import graph as G
from runlens.operators import guards as W
from runlens.operators import joins as J


def test_guard_trip_first_step_and_order(spark):
    usage = spark.createDataFrame([("r", s, 100 * s, 100 * (s + 1), 0.0) for s in range(6)],
                                  "run_id string, step int, tokens_before long, tokens_after long, elapsed_s double") \
        .withColumn("cost_micros_before", F.col("tokens_before") * 3) \
        .withColumn("cost_micros_after", F.col("tokens_after") * 3)
    r = W.guard_trip(usage, max_steps=4, tokens=300).first()
    assert (r.step, r.guard) == (3, "tokens")  # tokens reach 300 before step 4 hits max_steps
    warn = W.budget_warnings(usage, max_steps=5, tokens=None).collect()
    assert sorted(x.step for x in warn) == [3, 4, 5]  # step + 1 >= 80 % of max_steps 5


def test_retry_schedule_backoff_and_jitter(spark):
    f = spark.createDataFrame([("r", "n", i, "transient", None) for i in range(1, 5)],
                              "run_id string, node_id string, seq long, kind string, retry_after double")
    plain = [r.delay_s for r in W.retry_schedule(f, attempts=5).orderBy("seq").collect()]
    assert plain == [0.5, 1.0, 2.0, 4.0]
    jit = [r.delay_s for r in W.retry_schedule(f, attempts=5, jitter=True, seed=3).orderBy("seq").collect()]
    assert all(p / 2 <= j <= p for p, j in zip(plain, jit))


def test_merge_barrier_missing_counts_as_skipped(spark):
    edges = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "m")], "source string, merge string")
    arr = spark.createDataFrame([("t1", "a", "ok"), ("t1", "b", "failed"), ("t2", "a", "ok")],
                                "thread_id string, source string, state string")
    got = {r.thread_id: (r.ok, r.failed, r.skipped, r.passed) for r in J.merge_barrier(edges, arr).collect()}
    assert got == {"t1": (1, 1, 1, False), "t2": (1, 0, 2, True)}


def test_cycles_and_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (6, 7), (8, 8), (9, 1), (10, 11),
                               (11, 12), (12, 10), (12, 14), (14, 12)], "src long, dst long")
    assert sorted(r.node for r in G.find_cycles(e).collect()) == [1, 2, 3, 5, 6, 8, 10, 11, 12, 14]
    comp = {r.node: r.component for r in G.cycle_components(e).collect()}
    assert comp == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 8: 8, 10: 10, 11: 10, 12: 10, 14: 10}
    nodes = spark.createDataFrame([(2, 3), (8, None), (14, 1)], "id long, max_iterations int")
    assert sorted(r.node for r in G.unguarded_loops(e, nodes).collect()) == [5, 6, 8]


def test_graph_without_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    assert G.find_cycles(e).count() == 0


def test_long_chains_and_rings_take_few_rounds(spark, monkeypatch):
    tables = []
    real = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: tables.append(1) or real(df))
    chain = [(i, i + 1) for i in range(10_000)]
    ring = [(20_000 + i, 20_000 + (i + 1) % 777) for i in range(777)]
    tied = [(30_000 + i, 30_000 + i + 1) for i in range(300)] + [(30_300, 30_000), (30_100, 30_200), (30_300, 5)]
    assert G.cycle_components(spark.createDataFrame(chain, "src long, dst long")).isEmpty() and len(tables) < 40
    e = spark.createDataFrame(chain + ring + tied, "src long, dst long")
    comp = {r.node: r.component for r in G.cycle_components(e).collect()}
    assert comp == {**{20_000 + i: 20_000 for i in range(777)}, **{30_000 + i: 30_000 for i in range(301)}}


def test_components_against_brute_force(spark):
    import random
    rng = random.Random(12)
    edges = {(rng.randrange(60), rng.randrange(60)) for _ in range(70)} | {(i, i + 1) for i in range(60, 75)} | {(75, 62), (70, 3)}
    reach = {a: {b for x, b in edges if x == a} for a in range(76)}
    for _ in range(7):
        reach = {a: r | {c for b in r for c in reach[b]} for a, r in reach.items()}
    want = {a: min(b for b in reach[a] if a in reach[b]) for a in reach if a in reach[a]}
    got = {r.node: r.component for r in G.cycle_components(spark.createDataFrame(list(edges), "src long, dst long")).collect()}
    assert got == want
