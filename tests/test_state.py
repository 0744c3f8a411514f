"""Reducers fold writes in seq order (table-driven, as the reference's state tests)."""

from pyspark.sql import functions as F

from runlens.operators import state as S

WRITES = [("t1", "r1", "c", 1, 5, "a"), ("t1", "r1", "c", 2, 7, "b"), ("t1", "r1", "c", 3, None, "a"),
          ("t2", "r1", "c", 1, 2, "z")]
SCHEMA = "thread_id string, run_id string, channel string, seq long, value long, map_key string"


def test_last_sum_append_merge(spark):
    w = spark.createDataFrame(WRITES, SCHEMA)
    last = {r.thread_id: r.value for r in S.reduce_last(w).collect()}
    assert last == {"t1": None, "t2": 2}  # a null write replaces the value
    total = {r.thread_id: r.value for r in S.reduce_sum(w).collect()}
    assert total == {"t1": 12, "t2": 2}  # null counts as 0
    app = sorted((r.thread_id, r.pos, r.value) for r in S.reduce_append(w).collect())
    assert app == [("t1", 1, 5), ("t1", 2, 7), ("t1", 3, None), ("t2", 1, 2)]
    merged = {(r.thread_id, r.key): r.value for r in S.reduce_merge_map(w).collect()}
    assert merged == {("t1", "a"): None, ("t1", "b"): 7, ("t2", "z"): 2}


def test_extend_concatenates_lists(spark):
    w = spark.createDataFrame(WRITES, SCHEMA).withColumn(
        "elements", F.when(F.col("seq") == 2, F.array(F.lit(8), F.lit(9))).otherwise(F.array("value")))
    got = sorted((r.thread_id, r.pos, r.value) for r in S.reduce_extend(w).collect())
    assert got == [("t1", 1, 5), ("t1", 2, 8), ("t1", 3, 9), ("t1", 4, None), ("t2", 1, 2)]


def test_channel_type_rules(spark):
    ch = spark.createDataFrame([("c", "int", "last"), ("f", "float", "last"), ("l", "list", "append")],
                               "channel string, type string, reducer string")
    w = spark.createDataFrame([("c", "true"), ("c", "1.5"), ("f", "3"), ("f", "true"), ("l", "[1]"),
                               ("l", "5"), ("c", "null")], "channel string, value_json string")
    bad = sorted((r.channel, r.value_json) for r in S.check_channel_type(w, ch).collect())
    assert bad == [("c", "1.5"), ("l", "5")]  # bool passes int and float, null passes all
