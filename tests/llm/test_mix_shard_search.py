"""Mixing, resharding and search against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm.bm25 import Shard, idf, search, terms
from runlens.llm.mixing import flight, land, mix, water_fill
from runlens.llm.reshard import even_capacity, min_cost_flow, reshard, reshard_files, rewrite_affected


def test_water_fill_reshares_what_is_above_the_ceiling():
    got = water_fill({"a": 10, "b": 100, "c": 100}, {"a": 5.0, "b": 2.0, "c": 1.0}, 1.5, 2.0)
    assert got["a"] == 20 and sum(got.values()) == pytest.approx(315)
    assert got["b"] == pytest.approx(295 * 2 / 3) and got["c"] == pytest.approx(295 / 3)
    assert water_fill({}, {}, 1.5, 2.0) == {} and water_fill({"a": 0}, {"a": 1.0}, 1.5, 2.0) == {"a": 0.0}


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    size = rng.integers(0, 500, 400)
    p = flight(np.full(400, 0.37), size, np.random.default_rng(1))
    open_ = (p > 0) & (p < 1)
    assert open_.sum() <= 2 and p.sum() == pytest.approx(0.37 * 400) and p @ size == pytest.approx(0.37 * size.sum())
    q = land(p, size)
    assert set(q) <= {0.0, 1.0} and abs(q @ size - 0.37 * size.sum()) <= size.max()
    assert set(flight(np.full(5, 0.5), np.full(5, 7), np.random.default_rng(1))) <= {0.0, 1.0, 0.5}


def test_flight_is_unbiased():
    size = np.array([1, 2, 3, 4, 5, 60])
    mean = np.mean([flight(np.full(6, 0.5), size, np.random.default_rng(s)) for s in range(800)], axis=0)
    assert np.abs(mean - 0.5).max() < 0.06


def test_mix(spark):
    rows = [(i if i % 50 else None, ["a", "b", "c", None][i % 4], i % 97 + 1, "t") for i in range(4000)] + [(1, "z", 0, "t")]
    df = spark.createDataFrame(rows, "doc_id long, source string, words long, copies string")
    out = mix(df, F.col("words"), block_rows=300)
    got = out.collect()
    assert len(got) == len(rows) and all(r.taken == r.copies * r["size"] and 0 <= r.copies <= 2 for r in got)
    per = {r.source: r for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"),
                                                         F.sum("size").alias("size")).collect()}
    assert sum(r.target for r in per.values()) == pytest.approx(1.5 * sum(r["size"] for r in per.values()))
    assert all(abs(r.taken - r.target) <= 97 for r in per.values())
    again = mix(df.repartition(5), F.col("words"), block_rows=300)
    assert sorted((r.doc_id or 0, r.taken) for r in again.where("doc_id is not null").collect()) == \
        sorted((r.doc_id or 0, r.taken) for r in got if r.doc_id is not None)
    assert mix(df.limit(0), F.col("words")).count() == 0


def test_min_cost_flow_is_optimal_and_meets_capacities():
    got = min_cost_flow({0: 100, 1: 10, 2: 10}, even_capacity(120, 4))
    assert sum(v for (o, n), v in got.items() if o != n) == 70
    assert {n: sum(v for (_, m), v in got.items() if m == n) for n in range(4)} == {n: 30 for n in range(4)}
    dear = min_cost_flow({0: 10}, {1: 5, 2: 10}, {(0, 1): 1, (0, 2): 9})
    assert dear == {(0, 1): 5, (0, 2): 5}
    with pytest.raises(ValueError):
        min_cost_flow({0: 10}, {0: 9})


def test_reshard(spark, tmp_path):
    rows = [(i if i % 90 else None, "w" * (i % 60) if i % 40 else None, "x") for i in range(3000)]
    rows += [(10_000 + i, "same text", "x") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    old = F.pmod(F.hash(F.coalesce("text", F.lit(""))), F.lit(3))
    got = reshard(df, old, 4, blocks=256).collect()
    assert len(got) == len(rows)
    size = [sum(r.size for r in got if r.shard == s) for s in range(4)]
    assert max(size) - min(size) <= 0.12 * sum(size) / 4
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert len({r.shard for r in got if r.doc_id and r.doc_id >= 10_000}) == 1
    assert reshard(df.limit(0), old, 4).count() == 0
    unique = df.where("doc_id is not null")
    placed = reshard(unique, old, 4)
    touched = rewrite_affected(unique.select("doc_id", "text"), placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == placed.where(F.col("shard").isin(touched)).count()


def _plain(docs, queries, k):
    words = {d: terms(t) for d, t in docs}
    n, mean = len(docs), sum(map(len, words.values())) / max(1, len(docs))
    out = []
    for q, text in queries:
        best = []
        for d, ws in words.items():
            s, hit = 0.0, False
            for t in sorted(set(terms(text))):
                tf = ws.count(t)
                if tf:
                    hit = True
                    having = sum(t in w for w in words.values())
                    s += terms(text).count(t) * idf(n, having) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
            if hit:
                best.append((-round(s, 6), d))
        out += [(q, r + 1, d, -s) for r, (s, d) in enumerate(sorted(best)[:k])]
    return sorted(out)


def test_search_equals_scoring_every_document(spark):
    rng = np.random.default_rng(3)
    vocab = np.array([f"w{i}" for i in range(60)])
    docs = [(i, " ".join(vocab[np.minimum(59, rng.geometric(0.08, rng.integers(0, 40)))])) for i in range(500)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)] + [(2000, None), (2001, "")]
    queries = [(0, "w1 W2 w30"), (1, "w5 w5 w59 w58"), (2, "nothing here"), (3, None), (4, docs[7][1])]
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, score string").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, query string")
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in search(d, q, 8, shard_bytes=3000).collect())
    want = _plain(docs, queries, 8)
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(math.isclose(g[3], w[3], abs_tol=2e-6) for g, w in zip(got, want))
    assert search(d.limit(0), q).count() == 0


def test_bounds_skip_documents_but_lose_nothing():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    p = 1.0 / np.arange(1, 401)
    texts = [" ".join(rng.choice(words, p=p / p.sum(), size=rng.integers(1, 60))).encode() for _ in range(1500)] + [b"", b"w399 w398"]
    s = Shard(texts, 30.0)
    assert 0 < s.matrix.shape[1] < len(s.terms) and s.block_max.shape[0] == -(-len(texts) // 64)
    having = {t: sum(t in set(terms(x.decode())) for x in texts) for t in s.terms}
    queries, want = [], []
    for text in [*texts[:70], b"w399 w398", b"w1", b""]:
        times = [(t, text.split().count(t)) for t in sorted(set(text.split()))]
        weight = {t: n * idf(len(texts), having[t]) for t, n in times}
        queries.append((np.array([s.terms[t] for t in weight], dtype=np.int64), np.array(list(weight.values()))))
        full = []
        for d, x in enumerate(texts):
            mine = x.split()
            score = sum(w * mine.count(t) * 2.2 / (mine.count(t) + 1.2 * (0.25 + 0.75 * len(mine) / 30.0)) for t, w in weight.items())
            if score > 0:
                full.append((-round(score, 6), d))
        want.append(sorted(full)[:5])
    for limits in (np.full(len(queries), -1.0), np.array([-w[-1][0] - 1e-6 if len(w) == 5 else -1.0 for w in want])):
        got = dict(s.search(queries, 5, limits))
        assert [[(-x, d) for x, d in got.get(j, [])] for j in range(len(queries))] == want
    # with the k-th best score known, fewer documents are scored in full
    assert s.scored < 0.9 * len(queries) * len(texts)


def test_search_by_every_twentieth_document(spark, tmp_path):
    from runlens.llm.queries import op2_bm25
    rng = np.random.default_rng(4)
    docs = [(i, " ".join(f"w{x}" for x in rng.geometric(0.03, rng.integers(1, 60)))) for i in range(240)] + [(240, None), (260, "w1 w9")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    # the benchmark has no say in which queries are asked
    spark.createDataFrame([(20, "w1")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in op2_bm25(spark, str(tmp_path)).collect())
    want = _plain(docs, [(i, t) for i, t in docs if i % 20 == 0], 10)
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(math.isclose(g[3], w[3], abs_tol=2e-6) for g, w in zip(got, want))


def test_search_in_query_blocks_equals_search_in_one(spark):
    rng = np.random.default_rng(6)
    docs = [(i if i % 9 else None, " ".join(f"w{x}" for x in rng.geometric(0.02, rng.integers(1, 80)))) for i in range(400)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    q = d.where("doc_id % 5 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    q = q.unionByName(q.limit(2)).unionByName(q.limit(1).withColumn("query_id", F.lit(None).cast("long")))
    one = search(d, q, 4).collect()
    many = search(d, q, 4, shard_bytes=2000, query_bytes=900).collect()
    assert len(one) == 4 * q.count() and sorted(map(str, one)) == sorted(map(str, many))


def test_answers_handed_on_do_not_grow_with_the_shards(spark, monkeypatch):
    from runlens.llm import bm25
    kept = {}
    plain = bm25.Scratch.keep
    monkeypatch.setattr(bm25.Scratch, "keep", lambda self, df, name, *a: kept.setdefault(name, plain(self, df, name, *a)))
    monkeypatch.setattr(bm25, "_TASKS", 1 / spark.sparkContext.defaultParallelism, raising=False)
    rng = np.random.default_rng(9)
    docs = [(i, " ".join(f"w{x}" for x in rng.geometric(0.05, rng.integers(5, 60)))) for i in range(600)]
    queries = [docs[i] for i in range(0, 600, 40)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    q = spark.createDataFrame(queries, "query_id long, query string")
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in search(d, q, 5, shard_bytes=2000).collect())
    assert [g[:3] for g in got] == [w[:3] for w in _plain(docs, queries, 5)]
    # one task meets some fifty shards and hands on one list of five for every query
    assert kept["found"].count() == 5 * len(queries)


def test_words_are_split_as_bytes_split_them():
    from runlens.llm.bm25 import _words
    texts = ["A b\ta  b\u00a0c\r\n".encode(), b"", b" \x0b\x0c ", "\u0085\u2003x \x1cy z".encode(), b"a"]
    words, term, length = _words(texts)
    assert [words[t].as_py() for t in term.tolist()] == [w for t in texts for w in terms(t.decode())]
    assert length.tolist() == [len(terms(t.decode())) for t in texts]


def test_reshard_of_a_hot_group_and_of_rows_without_ids_of_their_own(spark, tmp_path):
    rows = [(i % 50 if i % 3 else None, f"text {i} " + "x" * (i % 40)) for i in range(2400)]
    rows += [(7 if i % 2 else None, "the same text again and again") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    old = F.pmod(F.hash("text"), F.lit(6))
    got = reshard(df, old, 8).collect()
    size = [sum(r["size"] for r in got if r.shard == s) for s in range(8)]
    assert len(got) == len(rows) and max(size) <= 1.03 * sum(size) / 8 and min(size) >= 0.97 * sum(size) / 8
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    with pytest.raises(ValueError):
        rewrite_affected(df, reshard(df, old, 8), str(tmp_path / "refused"))
    touched = reshard_files(df, old, 8, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert touched == list(range(8))
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, df.collect()))
