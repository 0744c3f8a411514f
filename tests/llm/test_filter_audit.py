"""Filter audit: tries against dictionaries, ranges of any size, and the whole table against brute force."""

import random
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from runlens.llm import filter_audit as fa
from runlens.llm.common import Scratch


def test_trie_holds_smallest_ids():
    rng = random.Random(1)
    texts = [b"", b"a", b"ab", b"abc" * 100, b"abc" * 100 + b"d", b"abc" * 99] + \
        ["".join(rng.choice("aß") for _ in range(rng.randrange(12))).encode() for _ in range(500)]
    trie, want = fa.TextTrie(), {}
    for i, t in enumerate(texts):
        ident = rng.randrange(50)
        trie.insert(t, ident, ("x", i % 2), 1)
        best = want.setdefault(t, {})
        best.setdefault(ident, {}).setdefault(("x", i % 2), 0)
        best[ident][("x", i % 2)] += 1
    got = {t: (n.least, n.rows) for t, n in trie.terminals()}
    assert got == {t: (min(b), b[min(b)]) for t, b in want.items()}
    assert trie.held <= sum(len(t) for t in set(texts))


def _conditions(t):
    words = t.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    words = [w for w in words if w]
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t)}


def _brute(rows, labels):
    docs = []
    for i, t, lang in rows:
        f = _conditions(t or "")
        f["E"] = i is not None and any(j is not None and j < i and (u or "") == (t or "") for j, u, _ in rows)
        docs.append((lang or "", f, any(k == i and i is not None and q == 1 for k, q, _ in labels),
                     any(k == i and i is not None and x == 1 for k, _, x in labels)))
    out = {}
    for part in {d[0] for d in docs}:
        shapley = dict.fromkeys("ABCDE", 0)
        for p in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for s, k in enumerate(p, 1):
                goes, stay = [d for d in left if d[1][k]], [d for d in left if not d[1][k]]
                failing = [d for d in docs if d[0] == part and d[1][k]]
                out[part, "".join(p), s] = [len(stay), len(goes), len(failing) - len(goes),
                                            sum(sum(d[1].values()) == 1 for d in failing), sum(d[2] for d in goes), sum(d[3] for d in goes)]
                shapley[k] += len(goes)
                left = stay
        for p in permutations("ABCDE"):
            for s, k in enumerate(p, 1):
                out[part, "".join(p), s].append(shapley[k])
    return out


def _rows(n=150):
    rng = random.Random(9)
    rows = []
    for i in range(n):
        kind = rng.randrange(6)
        words = [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(rng.choice([3, 210]))]
        text = [" ".join(words), "The same text", "SHOUT " + words[0], "w " * 250, " ".join(words) + "#", None][kind]
        rows.append((rng.choice([i, i, i % 7, None]), text, rng.choice(["aa", "", None])))
    return rows + [(2**53 + 1, "é\x0bé", "aa"), (2**53, "é\x0bé", "aa"), (5, "", "aa"), (5, "", "aa")]


@pytest.mark.parametrize("limit", [32 << 20, 300])
def test_audit_against_brute_force(spark, limit):
    rows = _rows()
    labels = [(i, i % 2, (i % 3 == 0) + 0) for i in range(0, 150, 2)] + [(4, 1, 0), (None, 1, 1), (6, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("mask", F.lit("x")).repartition(5)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = fa.audit(fa.mask_counts(docs, known, trie_bytes=limit, range_bytes=limit)).collect()
    want = _brute(rows, labels)
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley]
            for r in got} == want and len(got) == len(want)
    assert fa.audit(fa.mask_counts(docs.limit(0), known)).collect() == []


def test_prefixes_grow_until_ranges_fit_and_hot_texts_thin_out(spark):
    rng = random.Random(2)
    shared = "x" * 600
    texts = [shared + str(i) for i in range(40)] + ["y" * 20 + str(rng.random()) for _ in range(40)] + ["z" * 50] * 300
    rows = [(i, "p", 0, 1, t.encode(), t.encode()[:32], len(t)) for i, t in enumerate(texts)]
    local = spark.createDataFrame(rows, fa._LOCAL)
    scratch = Scratch(spark, "t")
    keyed, used = fa.prefix_keys(local, scratch, 2000)
    sums = keyed.groupBy("key").agg(F.sum("size").alias("b"), F.countDistinct("text").alias("n")).where("b > 2000").collect()
    assert [r.n for r in sums] == [1] and used == len(fa._STEPS)
    got = {(r.id, r.rows) for r in fa.first_rows(local, scratch, 2000).collect()}
    assert got == {(i, 1) for i in range(81)}
