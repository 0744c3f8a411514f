"""Suffix dedup, n-gram join and NN-descent against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from runlens.llm.chunks import chunk_table
from runlens.llm.common import Scratch, components
from runlens.llm.ngram_join import _told_apart, jaccard_classes, overlaps, shingle_sets
from runlens.llm.nn_descent import near_classes
from runlens.llm.suffix_dedup import difference_cover, fingerprints, remove_repeats


def test_difference_cover_covers_every_difference():
    for n in (3, 12, 20, 60, 200):
        v, d = difference_cover(n)
        assert v <= max(1, 2 * n // 3 + 1) and {(a - b) % v for a in d for b in d} == set(range(v))


def test_fingerprints_tell_bytes_apart():
    rng = np.random.default_rng(1)
    body = rng.integers(0, 3, 3000).astype(np.uint8)
    for length in (1, 5, 16, 67, 200):
        h = fingerprints(body, length)
        want = {}
        for i in range(len(body) - length + 1):
            want.setdefault(body[i:i + length].tobytes(), set()).add(int(h[i]))
        assert all(len(v) == 1 for v in want.values()) and len({next(iter(v)) for v in want.values()}) == len(want)


def _brute_repeats(texts: list[bytes], n: int):
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - n + 1):
            seen[t[i:i + n]] = seen.get(t[i:i + n], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i:i + n]] > 1:
                gone[i:i + n] = b"\1" * n
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("n", [3, 20])
def test_remove_repeats(spark, n):
    rng = random.Random(n)
    common = "".join(rng.choice("abc") for _ in range(45))
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 5, 19, 20, 21, 60, 200]))) for _ in range(40)]
    texts += [common + str(i) * i + common[:i] for i in range(12)] + ["é" * 40, "é" * 40, None, "", "x" * 500]
    df = spark.createDataFrame([(i if i % 7 else None, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    rows = remove_repeats(df.repartition(3), n, chunk_bytes=400).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == \
        _brute_repeats([(t or "").encode() for t in texts], n)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed and len(r.kept) == r.n_bytes - r.n_removed for r in rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(docs).count() == 0 and jaccard_classes(docs).count() == 0
    vec = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_classes(vec).count() == 0


def _words(t):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))


def _set(t):
    w = _words(t)
    return set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())


def test_shingle_sets_match_words():
    texts = ["", "  ", "a b c d e f a b c d e f", "One two", "ONE TWO", "é à b c\x0bd e\x1cf g", "x " * 40]
    names, owner = shingle_sets("".join(texts).encode(), [len(t.encode()) for t in texts])
    assert [int((owner == k).sum()) for k in range(len(texts))] == [len(_set(t)) for t in texts]
    assert set(names[owner == 3]) == set(names[owner == 4])


def test_overlaps_dense_and_sparse():
    rng = np.random.default_rng(4)
    a = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(40)]
    b = [np.unique(rng.integers(0, 90, 30)).astype(np.uint64) for _ in range(25)]
    want = [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert overlaps(a, b, columns=7).tolist() == want


def _components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_jaccard_classes(spark):
    rng = random.Random(5)
    base = [[rng.choice("abcdefgh") for _ in range(n)] for n in (3, 6, 20, 40, 40, 41)]
    texts = []
    for k in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice("abcdefghABCD")
        texts.append(" ".join(w) if k % 50 else ["", " \n", None][k // 50 % 3])
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links)
           for r in jaccard_classes(df.repartition(3), chunk_bytes=500).collect()}
    sets = [_set(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and
             100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    degree = Counter(x for pair in links for x in pair)
    assert links and got == {i: (len(sets[i]), c, degree[i]) for i, c in _components(range(len(sets)), links).items()}


def test_links_across_blocks_and_second_sums(spark, monkeypatch):
    monkeypatch.setattr("runlens.llm.ngram_join._BLOCK_ROWS", 8)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[:k % 30 + 30]) for k in range(90)]
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_classes(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chunk_bytes=900).collect()}
    sets = [_set(t) for t in texts]
    assert got == {i: (0, sum(100 * len(s & o) >= 75 * len(s | o) for o in sets) - 1) for i, s in enumerate(sets)}

    rows = [(1, 3, 10, 5), (2, 3, 10, 5), (3, 3, 10, 6), (4, 2, 11, 7), (5, 0, 0, 0)]
    sums = spark.createDataFrame(rows, "id long, n long, cls long, check long")
    apart = {r.id: r.cls for r in _told_apart(sums, Scratch(spark, "t")).collect()}
    assert apart[1] == apart[2] == 10 and apart[4] == 11 and apart[5] == 0 and apart[3] not in (10, 11)


def test_jaccard_null_and_repeated_ids(spark):
    t = "a b c d e f g h"
    df = spark.createDataFrame([(5, t), (None, t), (7, "p q r s t u"), (7, t), (9, "p q r s t u"), (1, "")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.component_id) for r in jaccard_classes(df).collect())
    assert got == [(0, 5), (1, 1), (5, 5), (7, 5), (7, 5), (9, 5)]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 60)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in components(df, Scratch(spark, "t")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 60)}}


def test_near_classes(spark):
    rng = np.random.default_rng(2)
    rows, centre = [], rng.standard_normal((60, 16))
    for k in range(900):
        v = centre[k % 60] + rng.standard_normal(16) * rng.choice([0.05, 0.2, 2.0])
        rows.append((k, [float(x) for x in v], int(k % 3)))
    dense = centre[0] + rng.standard_normal((150, 16)) * 0.05
    rows += [(1000 + k, [float(x) for x in v], 0) for k, v in enumerate(dense)]
    rows += [(1200 + k, rows[3][1], rows[3][2]) for k in range(20)]
    rows += [(1300, [0.0] * 16, 0), (1301, None, 0), (1302, [float("nan")] * 16, 0), (1303, rows[0][1], None), (1304, [], 1),
             (1305, [1.0, None] + [0.0] * 14, 1), (1306, [float("inf")] * 16, 1)]
    df = spark.createDataFrame([(*r, True) for r in rows], "vec_id long, embedding array<double>, label int, kept boolean")
    got = {r.vec_id: r for r in near_classes(df).collect()}
    good = [r for r in rows if r[0] < 1300]
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in good])
    hit = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(hit, False)
    want = hit.sum(1)
    found = np.array([got[r[0]].n_links for r in good])
    assert (found <= want).all() and found.sum() >= 0.97 * want.sum() and len(got) == len(rows)
    for i in range(1300, 1307):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_chunks_keep_null_ids_and_whole_texts(spark):
    df = spark.createDataFrame([(2 ** 60 + 1, "abc"), (None, ""), (3, "x" * 50)], "id long, text string")
    rows = chunk_table(df.coalesce(1), Scratch(spark, "t"), 20).collect()
    assert sorted((i or 0, n) for r in rows for i, n in zip(r.ids, r.sizes)) == [(0, 0), (3, 50), (2 ** 60 + 1, 3)]


def test_near_classes_of_two_groups_that_fill_their_lists(spark):
    rng = np.random.default_rng(12)
    n, dim = 250, 256
    a, b = np.linalg.qr(rng.standard_normal((dim, 2)))[0].T
    c = 0.985
    centre = np.repeat([a, c * a + np.sqrt(1 - c * c) * b], n, axis=0)
    x = centre + rng.standard_normal((2 * n, dim)) * np.sqrt(0.047 / dim)
    x = np.concatenate((x, rng.standard_normal((300, dim))))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert links[:n].min() > n
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_classes(df).collect()}
    assert got == {i: (links[i], 0 if i < 2 * n else i) for i in range(len(x))}
