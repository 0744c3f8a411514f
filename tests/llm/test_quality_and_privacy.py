"""Quality classifier, segment model, pipeline and the registered queries."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from runlens.llm import segments
from runlens.llm.nbsvm import Indicators, Model, dual_descent, fit, log_ratios, platt
from runlens.llm.queries import QUERIES, held_out

SF = "/root/testdata/sf0.001"


def test_descent_separates_and_meets_the_dual_conditions():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.concatenate((rng.integers(0, 40, 8), rng.integers(40, 50, 3) if k % 2 else rng.integers(50, 60, 3))))
            for k in range(200)]
    y = np.array([1.0 if k % 2 else -1.0 for k in range(200)])
    pos, neg = (np.bincount(np.concatenate([r for r, t in zip(rows, y) if t == s]), minlength=60) for s in (1.0, -1.0))
    ratio = log_ratios(pos, neg)
    w = dual_descent(rows, y, ratio)
    margin = np.array([w[r] @ (ratio[r] / np.linalg.norm(ratio[r])) + w[-1] for r in rows])
    assert (np.sign(margin) == y).all()
    a, b = platt(margin, y)
    assert a > 0 and ((1 / (1 + np.exp(-(a * margin + b))) >= 0.5) == (y > 0)).all()


def test_classifier_held_out_accuracy_and_odd_rows(spark):
    got = QUERIES["op1_quality"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.97
    docs = spark.createDataFrame([(i, ["good words here", "BAD!! BAD!!"][i % 2], 0.5) for i in range(40)] + [(None, None, 0.1), (50, "", 0.1)],
                                 "doc_id long, text string, score double")
    lab = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)] + [(3, 0), (None, 1), (7, None)], "doc_id long, quality int")
    model = fit(docs, lab)
    out = docs.select("doc_id", model.score(F.col("text")).alias("s")).collect()
    assert len(out) == 42 and all(0 <= r.s <= 1 for r in out)
    assert all((r.s >= 0.5) == (r.doc_id % 2 == 0) for r in out if r.doc_id is not None and r.doc_id < 40)
    one = fit(docs, lab.where("quality = 1"))
    assert isinstance(one, Model) and one.one(Indicators().of("x")) > 0.99
    assert fit(docs.limit(0), lab.limit(0)).one(Indicators().of("")) > 0.99


def test_held_out_rule(spark):
    import zlib
    df = spark.range(200).select(F.col("id").alias("doc_id")).withColumn("h", held_out())
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in df.collect())


def _plain_rules(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and segments.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_rules_equal_the_plain_patterns():
    rng = random.Random(4)
    fixed = ["a@b.c@d.e", "x@y x@y.z. a.b@c-d.e..f", "1.2.3.4.5.6.7.8 0001.2.3.255 1.2.3.256 999999.1.1.1", "4111 1111-1111 1111 1",
             "+1 (918) 555-4124 +1(((((2 +12345678901", "", "@", "a" * 300 + "@b.co", "9" * 400, "é+1 918 555 4124@x.y"]
    fixed += ["".join(rng.choice("ab1290.@+- ()%é\n") for _ in range(60)) for _ in range(1500)]
    for t in fixed:
        assert segments.rule_spans(t) == _plain_rules(t), t


def test_rules_stay_linear_on_long_runs():
    for t in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 100_000, "a.b" * 60_000 + "@", "+1" + "(" * 100_000):
        segments.rule_spans(t)
        segments.regions(t[:20_000])


def _brute_best(lat, s):
    best = [(0.0, ())]
    for j in range(1, len(lat.toks) + 1):
        options = [best[j - 1]]
        for n in lat.by_end[j]:
            for k in range(len(segments.KINDS)):
                v, path = best[lat.spans[n][0]]
                options.append((v + s[n, k], (*path, (n, k))))
        best.append(max(options, key=lambda o: o[0]))
    return best[-1]


def _all_paths(lat, s, j):
    if j == 0:
        return [(0.0, ())]
    out = list(_all_paths(lat, s, j - 1))
    for n in lat.by_end[j]:
        for v, p in _all_paths(lat, s, lat.spans[n][0]):
            out += [(v + s[n, k], (*p, (n, k))) for k in range(len(segments.KINDS))]
    return out


def test_dynamic_programme_and_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    lat = segments.Lattice("a 1.2 b@3", 0, 9, {}, learn=True)
    s = rng.standard_normal((len(lat.spans), 4))
    paths = _all_paths(lat, s, len(lat.toks))
    top = max(paths, key=lambda p: p[0])
    assert tuple(lat.best(s)) == top[1] == _brute_best(lat, s)[1]
    z = np.logaddexp.reduce([v for v, _ in paths])
    want = np.zeros_like(s)
    for v, p in paths:
        for n, k in p:
            want[n, k] += np.exp(v - z)
    assert np.allclose(lat.marginals(s), want)


def _private_texts(n, seed):
    rng = random.Random(seed)
    def one():
        return rng.choice([f"mail x{rng.randrange(99)}.y@host{rng.randrange(9)}.example.com now",
                           f"from {rng.randrange(1, 255)}.{rng.randrange(255)}.{rng.randrange(255)}.{rng.randrange(255)} today",
                           f"call +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} soon", "version 2.0 of 1999 has 14 parts"])
    return [one() for _ in range(n)]


def test_segment_model_learns_the_rules_spans():
    index, w = segments.train(_private_texts(250, 1))
    hit = miss = 0
    for t in _private_texts(120, 2):
        found = set()
        for lo, hi in segments.regions(t):
            lat = segments.Lattice(t, lo, hi, index)
            found |= {(lat.toks[lat.spans[n][0]][0], k, lat.toks[lat.spans[n][1] - 1][1]) for n, k in lat.best(lat.scores(w) - 2.0)}
        gold = set(segments.rule_spans(t))
        hit += len(found & gold)
        miss += len(found ^ gold)
    assert hit >= 80 and miss <= 0.05 * hit


def test_blocks_of_tokens_equal_one_lattice(monkeypatch):
    index, w = segments.train(_private_texts(250, 1))
    monkeypatch.setattr(segments, "_STEP", 7)
    rng = random.Random(8)
    parts = ["+49 30 1234567", "10.0.0.1", "a.b@c.de", "4111 1111 1111 1111", "12", "5a", "(7)", "x", "@", "3.14", "+1 (555) 010-2233"]
    some = 0
    for n in [1, 2, 3, 6, 7, 8, *range(20, 70)]:
        t = rng.choice([" ", "  ", "\n"]).join(rng.choice(parts) for _ in range(n))
        lat = segments.Lattice(t, 0, len(t), index)
        s = lat.scores(w) - segments._PRIOR
        sure, want = lat.marginals(s), []
        for c, k in lat.best(s):
            i, j = lat.spans[c]
            want.append((lat.toks[i][0], k, lat.toks[j - 1][1], sure[c, k]))
        got = segments.Chain(t, 0, len(t), index, w).chosen()
        assert [g[:3] for g in got] == [x[:3] for x in want]
        assert np.allclose([g[3] for g in got], [x[3] for x in want], atol=1e-9)
        some += len(got)
    assert some > 100
    assert segments.Chain("", 0, 0, index, w).chosen() == []


def test_long_stretches_are_found_alike_in_bounded_memory(monkeypatch):
    index, w = segments.train(_private_texts(250, 1))
    find = segments.Finder(index, w)
    t = " ".join(["12 34 5a mail bob@example.org or +49 30 1234567 now 10.0.0.300"] * 60)
    base = segments.rule_spans(t)
    plain = find.added(t, base), find.added(t, [])
    monkeypatch.setattr(segments, "_LONG", 100)
    monkeypatch.setattr(segments, "_STEP", 64)
    held = []
    made = segments.Lattice.scores
    monkeypatch.setattr(segments.Lattice, "scores", lambda self, w: held.append(len(self.spans)) or made(self, w))
    assert (find.added(t, base), find.added(t, [])) == plain and plain[1]
    find.added("12 34 5a " * 400, [])
    assert max(held) <= 64 * segments.MAX_TOKENS


def test_private_query_equals_the_rules(spark):
    rows = QUERIES["op6_private"](spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = [f"{segments.KINDS[k]}:{a}:{b}" for a, k, b in _plain_rules(texts[r.doc_id])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | {""}
        assert [r[f"n_{k}"] for k in segments.KINDS] == [sum(b.startswith(k) for b in base) for k in segments.KINDS]


def test_mask_and_null_texts(spark):
    df = spark.createDataFrame([(1, "to a@b.co and 1.2.3.4"), (2, None), (3, ""), (4, "é +1 918 555 4124!")], "doc_id long, text string")
    found = df.withColumn("s", segments.spans(F.col("text"), "{}"))
    got = {r.doc_id: r.t for r in found.select("doc_id", segments.mask(F.col("text"), F.col("s")).alias("t")).collect()}
    assert got == {1: "to [email] and [ip]", 2: None, 3: "", 4: "é [phone]!"}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(3).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string"))
                                      .withColumn("doc_id", F.lit(None).cast("long")).withColumn("source", F.lit(None).cast("string")))
    docs = docs.unionByName(extra)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, SF).cache()
        seen.append((name, before.count(), docs.count()))
        if name != "pieces":
            assert docs.columns == before.columns
    assert [n for n, _, _ in seen] == ["quality", "near_duplicates", "private", "mixing", "pieces"]
    by = {n: (a, b) for n, a, b in seen}
    assert by["quality"][1] < by["quality"][0] and by["near_duplicates"][1] < by["near_duplicates"][0]
    assert by["private"][0] == by["private"][1] and by["pieces"][0] == by["pieces"][1]
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in docs.limit(20).collect():
        assert hashlib.sha256(sp.decode(r.ids).encode()).hexdigest() == r.decoded_sha256


def test_near_duplicates_decides_by_row(spark):
    from runlens.llm.stages import near_duplicates
    copy, near = "a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s z"
    rows = [(3, copy), (7, near), (7, "one of a kind"), (8, "u v w x y z"), (8, "quite another text"), (8, "u v w x y z"),
            (None, "nobody owns this text at all"), (None, "nobody owns this text at all"), (None, copy),
            (9, ""), (9, None), (9, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(str, near_duplicates(spark, df, "").collect()))
    want = [rows[i] for i in (0, 2, 3, 4, 6, 9, 10, 11)]
    assert got == sorted(map(str, spark.createDataFrame(want, df.schema).collect()))
