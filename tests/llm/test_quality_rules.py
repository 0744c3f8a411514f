"""Quality rules: counts against brute force, sketches against sorted values, fences that follow a group."""

import random
import re

from pyspark.sql import functions as F

from runlens.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(text):
    t = text or ""
    words = WORD.findall(t)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {j for found in at.values() if len(found) > 1 for i in found for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def _texts():
    rng = random.Random(3)
    texts = [None, "", " \t\r\n", "a", "ab " * 30, "x y\nx y\n\nx y", "é|ß <b> #1 🙂 $%&*", "a b c d e f g h a b c d e f g h",
             "a b c d e f g h z a b c d e f g h", "\x0bw\x0cw\rw", "1 2 3 4 5 6 7 8 9 " * 3]
    for _ in range(60):
        texts.append("".join(rng.choice(["a", "b", "Cé", "d#"]) + rng.choice([" ", " ", "\n", "\t\t"]) for _ in range(rng.randrange(60))))
    return texts


def test_counts_against_brute_force(spark):
    texts = _texts()
    rows = [(i if i % 5 else None, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string").withColumn("no", F.monotonically_increasing_id())
    got = qr.features(df, ["no"]).orderBy("no").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got] == [_brute(t) for t in texts]


def test_sketch_quantiles_and_merge(spark):
    rng = random.Random(5)
    values = [rng.choice([0, 3, 63, 64, 100, 5000, rng.randrange(10**6)]) for _ in range(4000)]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "g int, m_x long")
    m = [qr.Measure("x", F.col("m_x"), 0)]
    parts = qr.sketch(df, ["g"], m)
    for rows, pick in ((qr.quartiles(parts, ["g"]).collect(), lambda r: sorted(values[r.g::3])),
                       (qr.quartiles(qr.merge(parts, []), []).collect(), lambda r: sorted(values))):
        for r in rows:
            s = pick(r)
            assert r.rows == len(s)
            for q, v in ((25, r.q25), (75, r.q75)):
                exact = s[-(-len(s) * q // 100) - 1]
                assert exact <= v <= exact + exact // 32


def test_fences_follow_their_group_and_small_groups_take_merged_ones(spark):
    def doc(rng, symbols):
        return " ".join("".join(rng.choice("abcdef") for _ in range(rng.randrange(3, 7))) + ("#" if rng.random() < symbols else "")
                        for _ in range(rng.randrange(80, 120)))
    rng = random.Random(7)
    rows = [(i, doc(rng, 0.5), "aa", "code") for i in range(300)] + [(1000 + i, doc(rng, 0.0), "aa", "prose") for i in range(300)]
    rows += [(2000, doc(rng, 0.5), "aa", "prose"), (2001, doc(rng, 0.0), None, None), (2002, doc(rng, 0.9) + " ###" * 200, None, None),
             (2003, "", "aa", None), (None, None, "aa", "prose"), (7, rows[7][1], "aa", "code")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("kept", F.lit("x"))
    got = qr.judge(df, ["doc_id"]).collect()
    assert len(got) == len(rows)
    out = {r.doc_id: r for r in got}
    assert all(out[i].kept for i in range(300)) and all(out[1000 + i].kept for i in range(300))
    assert out[2000].failed == ["symbols"] and out[2001].kept and not out[2002].kept
    assert out[2003].base_failed and out[None].base_failed
    assert qr.judge(df.limit(0), ["doc_id"]).collect() == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = qr.features(df, ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
