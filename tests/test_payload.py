"""Payload functions: JSON paths, extraction, validation, parsing, Python semantics."""

import pytest
from pyspark.sql import functions as F

from runlens.functions import scalars as S
from runlens.operators import payload as P


def _one(spark, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema)


def test_json_path_strict(spark):
    df = _one(spark, '{"data": {"items": [{"id": 7}, {"id": null}]}}')
    for path, value, err in [("$.data.items[0].id", "7", None), ("$.data.items[1].id", "null", None),
                             ("$.data.items[5].id", None, "cannot resolve '5' in list"),
                             ("$.data.x", None, "cannot resolve 'x' in dict")]:
        r = S.json_path(df, "x", path, "o").select("o.*").first()
        assert r.value == value
        assert (r.error is None) if err is None else (err in r.error)
    with pytest.raises(ValueError):
        S.check_json_path("$.data[*].id")


def test_dig_path_errors(spark):
    df = _one(spark, '{"a": {"list": [1, 2]}, "n": 3}')
    get = lambda p: S.dig_path(df, "x", p, "o").select("o.*").first()
    assert get("a.list.1").value == "2"
    assert "bad index '9'" in get("a.list.9").error
    assert "key 'zz' not found" in get("a.zz").error
    assert "cannot descend into int" in get("n.q").error


def test_extract_json_fenced_chatty_broken(spark):
    df = spark.createDataFrame([("Sure ```json {\"a\": 1} ``` bye",), ("The answer is {\"b\": 2} ok",),
                                ("nothing here",), ("{broken",)], "x string")
    got = [tuple(r) for r in S.with_extracted_json(df, "x", "e").select("e.*").collect()]
    assert got[0] == ('{"a": 1}', None)
    assert got[1] == ('{"b": 2}', None)
    assert got[2][1] == "no JSON object found in response"
    assert got[3][1] == "no JSON object found in response"


def test_validate_schema_lax(spark):
    df = spark.createDataFrame([('{"n": "5", "f": 2, "b": "yes", "s": "hi"}',), ('{"n": 1.5}',)], "x string")
    out = S.validate_schema(df, "x", {"n": "int", "f": "float", "b": "bool", "s": "str"}, "v").select("v.*").collect()
    assert out[0].valid and out[0].n == 5 and out[0].f == 2.0 and out[0].b is True and out[0].s == "hi"
    assert not out[1].valid and "n: not a valid int" in out[1].error and "f: field required" in out[1].error
    with pytest.raises(ValueError):
        S.validate_schema(df, "x", {"n": "integer"}, "v")


def test_parse_duration(spark):
    df = spark.createDataFrame([(t,) for t in ["500ms", "20s", "15m", "1h", "1d", "30", "2.5s", "soon"]], "x string")
    got = [r.seconds for r in df.select(S.parse_duration("x").alias("d")).select("d.*").collect()]
    assert got == [0.5, 20.0, 900.0, 3600.0, 86400.0, 30.0, 2.5, None]


def test_slugify_and_tokens(spark):
    df = spark.createDataFrame([("Hello, World: My First Flow!",), ("?!",)], "x string")
    assert [r[0] for r in df.select(S.slugify("x")).collect()] == ["hello_world_my_first", "workflow"]
    assert [r[0] for r in df.select(S.estimate_tokens("x")).collect()] == [7, 1]


def test_normalize_url(spark):
    df = spark.createDataFrame([("localhost:8000",), ("https://Api.Example.com/v1/x",), ("10.0.0.5",)], "x string")
    got = [tuple(r) for r in df.select(S.normalize_url("x").alias("u")).select("u.*").collect()]
    assert all(g[4] is None for g in got)  # no error
    got = [g[:4] for g in got]
    assert got[0] == ("http://localhost:8000", "localhost", 8000, "openai_local_8000")
    assert got[1] == ("https://api.example.com", "api.example.com", 443, "openai_api_example_com_443")
    assert got[2] == ("http://10.0.0.5", "10.0.0.5", 80, "openai_10_0_0_5_80")


def test_bad_numbers_are_error_rows(spark):
    df = _one(spark, "api.example.com:99999999999")
    r = df.select(S.normalize_url("x").alias("u")).select("u.*").first()
    assert r.port is None and r.origin is None and r.error == "bad port 99999999999"
    big = _one(spark, '{"n": "99999999999999999999"}')
    v = S.validate_schema(big, "x", {"n": "int"}, "v").select("v.*").first()
    assert not v.valid and v.error == "n: not a valid int"
    z = spark.createDataFrame([(2 ** 53 + 1, 1), (-2 ** 53 - 1, 2), (5, 0)], "a long, b long")
    got = z.select(S.floordiv(F.col("a"), F.col("b")).alias("q"), S.pymod(F.col("a"), F.col("b")).alias("m")).collect()
    assert [(r.q, r.m) for r in got] == [(2 ** 53 + 1, 0), ((-2 ** 53 - 1) // 2, 1), (None, None)]


def test_placeholders_are_filled_once(spark):
    df = spark.createDataFrame([(1, "<n.a> <n.b> <n.c>", "${A} ${C} ${B}")], "id int, t string, e string")
    r = df.select(S.interpolate("t", {"n.a": F.lit("<n.b>"), "n.b": F.lit("V")}).alias("i")).first().i
    assert r.text == "<n.b> V <n.c>" and r.unresolved == ["n.c"]
    env = spark.createDataFrame([("A", "${B}"), ("B", "x")], "name string, value string")
    assert P.fill_env(df, "e", env).first().e == "${B} ${C} x"


def test_fill_env_without_keys(spark):
    df = spark.createDataFrame([(None, "null ${A}"), (None, "null ${A}"), (1, None), (2, "no")], "id int, e string")
    env = spark.createDataFrame([("A", "x"), (None, "y")], "name string, value string")
    assert sorted(str(r.e) for r in P.fill_env(df, "e", env).collect()) == ["None", "no", "null x", "null x"]


def test_canonical_json_matches_python(spark):
    import json
    rows = [({"z": "caf\u00e9 \U0001f600 \"q\" \\ \n", "y": None}, [True, None], {"b": 1, "a": [1.5, None]}, None)]
    df = spark.createDataFrame(rows, "m map<string,string>, l array<boolean>, s struct<b: int, a: array<double>>, n string")
    got = df.select(S.canonical_json(df, F.struct("n", "m", "l", "s")).alias("j")).first().j
    value = dict(zip(("m", "l", "s", "n"), rows[0]))
    assert got == json.dumps(value, sort_keys=True, separators=(",", ":"))


def test_float_text_matches_python(spark):
    import json
    import random
    import struct
    rng = random.Random(1)
    xs = [0.0, -0.0, 1.0, 1e20, 1e16, 1e15, 123456789012345680.0, 1e-4, 1e-5, 0.1, 1 / 3, 2 / 3, 5e-324, 1.7976931348623157e308,
          2.0 ** -44, 2e-3, 1e23, 2 ** 53 + 2.0, 9007199254740993.0, 100.0, 1.5e-7, float("inf"), float("-inf"), float("nan"), 4.35, 2.2e-322]
    xs += [struct.unpack("d", rng.randbytes(8))[0] for _ in range(3000)] + [round(rng.uniform(-1e6, 1e6), rng.randrange(6)) for _ in range(1000)]
    xs += [float(rng.randrange(10 ** 17)) for _ in range(500)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = {r.i: r.t for r in df.select("i", S.float_text(F.col("x")).alias("t")).collect()}
    bad = [(x, got[i], json.dumps(x)) for i, x in enumerate(xs) if got[i] != json.dumps(x)]
    assert not bad, bad[:5]


def test_find_refs_in_nested_values_and_json(spark):
    df = spark.createDataFrame([(1, ([{"<k.no>": "<a.b> <a.b>", "y": None}], ["<c.d>"], "x"), '{"<k.no>": ["<a.b>", ":\\"<e.f>", {"u": "\\u003cg.h>"}]}'),
                                (2, None, "no json <a.b>"), (3, ([], None, "<z.9>"), "null")],
                               "id int, v struct<a: array<map<string,string>>, b: array<string>, c: string>, j string")
    assert sorted(tuple(r) for r in P.find_refs(df, "v", ["id"]).collect()) == [(1, "a.b"), (1, "c.d"), (3, "z.9")]
    assert sorted(tuple(r) for r in P.find_refs(df, "j", ["id"], is_json=True).collect()) == [(1, "a.b"), (1, "e.f"), (1, "g.h")]
    var = df.select("id", F.try_parse_json("j").alias("j"))
    assert sorted(tuple(r) for r in P.find_refs(var, "j", ["id"]).collect()) == [(1, "a.b"), (1, "e.f"), (1, "g.h")]


def test_redact_any_characters_and_blocks(spark):
    df = spark.createDataFrame([(1, "x ab/cd+ef== y"), (2, "pretokenXYZ9post tokenXYZ"), (3, "abcd")], "id int, text string")
    vals = spark.createDataFrame([("ab/cd+ef==",), ("tokenXYZ9",), ("abc",), ("bcd",)], "value string")
    for some in (vals, vals.union(vals).repartition(3)):
        out = {r.id: r.text for r in P.redact(df, "text", some).collect()}
        assert out == {1: "x [REDACTED] y", 2: "pre[REDACTED]post tokenXYZ", 3: "[REDACTED]"}


def test_flatten_leaves_names_and_bounds(spark):
    df = spark.createDataFrame([((1, (2, [(3, (4,))]), [5]),)],
                               "d struct<id: int, c: struct<id: int, l: array<struct<id: int, x: struct<y: int>>>>, e: array<int>>")
    r = P.flatten_leaves(df, "d").first().asDict()
    assert r == {"id": 1, "c_id": 2, "c_l0_id": 3, "y": 4, "e": 5}
    assert P.flatten_leaves(df, "d", max_leaves=2).columns == ["id", "c_id"]


def test_python_arithmetic(spark):
    df = spark.createDataFrame([(-7, 2, 2.5), (7, -3, 3.5)], "a long, b long, r double")
    got = df.select(S.floordiv(F.col("a"), F.col("b")).alias("fd"), S.pymod(F.col("a"), F.col("b")).alias("m"),
                    S.round_even(F.col("r")).alias("re")).collect()
    assert [(r.fd, r.m, r.re) for r in got] == [(-4, 1, 2.0), (-3, -2, 4.0)]
    pairs = [(1e300, 1.0), (-1e300, 3.0), (1.0, 0.1), (-7.5, 2.0), (7.5, -2.0), (5.0, 0.0), (0.0, -3.0), (-1.0, 1e300), (6.0, 3.0)]
    f = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double")
    got = {r.i: r.q for r in f.select("i", S.floordiv(F.col("a"), F.col("b"), "float").alias("q")).collect()}
    assert got == {i: (a // b if b else None) for i, (a, b) in enumerate(pairs)}
    least = spark.createDataFrame([(-2 ** 63, -1), (-2 ** 63, 2), (-2 ** 63 + 1, -1)], "a long, b long")
    got = least.select(S.floordiv(F.col("a"), F.col("b")).alias("q"), S.pymod(F.col("a"), F.col("b")).alias("m")).collect()
    assert [(r.q, r.m) for r in got] == [(None, 0), (-2 ** 62, 0), (2 ** 63 - 1, 0)]


def test_summarize_and_interpolate(spark):
    df = spark.createDataFrame([("x" * 205, "<a.b>", "v")], "t string, tpl string, v string")
    r = df.select(S.summarize_text("t").alias("s"), S.interpolate("tpl", {"a.b": F.col("v")}).alias("i")).first()
    assert r.s == "x" * 200 + "… (+5 chars)"
    assert r.i.text == "v" and r.i.value == '"v"' and r.i.value_type == "string" and r.i.unresolved == []


def test_redact_leaves_no_secret(spark):
    secret = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    df = spark.createDataFrame([(1, f'key token = "{secret}" mail me at a.b@example.com from 10.1.2.3'),
                                (2, f"echo {secret} again")], "id long, text string")
    out = P.redact(df, "text", P.secret_values(df, "text"))
    texts = [r.text for r in out.orderBy("id").collect()]
    assert all(secret not in t for t in texts)
    assert "a.b@example.com" not in texts[0] and "10.1.2.3" not in texts[0]
    assert texts[1] == "echo [REDACTED] again"


def test_redact_masks_inside_longer_words(spark):
    df = spark.createDataFrame([(1, 'a token = "abc-123" b abc-123x abc-123'), (2, "no secrets")],
                               "id long, text string")
    out = {r.id: r.text for r in P.redact(df, "text", P.secret_values(df, "text")).collect()}
    assert out[1] == 'a token = "[REDACTED]" b [REDACTED]x [REDACTED]'
    assert out[2] == "no secrets"


def test_redact_nested_values_and_many_values(spark):
    ddl = "id int, p struct<a: string, n: int, l: array<struct<k: string>>, m: map<string,string>, d: map<int,array<string>>>, t string"
    rows = [(1, ("x s3cret-9 y", 5, [("s3cret-9",), None, (None,)], {"s3cret-9": "é s3cret-9é", "k": None}, {1: ["tok-00042", "ok"]}), "s3cret-9"),
            (1, ("x s3cret-9 y", 5, [("s3cret-9",), None, (None,)], {"s3cret-9": "é s3cret-9é", "k": None}, {1: ["tok-00042", "ok"]}), None),
            (None, None, "ß s3cret- tok-100001 tok-0004"), (3, ("a.b@example.com", 1, [], {}, {}), "")]
    df = spark.createDataFrame(rows, ddl)
    vals = spark.range(100_000).selectExpr("format_string('tok-%05d', id) AS value").union(
        spark.createDataFrame([("s3cret-9",), ("",), (None,), ("x" * 5000,)], "value string"))
    out = P.redact(df, ["p", "t"], vals).collect()
    assert len(out) == 4 and not any(v in str(out) for v in ("s3cret-9", "tok-00042", "tok-10000"))
    first = out[0] if out[0].t else out[1]
    one = next(r for r in out if r.id == 1 and r.t)
    assert first is not None and one.t == "[REDACTED]" and one.p.a == "x [REDACTED] y" and one.p.n == 5
    assert [x and x.k for x in one.p.l] == ["[REDACTED]", None, None]
    assert one.p.m == {"[REDACTED]": "é [REDACTED]é", "k": None} and one.p.d == {1: ["[REDACTED]", "ok"]}
    none = next(r for r in out if r.id is None)
    assert none.p is None and none.t == "ß s3cret- [REDACTED]1 tok-0004"
    three = next(r for r in out if r.id == 3)
    assert three.p.a == "[REDACTED]" and three.t == "" and three.p.m == {}


def test_redact_against_brute_force(spark):
    import random
    rng = random.Random(8)
    vals = ["".join(rng.choice("aßb") for _ in range(rng.choice([1, 2, 3, 5, 8, 17, 40]))) + rng.choice("xyz") for _ in range(300)]
    texts = ["".join(rng.choice("aßb") for _ in range(rng.randrange(60))) + rng.choice(["", rng.choice(vals)]) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.t for r in P.redact(df, "t", spark.createDataFrame([(v,) for v in vals], "v string"), patterns=()).collect()}
    for i, t in enumerate(texts):
        spans = sorted((a, a + len(v)) for v in set(vals) for a in range(len(t)) if t.startswith(v, a))
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += t[at:a] + "[REDACTED]"
            at = max(at, b)
        assert got[i] == out + t[at:]


def test_float_text_is_worked_out_step_by_step(spark):
    # each step used to stand in the next one several times over: thousands of copies of the first in one expression
    df = spark.createDataFrame([(1.5,), (None,)], "x double")
    out = df.select(S.float_text(F.col("x")).alias("t"))
    assert out._jdf.queryExecution().analyzed().toString().count("format_string") <= 40
    assert [r.t for r in out.collect()] == ["1.5", None]
    one = df.select(S.canonical_hash(df, "t", {"aé\"": F.array("x"), "b": F.lit(None)}, F.lit("é")).alias("h")).first().h
    import hashlib
    import json
    want = json.dumps({"config": {"aé\"": [1.5], "b": None}, "item": "é", "type": "t"}, sort_keys=True, separators=(",", ":"))
    assert one == hashlib.sha256(want.encode()).hexdigest()


def test_json_paths_parse_a_text_once(spark):
    df = spark.createDataFrame([('{"a": [1, {"b": "x"}], "k": 3}',), ("no",), (None,)], "j string")
    out = S.json_paths(df, "j", {"p": "$.a[1].b", "q": "$.k[0]", "r": "$"})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert sum(line.count("parseJson") for line in plan.splitlines() if " AS _" in line and "parseJson" in line) == 1
    got = [(r.p.value, r.p.error, r.q.error, r.r.value) for r in out.collect()]
    assert got[0] == ('"x"', None, "$.k[0]: cannot resolve '0' in int", '{"a":[1,{"b":"x"}],"k":3}')
    assert got[1][:3] == (None, "$.a[1].b: input is not JSON", "$.k[0]: input is not JSON") and got[2][1] == got[1][1]


def test_word_fanout_does_not_sort_all_words(spark, tmp_path):
    from runlens.plans.queries_payload import q_word_fanout
    rows = [(1, "one two  three"), (1, "x"), (2, " solo "), (3, ""), (None, "a b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = q_word_fanout(spark, str(tmp_path))
    got = {r.doc_id: (r.n_words, r.chars, r.last_word) for r in out.collect()}
    assert got == {1: (4, 12, "three"), 2: (1, 4, "solo"), None: (2, 2, "b")}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    near = [line for line in plan.split("Generate")[0].splitlines() if "Aggregate" in line][-1]
    assert "HashAggregate" in near and "SortAggregate" not in near   # the one next to the words


def test_redact_hashes_long_texts_by_stretches(spark, monkeypatch):
    from runlens.operators import redaction
    monkeypatch.setattr(redaction, "SAMPLE_BYTES", 8)
    texts = [("x" * 7 + s) * k for s, k in (("key-123456", 9), ("ab", 40), ("é" * 30 + "key-99", 3), ("nothing", 5))]
    texts.append("p" * ((1 << 20) - 5) + "key-123456" + "q" * 30 + "key-99")     # over the end of a stretch
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    values = spark.createDataFrame([("key-123456",), ("key-99",), ("ab",), ("é" * 20,), ("", ), (None,)], "v string")
    got = {r.id: r.text for r in P.redact(df, "text", values, patterns=()).collect()}
    assert not any("key-" in t or "ab" in t for t in got.values()) and got[3] == texts[3]
    assert got[0] == ("x" * 7 + P.MASK) * 9 and got[4] == "p" * ((1 << 20) - 5) + P.MASK + "q" * 30 + P.MASK
    # grams of the values are counted in cells, not sent about one by one
    assert not hasattr(redaction, "_value_grams")


def test_redact_sends_on_what_stands_in_texts(spark, monkeypatch):
    from runlens.operators import redaction
    # a filter much too small for the values: every place of every text used to be joined to all values
    monkeypatch.setattr(redaction, "MAX_FILTER_BITS", redaction._PAGE)
    texts = [f"see ord-{i}-{i % 100:02d}; ok" for i in range(2000)] + ["none"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    values = spark.sql("SELECT concat('ord-', o.id, '-', lpad(v.id, 2, '0'), ';') AS value FROM range(2000) o, range(67) v")
    joined, plain = [], type(df).join

    def join(self, other, on=None, how=None):
        if {"start", "at"} & set(self.columns):
            joined.append((self.count(), other.count()))
        return plain(self, other, on, how)
    monkeypatch.setattr(type(df), "join", join)
    got = {r.id: r.text for r in P.redact(df, "text", values, patterns=()).collect()}
    assert all(got[i] == (f"see {P.MASK} ok" if i % 100 < 67 else texts[i]) for i in range(2000)) and got[2000] == "none"
    hits = sum(i % 100 < 67 for i in range(2000))
    assert [hits <= places <= 2 * hits and hits <= kept < 10 * hits for places, kept in joined] == [True]
