"""Assertions (A6): names of state and outputs, failures as failed checks, nothing beyond the allowed forms."""

from pyspark.sql import functions as F

from runlens.operators import assertions as A
from runlens.operators import evaluation as E


def _check(text, **names):
    return A.check_assertion(A.compile_assertion(text), names)


def test_forms_and_failures():
    n = {"count": 3, "shouts": ["HELLO,", "WORLD!"], "gate": {"choice": "approve", "l": [1, {"x": None}]}}
    for text in ("count == 3", "shouts == ['HELLO,', 'WORLD!']", "gate.choice in ('approve', 'reject')", "len(shouts) > 1 and not 0",
                 "1 < count <= 3", "gate['l'][1].x is None", "-count // 2 == -2 and count % -2 == -1", "round(2.5) == 2", "'x' not in shouts"):
        assert _check(text, **n) == (True, None), text
    assert _check("count == 999", **n) == (False, None)
    assert _check("nope", **n) == (False, "unknown name 'nope'")
    assert _check("gate.color", **n) == (False, "cannot resolve '.color'")
    assert _check("shouts.upper", **n) == (False, "cannot resolve '.upper'")
    assert _check("count >", **n) == (False, "invalid expression: 'count >'")
    assert _check("count / 0 > 1", **n) == (False, "ZeroDivisionError") and _check("count > 'a'", **n) == (False, "TypeError")
    for bad in ("().__class__", "gate._x", "__import__('os')", "[x for x in shouts]", "(lambda: 1)()", "2 ** 9", "f'{count}'",
                "count if 1 else 2", "shouts.append(1)", "len(x=1)", "__field(1, 'a')"):
        ok, error = _check(bad, **n)
        assert not ok and error, bad


def test_eval_cases_reads_state_then_outputs(spark):
    cases = E.load_cases(spark.createDataFrame(
        [("a", ["n == 3", "g.tokens > 5", "n + g.tokens == 12"]), ("b", ["n == 3"]), ("c", [])], "name string, asserts array<string>"))
    state = spark.createDataFrame([("a", "n", "3"), ("a", "other", '"x"'), ("b", "n", "null")], "name string, key string, value string")
    outputs = spark.createDataFrame([("a", "n", "99"), ("a", "g", '{"tokens": 9}')], "name string, key string, value string")
    reports = spark.createDataFrame([(n, "finished", 0, 1, 0.0) for n in "abc"], "name string, status string, dead_letters int, tokens long, cost_usd double")
    got = E.eval_cases(cases, reports, state, outputs).where("kind = 'assert'").collect()
    assert {(r.name, r.detail): r.ok for r in got} == {("a", "n == 3"): True, ("a", "g.tokens > 5"): True,
                                                      ("a", "n + g.tokens == 12"): True, ("b", "n == 3"): False}
    many = cases.where("name = 'a'").withColumn("asserts", F.transform(F.sequence(F.lit(1), F.lit(12_000)), lambda i: F.concat(
        F.lit("n < "), i.cast("string"))))
    checks = E.eval_cases(many, reports, state, None)
    assert checks.where("kind = 'assert' AND ok").count() == 12_000 - 3
