"""Pass/fail rules for critic verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def verdict(raw: Column, score: Column, reasons: Column, min_score: float | None = None,
            on_pass: str | None = None, on_fail: str | None = None) -> Column:
    """struct(passed, verdict, feedback, goto, error).

    With ``min_score`` a row passes when its score is present and at least
    that; otherwise when the raw verdict is ``pass``.  Feedback (the reasons)
    is kept only on a fail; a target is chosen only when both targets are
    given.  A raw verdict other than pass/fail is invalid: an error, never a pass.
    """
    v = F.lower(raw)
    valid = v.isin("pass", "fail")
    if min_score is not None:
        rule = F.coalesce(score >= F.lit(min_score), F.lit(False))
    else:
        rule = v == "pass"
    passed = valid & rule
    goto = F.lit(None).cast("string")
    if on_pass and on_fail:
        goto = F.when(passed, F.lit(on_pass)).otherwise(F.lit(on_fail))
    err = F.when(~valid, F.concat(F.lit("verdict must be 'pass' or 'fail', got '"), raw, F.lit("'")))
    return F.struct(passed.alias("passed"), F.when(passed, "pass").otherwise("fail").alias("verdict"),
                    F.when(~passed, reasons).alias("feedback"), goto.alias("goto"), err.alias("error"))
