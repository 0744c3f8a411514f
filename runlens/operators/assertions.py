"""Assertions over a run's final state and node outputs (part of A6).

An assertion is a Python-like expression over names: a channel of the final
state or, where no channel has the name, a node whose output fields follow after
a dot.  Assertions are data: they stay rows from the case table to the check
rows, each is compiled once per batch on the executors, and nothing about them
reaches the driver or the plan.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from types import CodeType

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Functions that an assertion may call
CALLS = {f.__name__: f for f in (len, min, max, abs, round, str, int, float, bool)}
_FORMS = (ast.expr_context, ast.boolop, ast.cmpop, ast.Not, ast.USub, ast.Add, ast.Sub, ast.Mult, ast.Div, ast.FloorDiv, ast.Mod,
          ast.BoolOp, ast.UnaryOp, ast.BinOp, ast.Compare, ast.Name, ast.Subscript, ast.Constant, ast.List, ast.Tuple, ast.Dict,
          ast.Expression)
NAME_PATTERN = r"[A-Za-z_][A-Za-z0-9_]*"


_FIELD = "__field"


def _field(value: object, key: str) -> object:
    if isinstance(value, dict) and key in value:
        return value[key]
    raise LookupError(f"cannot resolve '.{key}'")


class _Plain(ast.NodeTransformer):
    """Dotted lookups become calls of ``_field``, so that only mappings answer them; any other form is refused."""

    def visit_Attribute(self, node: ast.Attribute) -> ast.AST:
        if node.attr.startswith("_"):
            raise ValueError("underscore attributes are not allowed")
        return ast.Call(ast.Name(_FIELD, ast.Load()), [self.visit(node.value), ast.Constant(node.attr)], [])

    def visit_Call(self, node: ast.Call) -> ast.AST:
        if node.keywords or not isinstance(node.func, ast.Name) or node.func.id not in CALLS:
            raise ValueError("only builtin functions len/min/max/abs/round/str/int/float/bool may be called")
        node.args = [self.visit(a) for a in node.args]
        return node

    def generic_visit(self, node: ast.AST) -> ast.AST:
        if not isinstance(node, _FORMS):
            raise ValueError(f"disallowed syntax: {type(node).__name__}")
        return super().generic_visit(node)


def compile_assertion(text: str) -> CodeType | str:
    """Code to evaluate, or the reason why there is none."""
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return f"invalid expression: {text!r}"
    try:
        return compile(ast.fix_missing_locations(_Plain().visit(tree)), "assertion", "eval")
    except ValueError as e:
        return str(e)


def check_assertion(code: CodeType | str, names: dict) -> tuple[bool, str | None]:
    """(holds, error); whatever goes wrong is a failed check."""
    if isinstance(code, str):
        return False, code
    try:
        return bool(eval(code, {"__builtins__": {}, **CALLS, **names, _FIELD: _field})), None  # noqa: S307 - only the forms above get here
    except NameError as e:
        return False, f"unknown name '{e.name}'"
    except (KeyError, IndexError) as e:
        return False, type(e).__name__
    except LookupError as e:
        return False, str(e)
    except Exception as e:  # noqa: BLE001 - an error of an expression is its result
        return False, type(e).__name__


def _check_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    known: dict[str, CodeType | str] = {}
    for texts, names in batches:
        out = []
        for some, given in zip(texts, names):
            space = {k: json.loads(v) if v is not None else None for k, v in dict(given if given is not None else {}).items()}
            row = []
            for t in some if some is not None else []:
                if t not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[t] = compile_assertion(t)
                ok, error = check_assertion(known[t], space)
                row.append({"ok": ok, "error": error})
            out.append(row)
        yield pd.Series(out, dtype=object)


def checked(texts: str, names: str) -> Column:
    """(ok, error) of every assertion of the list ``texts``; ``names`` maps names to JSON texts."""
    return F.pandas_udf(_check_batches, "array<struct<ok: boolean, error: string>>")(texts, names)
