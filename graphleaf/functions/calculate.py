"""Arithmetic on text, from a white list of syntax; results are text because integers may be long."""

from __future__ import annotations

import ast
import math
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_BITS, MOST_FACTORIAL = 20_000, 2_000
_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow}
_UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg}
_NAMES = {n: v for n, v in vars(math).items() if not n.startswith("_")} | {"abs": abs, "round": round, "min": min, "max": max}


def evaluate(expression: str) -> object:
    """The value of an expression of numbers, ``+ - * / // % **``, and calls and names of ``math`` with abs, round, min and max.

    Anything else raises ValueError, and so do powers, shifts and factorials too large to be meant."""

    def value(node: ast.AST) -> object:
        match node:
            case ast.Expression(body=body):
                return value(body)
            case ast.Constant(value=v) if isinstance(v, int | float) and not isinstance(v, bool):
                return v
            case ast.BinOp(left=left, op=op, right=right) if type(op) in _BINARY:
                a, b = value(left), value(right)
                if isinstance(op, ast.Pow) and isinstance(a, int) and isinstance(b, int) and b > 0 and a.bit_length() * b > MOST_BITS:
                    raise ValueError("power too large")
                return _BINARY[type(op)](a, b)
            case ast.UnaryOp(op=op, operand=operand) if type(op) in _UNARY:
                return _UNARY[type(op)](value(operand))
            case ast.List(elts=items) | ast.Tuple(elts=items):
                return [value(i) for i in items]
            case ast.Name(id=name) if name in _NAMES and not callable(_NAMES[name]):
                return _NAMES[name]
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]) if callable(_NAMES.get(name)):
                given = [value(a) for a in args]
                if name in ("factorial", "comb", "perm") and any(isinstance(g, int) and g > MOST_FACTORIAL for g in given):
                    raise ValueError("argument too large")
                if name == "ldexp" or name in ("prod", "pow") and any(isinstance(g, int) and g.bit_length() > MOST_BITS for g in given):
                    raise ValueError("argument too large")
                return _NAMES[name](*given)
        raise ValueError(f"not allowed: {type(node).__name__}")

    return value(ast.parse(expression.strip(), mode="eval"))


def _calculated(expressions: pd.Series) -> pd.Series:
    out = []
    for e in expressions:
        try:
            out.append(None if e is None else str(evaluate(e)))
        except Exception:
            out.append(None)
    return pd.Series(out, dtype="object")


def calculate_column(expression: Column | str) -> Column:
    """The value as text; null for null and for what ``evaluate`` refuses."""
    return F.pandas_udf(_calculated, "string")(expression)
