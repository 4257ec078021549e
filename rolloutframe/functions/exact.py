"""Arrow UDFs for scalars whose exact meaning is Python's own."""

from __future__ import annotations

import ast
import html
import operator
from collections.abc import Callable
from functools import lru_cache
from html.entities import html5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType

_SUMS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv}
_SIGNS = {ast.UAdd: operator.pos, ast.USub: operator.neg}


@pandas_udf(ArrayType(StringType()))
def entities(found: pd.Series) -> pd.Series:
    """What each of the HTML entities found in a text stands for; also of those that lack their semicolon."""
    return found.map(lambda own: [html.unescape(x) for x in own], na_action="ignore")


@pandas_udf(ArrayType(StringType()))
def closed_entities(found: pd.Series) -> pd.Series:
    """The same for whole names or numbers with a semicolon; others stay as they are."""

    def read(x: str) -> str:
        return html.unescape(x) if x.endswith(";") and (x[1] == "#" or x[1:] in html5) else x

    return found.map(lambda own: [read(x) for x in own], na_action="ignore")


@pandas_udf(DoubleType())
def py_round(value: pd.Series, digits: pd.Series) -> pd.Series:
    """round() on the binary value, half to even."""
    return pd.Series([None if v != v else round(v, int(d)) for v, d in zip(value, digits, strict=True)], dtype="float64")


@pandas_udf(ArrayType(BooleanType()))
def equal_when_rounded(a: pd.Series, b: pd.Series) -> pd.Series:
    """For arrays of numbers, which pairs are equal after round() to two places; Python's, not numpy's."""
    return pd.Series([[round(float(x), 2) == round(float(y), 2) for x, y in zip(own, other, strict=True)] for own, other in zip(a, b, strict=True)])


@lru_cache(maxsize=1024)
def _parsed(expression: str) -> ast.AST | None:
    try:
        return ast.parse(expression.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError):
        return None


def _computed(expression: str, column: Callable[[str], np.ndarray], bad: np.ndarray) -> float | np.ndarray:
    """The values of sums and products of numbers and names, a row each; ``bad`` marks the rows that divide by zero.

    Numbers alone are Python's own, so whole ones stay exact; where a name is met all are doubles, as in Python.
    """

    def value(node: ast.AST | None) -> float | np.ndarray:
        match node:
            case ast.Constant(value=int() | float() as x) if not isinstance(x, bool):
                return x
            case ast.Name(id=name):
                return column(name)
            case ast.BinOp(left, op, right):
                a, b = value(left), value(right)
                if isinstance(a, np.ndarray) or isinstance(b, np.ndarray):
                    a, b = (x if isinstance(x, np.ndarray) else float(x) for x in (a, b))
                    if isinstance(op, ast.Div):
                        np.logical_or(bad, b == 0, out=bad)
                return _SUMS[type(op)](a, b)
            case ast.UnaryOp(op, operand):
                return _SIGNS[type(op)](value(operand))
        raise KeyError(node)

    with np.errstate(all="ignore"):
        return value(_parsed(expression))


_VALUELESS = (KeyError, ArithmeticError, RecursionError)


def arithmetic(expression: str, names: dict[str, float]) -> float | None:
    """The value of sums and products of numbers and names; None for anything else."""
    bad = np.zeros(1, dtype=bool)
    try:
        found = _computed(expression, lambda name: np.array([names[name]], dtype="float64"), bad)
        return None if bad[0] else float(found if np.isscalar(found) else found[0])
    except _VALUELESS:
        return None


@arrow_udf(DoubleType())
def evaluate(expression: pa.Array, names: pa.Array) -> pa.Array:
    """Arithmetic over a map of names, null where it has no value: each expression is parsed once and computed for its rows together."""
    n = len(expression)
    starts = names.offsets.to_numpy()
    owner = np.repeat(np.arange(n), np.diff(starts))  # Spark's null maps are empty
    keys, values = (x.slice(starts[0], starts[-1] - starts[0]) for x in (names.keys, names.items))
    out, empty = np.zeros(n), np.ones(n, dtype=bool)
    coded = expression.dictionary_encode()
    code = pc.fill_null(coded.indices, -1).to_numpy()
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def named(name: str) -> tuple[np.ndarray, np.ndarray]:
        """The name's value in each row, and where there is none."""
        if name not in held:
            own = pc.and_(pc.equal(keys, name), pc.is_valid(values)).to_numpy(zero_copy_only=False)
            found, lost = np.zeros(n), np.ones(n, dtype=bool)
            found[owner[own]], lost[owner[own]] = values.to_numpy(zero_copy_only=False)[own], False
            held[name] = found, lost
        return held[name]

    for i, text in enumerate(coded.dictionary.to_pylist()):
        at = np.flatnonzero(code == i)
        bad = np.zeros(len(at), dtype=bool)

        def column(name: str, at: np.ndarray = at, bad: np.ndarray = bad) -> np.ndarray:
            found, lost = named(name)
            np.logical_or(bad, lost[at], out=bad)
            return found[at]

        try:
            out[at] = _computed(text, column, bad)
        except _VALUELESS:
            continue
        empty[at] = bad
    return pa.array(out, mask=empty | np.isnan(out))
