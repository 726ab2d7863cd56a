"""Layer expressions: a whitelist translated to Spark columns, or evaluated on driver scalars. Nothing is eval'ed."""

from __future__ import annotations

import ast
import datetime
import math
import operator
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryParseError

EPOCH = datetime.date(1970, 1, 1)
INTEGERS = {"int", "uint", "uint8", "uint16", "uint32", "uint64", "int8", "int16", "int32", "int64"}
FLOATS = {"float", "float32", "float64"}
COMPARE = {ast.Gt: operator.gt, ast.Lt: operator.lt, ast.GtE: operator.ge, ast.LtE: operator.le, ast.Eq: operator.eq, ast.NotEq: operator.ne}


class _Scalars:
    """Operations on Python scalars; dates are day numbers since 1970."""

    lit = staticmethod(lambda x: x)
    where = staticmethod(lambda c, a, b: a if c else b)
    floor, ceil, isnan = staticmethod(math.floor), staticmethod(math.ceil), staticmethod(math.isnan)
    days = staticmethod(lambda x: (datetime.date.fromisoformat(str(x)[:10]) - EPOCH).days)
    date_text = staticmethod(lambda x: (EPOCH + datetime.timedelta(days=int(x))).isoformat())
    text, whole, real = staticmethod(str), staticmethod(int), staticmethod(float)
    mod, div, floordiv = staticmethod(operator.mod), staticmethod(operator.truediv), staticmethod(operator.floordiv)


class _Columns:
    """The same operations on Spark columns; none raises under ANSI mode."""

    lit = staticmethod(F.lit)
    where = staticmethod(lambda c, a, b: F.when(c, a).otherwise(b))
    floor, ceil = staticmethod(F.floor), staticmethod(F.ceil)
    isnan = staticmethod(lambda x: x.isNull() | F.isnan(x.cast("double")))
    days = staticmethod(lambda x: F.datediff(x.cast("date"), F.lit("1970-01-01").cast("date")))
    date_text = staticmethod(lambda x: F.date_add(F.lit("1970-01-01").cast("date"), x.cast("int")).cast("string"))
    text, whole, real = (staticmethod(lambda x, t=t: x.cast(t)) for t in ("string", "long", "double"))
    mod, div = staticmethod(F.pmod), staticmethod(F.try_divide)
    floordiv = staticmethod(lambda a, b: F.floor(F.try_divide(a, b)))


class _Dates:
    """A value typed as days, on its way to text or to a number."""

    def __init__(self, value: Any):
        self.value = value


def _walk(node: ast.AST, names: dict[str, Any], of: type) -> Any:
    def go(n: ast.AST) -> Any:
        match n:
            case ast.Constant(value=v) if isinstance(v, int | float | str):
                return of.lit(v)
            case ast.Name(id="nan"):
                return of.lit(math.nan)
            case ast.Name(id=name) if name in names:
                return names[name]
            case ast.UnaryOp(op=ast.USub(), operand=x):
                return -go(x)
            case ast.UnaryOp(op=ast.Invert() | ast.Not(), operand=x):
                return ~go(x) if of is _Columns else not go(x)
            case ast.BinOp(left=a, op=op, right=b):
                return binary(op, go(a), go(b))
            case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in COMPARE:
                return COMPARE[type(op)](plain(go(a)), plain(go(b)))
            case ast.Call(func=ast.Attribute(value=x, attr="astype"), args=[kind]):
                return cast(go(x), kind)
            case ast.Call(func=f, args=args, keywords=[]):
                return call(f.attr if isinstance(f, ast.Attribute) else getattr(f, "id", ""), [go(a) for a in args])
        raise QueryParseError(f"unsupported expression: {ast.unparse(n)}")

    def plain(x: Any) -> Any:
        return x.value if isinstance(x, _Dates) else x

    def binary(op: ast.AST, a: Any, b: Any) -> Any:
        dated = isinstance(a, _Dates) or isinstance(b, _Dates)
        a, b = plain(a), plain(b)
        match op:
            case ast.Add():
                out = a + b
            case ast.Sub():
                out = a - b
            case ast.Mult():
                return a * b
            case ast.Div():
                return of.div(a, b)
            case ast.FloorDiv():
                return of.floordiv(a, b)
            case ast.Mod():
                return of.mod(a, b)
            case ast.Pow():
                return F.pow(a, b) if of is _Columns else a**b
            case ast.BitAnd():
                return a & b
            case ast.BitOr():
                return a | b
            case _:
                raise QueryParseError("unsupported operator")
        return _Dates(out) if dated else out

    def cast(x: Any, kind: ast.AST) -> Any:
        name = kind.value if isinstance(kind, ast.Constant) else getattr(kind, "attr", getattr(kind, "id", ""))
        if name == "datetime64[D]":
            return _Dates(plain(x))
        if name == "str":
            return of.date_text(x.value) if isinstance(x, _Dates) else of.text(x)
        if name in INTEGERS:
            return of.whole(plain(x))
        if name in FLOATS:
            return of.real(plain(x))
        raise QueryParseError(f"unsupported type: {name}")

    def call(name: str, args: list) -> Any:
        simple: dict[str, Callable] = {"floor": of.floor, "ceil": of.ceil, "isnan": of.isnan, "where": of.where}
        if name in simple:
            return simple[name](*args)
        if name == "datetime64" and args:
            return _Dates(of.days(args[0]))
        if name == "timedelta64" and args:
            return args[0]
        if name in INTEGERS and len(args) == 1:
            return of.whole(plain(args[0]))
        if name in FLOATS and len(args) == 1:
            return of.real(plain(args[0]))
        raise QueryParseError(f"unsupported function: {name}")

    return plain(go(node))


def _parse(text: str) -> ast.AST:
    try:
        return ast.parse(text, mode="eval").body
    except SyntaxError as e:
        raise QueryParseError(f"malformed expression: {text}") from e


def to_column(text: str, **names: Column) -> Column:
    return _walk(_parse(text), names, _Columns)


def to_scalars(text: str, value: Any) -> list:
    """Codes for a literal; a tuple or list expression gives several."""
    node = _parse(text)
    nodes = node.elts if isinstance(node, ast.Tuple | ast.List) else [node]
    return [_walk(n, {"A": value}, _Scalars) for n in nodes]
