"""Conditions of policies: comparisons, arithmetic and logic on columns, from text to a Column.

Only names of given columns, literals and operators are read; there are no calls,
so a policy file can't run anything.  Numbers are doubles and division by zero is
null, so a condition that is read never fails on data.
"""

from __future__ import annotations

import ast
import re
from functools import reduce
from operator import add, and_, eq, ge, gt, le, lt, mul, ne, or_, sub

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: SQL and script operators under the names that the expression tree has.
_WRITTEN = {
    "and": " and ", "&&": " and ", "or": " or ", "||": " or ", "not": " not ", "!": " not ", "=": "==", "===": "==", "==": "==", "<>": "!=", "!==": "!=", "!=": "!=",
    "true": " True ", "false": " False ", "null": " None ", "undefined": " None ", "is": " is ", "in": " in ",
}
_PART = re.compile(r"""'(?:[^'\\]|'')*'|"[^"\\]*"|[A-Za-z_][\w.]*|\d+(?:\.\d+)?|===|!==|==|!=|<>|<=|>=|&&|\|\||[-+*/%<>=!(),]|\s+""")
_COMPARED = {ast.Eq: eq, ast.NotEq: ne, ast.Lt: lt, ast.LtE: le, ast.Gt: gt, ast.GtE: ge}
_COUNTED = {ast.Add: add, ast.Sub: sub, ast.Mult: mul, ast.Div: F.try_divide, ast.Mod: lambda a, b: F.when(b != 0, a % b)}
_KINDS = {"string": "text", "boolean": "truth"}


class NoCondition(ValueError):
    """The text is no condition on these columns."""


def condition(text: str, rows: DataFrame) -> Column:
    """A boolean Column of ``rows``.

    AND, OR, NOT, =, <>, <, <=, >, >=, IN (...), IS [NOT] NULL, + - * / %, numbers,
    'text', TRUE, FALSE, NULL, or the same with &&, ||, !, ===, !==; columns by
    name, or as the last part of a dotted name in camel case.  NoCondition on
    anything else, and where kinds (number, text, truth) do not fit.
    """
    kinds = {f.name: _KINDS.get(f.dataType.simpleString(), "number") for f in rows.schema}
    try:
        tree = ast.parse(_rewritten(text).strip(), mode="eval")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        raise NoCondition(str(error)) from error
    kind, column = _column(tree.body, kinds)
    if kind != "truth":
        raise NoCondition("not a truth value")
    return column


def _rewritten(text: str) -> str:
    at, out = 0, []
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise NoCondition(f"what stands at {at} is not read")
        part, at = m[0], m.end()
        if part[0] == "'":
            part = repr(part[1:-1].replace("''", "'"))
        out.append(_WRITTEN.get(part.lower(), part))
    return "".join(out)


def _column(node: ast.expr, kinds: dict[str, str]) -> tuple[str, Column]:
    match node:
        case ast.Constant(value=bool() as v):
            return "truth", F.lit(v)
        case ast.Constant(value=None):
            return "null", F.lit(None)
        case ast.Constant(value=int() | float() as v):
            return "number", F.lit(float(v))
        case ast.Constant(value=str() as v):
            return "text", F.lit(v)
        case ast.Name() | ast.Attribute():
            name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", node.id if isinstance(node, ast.Name) else node.attr).lower()
            if name not in kinds:
                raise NoCondition(f"no column {name}")
            return kinds[name], F.col(name).cast("double") if kinds[name] == "number" else F.col(name)
        case ast.BoolOp(op=op, values=values):
            return "truth", reduce(and_ if isinstance(op, ast.And) else or_, [_of("truth", v, kinds) for v in values])
        case ast.UnaryOp(op=ast.Not(), operand=v):
            return "truth", ~_of("truth", v, kinds)
        case ast.UnaryOp(op=ast.USub(), operand=v):
            return "number", -_of("number", v, kinds)
        case ast.BinOp(left=a, op=op, right=b) if type(op) in _COUNTED:
            return "number", _COUNTED[type(op)](_of("number", a, kinds), _of("number", b, kinds))
        case ast.Compare(left=left, ops=ops, comparators=others):
            pairs = zip([left, *others], ops, others)
            return "truth", reduce(and_, [_compared(a, op, b, kinds) for a, op, b in pairs])
    raise NoCondition(f"{type(node).__name__} is not read")


def _of(kind: str, node: ast.expr, kinds: dict[str, str]) -> Column:
    found, column = _column(node, kinds)
    if found != kind:
        raise NoCondition(f"{found} where {kind} is read")
    return column


def _compared(a: ast.expr, op: ast.cmpop, b: ast.expr, kinds: dict[str, str]) -> Column:
    kind, left = _column(a, kinds)
    if isinstance(op, ast.In) and isinstance(b, (ast.Tuple, ast.Constant)):
        return reduce(or_, [left == _of(kind, v, kinds) for v in (b.elts if isinstance(b, ast.Tuple) else [b])], F.lit(False))
    if isinstance(b, ast.Constant) and b.value is None and isinstance(op, (ast.Is, ast.IsNot, ast.Eq, ast.NotEq)):
        return left.isNull() if isinstance(op, (ast.Is, ast.Eq)) else left.isNotNull()
    if type(op) not in _COMPARED:
        raise NoCondition("a comparison that is not read")
    return _COMPARED[type(op)](left, _of(kind, b, kinds))
