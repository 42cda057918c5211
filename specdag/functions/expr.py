"""The closed expression language: values and predicates as frozen trees, lowered to Columns, parsed from text."""

from __future__ import annotations

import ast
import datetime
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specdag.errors import SpecError

#: Between a table's alias and a column's name in the frames that steps pass on: names stay unique over any join.
MARK = "#"


class Scope:
    """The columns that an expression may name, by alias and name."""

    def __init__(self, df: DataFrame):
        self.types = {f.name: f.dataType for f in df.schema.fields}

    def find(self, table: str | None, name: str) -> str:
        if table and f"{table}{MARK}{name}" in self.types:
            return f"{table}{MARK}{name}"
        if not table:
            if name in self.types:
                return name
            found = [c for c in self.types if c.rpartition(MARK)[2] == name]
            if len(found) == 1:
                return found[0]
            if found:
                raise SpecError("AMBIGUOUS_COLUMN", f"{name} may be any of {sorted(found)}")
        raise SpecError("UNKNOWN_COLUMN", f"no column {table + '.' if table else ''}{name}; there are {sorted(self.types)}")

    def column(self, table: str | None, name: str) -> Column:
        return F.col(f"`{self.find(table, name)}`")

    def type(self, table: str | None, name: str) -> T.DataType:
        return self.types[self.find(table, name)]


class Expr:
    """A value or predicate. ``column`` lowers it; ``refs`` are the columns it names."""

    def column(self, scope: Scope) -> Column:
        raise NotImplementedError

    def refs(self) -> set[tuple[str | None, str]]:
        out: set[tuple[str | None, str]] = set()
        for value in vars(self).values():
            for x in value if isinstance(value, tuple) else (value,):
                if isinstance(x, Expr):
                    out |= x.refs()
        return out


@dataclass(frozen=True)
class Col(Expr):
    table: str | None
    name: str

    def column(self, scope: Scope) -> Column:
        return scope.column(self.table, self.name)

    def refs(self) -> set[tuple[str | None, str]]:
        return {(self.table, self.name)}


@dataclass(frozen=True)
class Lit(Expr):
    value: Any

    def column(self, scope: Scope) -> Column:
        return F.lit(self.value)


def _typed(value: Expr, beside: Expr, scope: Scope) -> Column:
    """A text literal takes the type of the column that it is compared with, so that a malformed one raises."""
    if isinstance(value, Lit) and isinstance(value.value, str) and isinstance(beside, Col):
        kind = scope.type(beside.table, beside.name)
        if not isinstance(kind, T.StringType):
            return F.lit(value.value).cast(kind)
    return value.column(scope)


_ARITHMETIC = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": F.try_divide,
    "%": lambda a, b: F.try_mod(a, b),
}


@dataclass(frozen=True)
class Arith(Expr):
    """``left op right``; a division or remainder by zero is null."""

    op: str
    left: Expr
    right: Expr

    def column(self, scope: Scope) -> Column:
        return _ARITHMETIC[self.op](self.left.column(scope), self.right.column(scope))


@dataclass(frozen=True)
class NullIfZero(Expr):
    value: Expr

    def column(self, scope: Scope) -> Column:
        v = self.value.column(scope)
        return F.when(v != 0, v)


@dataclass(frozen=True)
class Hour(Expr):
    value: Expr

    def column(self, scope: Scope) -> Column:
        return F.hour(self.value.column(scope)).cast("bigint")


@dataclass(frozen=True)
class Ratio(Expr):
    """``top / bottom * times`` in doubles; null if the bottom is null or zero."""

    top: Expr
    bottom: Expr
    times: int = 1

    def column(self, scope: Scope) -> Column:
        top, bottom = self.top.column(scope).cast("double"), self.bottom.column(scope).cast("double")
        return F.when(bottom != 0, top / bottom * self.times)


_COMPARE = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


@dataclass(frozen=True)
class Cmp(Expr):
    op: str
    left: Expr
    right: Expr

    def column(self, scope: Scope) -> Column:
        return _COMPARE[self.op](_typed(self.left, self.right, scope), _typed(self.right, self.left, scope))


@dataclass(frozen=True)
class In(Expr):
    value: Expr
    options: tuple[Any, ...]
    negated: bool = False

    def column(self, scope: Scope) -> Column:
        found = self.value.column(scope).isin(*(_typed(Lit(o), self.value, scope) for o in self.options))
        return ~found if self.negated else found


@dataclass(frozen=True)
class Between(Expr):
    value: Expr
    low: Expr
    high: Expr

    def column(self, scope: Scope) -> Column:
        return self.value.column(scope).between(_typed(self.low, self.value, scope), _typed(self.high, self.value, scope))


@dataclass(frozen=True)
class Like(Expr):
    value: Expr
    pattern: str

    def column(self, scope: Scope) -> Column:
        return self.value.column(scope).like(self.pattern)


@dataclass(frozen=True)
class IsNull(Expr):
    value: Expr
    negated: bool = False

    def column(self, scope: Scope) -> Column:
        v = self.value.column(scope)
        return v.isNotNull() if self.negated else v.isNull()


@dataclass(frozen=True)
class And(Expr):
    parts: tuple[Expr, ...]

    def column(self, scope: Scope) -> Column:
        first, *rest = (p.column(scope) for p in self.parts)
        for p in rest:
            first = first & p
        return first


@dataclass(frozen=True)
class Or(Expr):
    parts: tuple[Expr, ...]

    def column(self, scope: Scope) -> Column:
        first, *rest = (p.column(scope) for p in self.parts)
        for p in rest:
            first = first | p
        return first


@dataclass(frozen=True)
class Not(Expr):
    part: Expr

    def column(self, scope: Scope) -> Column:
        return ~self.part.column(scope)


@dataclass(frozen=True)
class Case(Expr):
    """First branch whose condition holds; results are any values."""

    branches: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr = field(default_factory=lambda: Lit(None))

    def column(self, scope: Scope) -> Column:
        if not self.branches:
            return self.otherwise.column(scope)
        (when, then), *rest = self.branches
        out = F.when(when.column(scope), then.column(scope))
        for when, then in rest:
            out = out.when(when.column(scope), then.column(scope))
        return out.otherwise(self.otherwise.column(scope))

    def refs(self) -> set[tuple[str | None, str]]:
        return set().union(self.otherwise.refs(), *(x.refs() for b in self.branches for x in b))


# --- text to trees -----------------------------------------------------------

_BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Mod: "%"}
_RELATION = {ast.Eq: "=", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}


def _tree(text: str) -> ast.expr:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise SpecError("E008", f"not an expression: {text!r}") from e


def _value(node: ast.expr) -> Expr:
    match node:
        case ast.Name():
            return Col(None, node.id)
        case ast.Attribute(value=ast.Name()):
            return Col(node.value.id, node.attr)
        case ast.Constant() if isinstance(node.value, (int, float, str)) and not isinstance(node.value, bool):
            return Lit(node.value)
        case ast.UnaryOp(op=ast.USub()):
            inner = _value(node.operand)
            return Lit(-inner.value) if isinstance(inner, Lit) and not isinstance(inner.value, str) else Arith("-", Lit(0), inner)
        case ast.BinOp() if type(node.op) in _BINARY:
            return Arith(_BINARY[type(node.op)], _value(node.left), _value(node.right))
        case ast.Call(func=ast.Name()) if node.func.id.upper() == "NULLIF" and len(node.args) == 2 and isinstance(node.args[1], ast.Constant) and node.args[1].value == 0:
            return NullIfZero(_value(node.args[0]))
        case ast.Call(func=ast.Name()) if node.func.id.upper() == "HOUR" and len(node.args) == 1:
            return Hour(_value(node.args[0]))
    raise SpecError("E008", f"not allowed in an expression: {ast.unparse(node)}")


def _predicate(node: ast.expr) -> Expr:
    match node:
        case ast.BoolOp():
            parts = tuple(_predicate(v) for v in node.values)
            return And(parts) if isinstance(node.op, ast.And) else Or(parts)
        case ast.UnaryOp(op=ast.Not()):
            return Not(_predicate(node.operand))
        case ast.Compare() if all(type(op) in _RELATION for op in node.ops):
            sides = [_value(x) for x in (node.left, *node.comparators)]
            parts = tuple(Cmp(_RELATION[type(op)], a, b) for op, a, b in zip(node.ops, sides, sides[1:], strict=False))
            return parts[0] if len(parts) == 1 else And(parts)
    raise SpecError("E008", f"not allowed in a condition: {ast.unparse(node)}")


def parse_value(text: str) -> Expr:
    """Arithmetic over columns and numbers with + - * / %, parentheses, NULLIF(x, 0) and HOUR(x)."""
    return _value(_tree(text))


def parse_predicate(text: str) -> Expr:
    """Comparisons joined by AND, OR and NOT; = and <> are as in SQL."""
    out, quote, i = [], "", 0
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif text.startswith("<>", i):
            c, i = "!=", i + 1
        elif c == "=" and text[i - 1 : i] not in ("<", ">", "!", "=") and text[i + 1 : i + 2] != "=":
            c = "=="
        out.append(c)
        i += 1
    words = "".join(out).split(" ")
    return _predicate(_tree(" ".join(w.lower() if w in ("AND", "OR", "NOT") else w for w in words)))


def filter_of(column: Expr, operator: str, value: Any = None) -> Expr:
    """A predicate from an operator's name; an unknown one raises."""
    name = operator.upper().replace(" ", "_")
    names = {"EQ": "=", "NEQ": "!=", "GT": ">", "GTE": ">=", "LT": "<", "LTE": "<="} | {o: o for o in _COMPARE}
    if name in names:
        return Cmp(names[name], column, Lit(value))
    if name in ("IN", "NOT_IN"):
        return In(column, tuple(value), name == "NOT_IN")
    if name == "BETWEEN":
        low, high = value
        return Between(column, Lit(low), Lit(high))
    if name == "LIKE":
        return Like(column, value)
    if name in ("IS_NULL", "IS_NOT_NULL"):
        return IsNull(column, name == "IS_NOT_NULL")
    raise SpecError("UNKNOWN_OPERATOR", f"no operator {operator}")


def date_literal(day: datetime.date) -> Lit:
    return Lit(day.isoformat())
