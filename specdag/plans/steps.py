"""The closed plan: ten kinds of steps as frozen dataclasses, with a JSON form and a fingerprint."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

from specdag.functions import expr as E


@dataclass(frozen=True)
class Scan:
    table: str
    alias: str
    columns: tuple[str, ...]
    where: E.Expr | None = None


@dataclass(frozen=True)
class Subquery:
    """A nested plan under an alias of its own."""

    plan: Plan
    alias: str


@dataclass(frozen=True)
class Filter:
    """Rows that hold before aggregation or, with windows above it, after them."""

    predicate: E.Expr


@dataclass(frozen=True)
class JoinKey:
    left: E.Col
    right: E.Col
    normalize: str | None = None  # upper: compare in upper case


@dataclass(frozen=True)
class Join:
    """The rows so far with a scan, subquery or named result. ``pre_filter`` holds on the right side before the join.
    ``small``: the right side is known to be, and its size is checked before it is broadcast."""

    right: Scan | Subquery | Named
    how: str
    keys: tuple[JoinKey, ...] = ()
    pre_filter: E.Expr | None = None
    small: bool = False


@dataclass(frozen=True)
class Named:
    """A result of a program's earlier step."""

    name: str
    alias: str


@dataclass(frozen=True)
class Metric:
    name: str
    func: str
    input: E.Expr | None = None
    distinct: bool = False
    where: E.Expr | None = None


@dataclass(frozen=True)
class Key:
    name: str
    value: E.Expr


@dataclass(frozen=True)
class Aggregate:
    keys: tuple[Key, ...]
    metrics: tuple[Metric, ...]
    having: E.Expr | None = None


@dataclass(frozen=True)
class Order:
    value: E.Expr
    ascending: bool = True
    nulls_first: bool = False


@dataclass(frozen=True)
class Frame:
    """Bounds: an offset (negative before the row), "unbounded" or "current"."""

    kind: str
    start: int | str
    end: int | str


@dataclass(frozen=True)
class Window:
    name: str
    func: str
    input: E.Expr | None = None
    buckets: int | None = None
    partition: tuple[E.Expr, ...] = ()
    order: tuple[Order, ...] = ()
    frame: Frame | None = None


@dataclass(frozen=True)
class Derive:
    """A column more: a CASE label, a ratio, an hour or any other value."""

    name: str
    value: E.Expr


@dataclass(frozen=True)
class Project:
    columns: tuple[Key, ...]


@dataclass(frozen=True)
class Sort:
    by: tuple[Order, ...]


@dataclass(frozen=True)
class Limit:
    count: int
    offset: int = 0


@dataclass(frozen=True)
class Plan:
    steps: tuple[Any, ...] = field(default_factory=tuple)

    def fingerprint(self) -> str:
        return hashlib.sha256(dumps(self).encode()).hexdigest()


_KINDS = {c.__name__: c for c in (Scan, Subquery, Filter, JoinKey, Join, Named, Metric, Key, Aggregate, Order, Frame, Window, Derive, Project, Sort, Limit, Plan)} | {
    c.__name__: c for c in (E.Col, E.Lit, E.Arith, E.NullIfZero, E.Hour, E.Ratio, E.Cmp, E.In, E.Between, E.Like, E.IsNull, E.And, E.Or, E.Not, E.Case)
}


def _plain(x: Any) -> Any:
    if dataclasses.is_dataclass(x):
        return {"kind": type(x).__name__} | {f.name: _plain(getattr(x, f.name)) for f in dataclasses.fields(x)}
    return [_plain(v) for v in x] if isinstance(x, tuple) else x


def _rich(x: Any) -> Any:
    if isinstance(x, dict):
        kind = _KINDS[x["kind"]]
        return kind(**{k: _rich(v) for k, v in x.items() if k != "kind"})
    return tuple(_rich(v) for v in x) if isinstance(x, list) else x


def dumps(plan: Plan) -> str:
    return json.dumps(_plain(plan), sort_keys=True, ensure_ascii=False)


def loads(text: str) -> Plan:
    return _rich(json.loads(text))
