"""Specifications to plans: single tables, joins and chains."""

from __future__ import annotations

import datetime

from specdag.errors import SpecError
from specdag.functions import calendar
from specdag.functions import expr as E
from specdag.plans import steps as S
from specdag.plans.spec import CaseSpec, FilterSpec, JoinSpec, MetricSpec, Spec, TableSpec, TimeRange, WindowSpec


def column(ref: str) -> E.Col:
    table, _, name = ref.rpartition(".")
    return E.Col(table or None, name)


def filter_expr(f: FilterSpec, alias: str | None = None) -> E.Expr:
    c = column(f.column)
    return E.filter_of(E.Col(c.table or alias, c.name), f.operator, f.value)


def metric(m: MetricSpec) -> S.Metric:
    value = m.expression if m.expression is not None else column(m.column) if m.column else None
    return S.Metric(m.name, m.func, value, m.distinct, filter_expr(m.filter) if m.filter else None)


def case(c: CaseSpec) -> S.Derive:
    result = lambda v, is_column: column(v) if is_column else E.Lit(v)
    return S.Derive(c.output, E.Case(tuple((when, result(then, col)) for when, then, col in c.branches), result(c.otherwise, c.otherwise_column)))


def time_filter(t: TimeRange, as_of: datetime.date | None = None) -> E.Expr:
    c = column(t.column)
    if t.relative:
        return calendar.relative(c, t.relative, as_of)
    if t.calendar:
        if t.fiscal_year is None:
            raise SpecError("TIME_RANGE", "a fiscal calendar needs a year")
        return calendar.fiscal(c, t.calendar, t.fiscal_year)
    return calendar.fixed(c, t.start, t.end, t.inclusive)


def window(w: WindowSpec, grain: tuple[str, ...]) -> list:
    """The window and, if only its first rows are kept, the filter on it. ROW_NUMBER is made sure by the output's grain."""
    by = [S.Order(E.Col(None, name), ascending) for name, ascending in w.order_by]
    if w.func == "ROW_NUMBER":
        by += [S.Order(E.Col(None, g)) for g in grain if g not in [n for n, _ in w.order_by]]
    func = w.func + "_OVER" if w.func in ("SUM", "AVG", "COUNT") else w.func
    out: list = [S.Window(w.name, func, E.Col(None, w.column) if w.column else None, w.buckets, tuple(E.Col(None, p) for p in w.partition_by), tuple(by), S.Frame(*w.frame) if w.frame else None)]
    if w.keep_at_most is not None:
        out.append(S.Filter(E.Cmp("<=", E.Col(None, w.name), E.Lit(w.keep_at_most))))
    return out


def phase(c: CaseSpec, spec: Spec) -> str:
    """Where a label is evaluated: as declared, else before grouping if it is a dimension or reads stored columns only, and
    after it if it reads a metric."""
    if c.phase in ("pre_aggregate", "post_aggregate"):
        return c.phase
    if c.phase:
        raise SpecError("PHASE", f"no phase {c.phase}")
    if c.output in spec.grain or c.output in {n for n, _ in spec.dimensions}:
        return "pre_aggregate"
    used = set().union(*(when.refs() for when, _, _ in c.branches))
    names = {name for _, name in used}
    if names & {m.name for m in spec.metrics}:
        return "post_aggregate"
    stored = {col for t in spec.tables for col in t.columns}
    if names <= stored:
        return "pre_aggregate"
    raise SpecError("PHASE", f"say when {c.output} is evaluated: pre_aggregate or post_aggregate")


def scan(t: TableSpec) -> S.Scan:
    parts = tuple(filter_expr(f, t.alias) for f in t.filters)
    return S.Scan(t.name, t.alias, t.columns, None if not parts else parts[0] if len(parts) == 1 else E.And(parts))


def ordered_joins(tables: tuple[TableSpec, ...], joins: tuple[JoinSpec, ...]) -> list[JoinSpec]:
    """The joins in an order in which each adds one table to those before, beginning with the first table."""
    seen, left, out = {tables[0].alias}, list(joins), []
    while left:
        ready = next((j for j in left if (j.left in seen) != (j.right in seen)), None)
        if ready is None:
            raise SpecError("JOIN", f"{sorted({t for j in left for t in (j.left, j.right)} - seen) or [j.right for j in left]} cannot be reached, or twice")
        left.remove(ready)
        if ready.right in seen:
            turned = {"LEFT": "RIGHT", "RIGHT": "LEFT"}
            ready = JoinSpec(ready.right, ready.left, tuple((r, l) for l, r in ready.keys), turned.get(ready.how, ready.how))
        out.append(ready)
        seen.add(ready.right)
    if missing := [t.alias for t in tables if t.alias not in seen]:
        raise SpecError("JOIN", f"tables {missing} have no join")
    return out


def build(spec: Spec, as_of: datetime.date | None = None) -> S.Plan:
    """The canonical order: sources and joins, filters, time range, labels before grouping, grouping, labels after it,
    windows and their filters, ratios, projection, sort, limit."""
    by_alias = {t.alias: t for t in spec.tables}
    steps: list = [scan(spec.tables[0])]
    for j in ordered_joins(spec.tables, spec.joins):
        t = by_alias[j.right]
        keys = tuple(S.JoinKey(E.Col(j.left, l), E.Col(j.right, r)) for l, r in j.keys)
        steps.append(S.Join(scan(t), j.how.lower(), keys, small=t.meta.role == "dim"))
    if spec.time_range:
        steps.append(S.Filter(time_filter(spec.time_range, as_of)))
    steps += [S.Derive(name, E.Hour(column(ref))) for name, ref in spec.hours]
    phases = {}
    for c in spec.cases:
        phases.setdefault(c.output, (c, phase(c, spec)))  # of two rules for a column the first counts
    steps += [case(c) for c, when in phases.values() if when == "pre_aggregate"]
    if spec.metrics:
        keys = [S.Key(name, column(ref)) for name, ref in spec.dimensions]
        keys += [S.Key(name, E.Col(None, name)) for name in [h for h, _ in spec.hours] + [c for c, (_, when) in phases.items() if when == "pre_aggregate"] if name not in {k.name for k in keys}]
        steps.append(S.Aggregate(tuple(keys), tuple(metric(m) for m in spec.metrics)))
    steps += [case(c) for c, when in phases.values() if when == "post_aggregate"]
    for w in spec.windows:
        steps += window(w, spec.grain)
    steps += [S.Derive(r.name, E.Ratio(E.Col(None, r.top), E.Col(None, r.bottom), r.times)) for r in spec.ratios]
    steps += [S.Derive(name, value) for name, value in spec.computed]
    dimensions = dict(spec.dimensions)
    steps.append(S.Project(tuple(S.Key(o, E.Col(None, o) if spec.metrics or o not in dimensions else column(dimensions[o])) for o in spec.outputs)))
    if spec.sort:
        steps.append(S.Sort(tuple(S.Order(E.Col(None, name), asc) for name, asc in spec.sort)))
    if spec.limit is not None:
        steps.append(S.Limit(spec.limit))
    return S.Plan(tuple(steps))
