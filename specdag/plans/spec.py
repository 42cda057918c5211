"""Specifications: a Markdown or YAML text, or a dict, to frozen dataclasses, with rejections and warnings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from specdag.errors import Finding, SpecError
from specdag.functions.expr import Expr, parse_predicate, parse_value
from specdag.functions.names import row_count
from specdag.sources.catalog import TableMeta

#: Keys that would carry free SQL text.
BANNED = ("raw_sql", "where_sql", "join_on", "expression", "aggregation_expr", "having_sql")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
JOIN_TYPES = ("INNER", "LEFT", "RIGHT", "FULL", "CROSS")


@dataclass(frozen=True)
class FilterSpec:
    column: str
    operator: str
    value: Any = None


@dataclass(frozen=True)
class TableSpec:
    name: str
    alias: str
    columns: tuple[str, ...]
    meta: TableMeta
    filters: tuple[FilterSpec, ...] = ()


@dataclass(frozen=True)
class MetricSpec:
    name: str
    func: str
    column: str | None = None
    expression: Expr | None = None
    filter: FilterSpec | None = None
    distinct: bool = False


@dataclass(frozen=True)
class JoinSpec:
    left: str
    right: str
    keys: tuple[tuple[str, str], ...]
    how: str = "INNER"


@dataclass(frozen=True)
class TimeRange:
    column: str
    start: str | None = None
    end: str | None = None
    inclusive: bool = True
    calendar: str | None = None
    fiscal_year: int | None = None
    relative: str | None = None


@dataclass(frozen=True)
class CaseSpec:
    output: str
    branches: tuple[tuple[Expr, Any, bool], ...]  # condition, result, is the result a column
    otherwise: Any = None
    otherwise_column: bool = False
    phase: str | None = None  # pre_aggregate, post_aggregate or to be inferred


@dataclass(frozen=True)
class StepSpec:
    name: str
    sources: tuple[str, ...]
    group_by: tuple[str, ...] = ()
    metrics: tuple[MetricSpec, ...] = ()
    expressions: tuple[tuple[str, Expr], ...] = ()
    cases: tuple[CaseSpec, ...] = ()
    joins: tuple[JoinSpec, ...] = ()
    filters: tuple[FilterSpec, ...] = ()
    time_range: TimeRange | None = None


@dataclass(frozen=True)
class WindowSpec:
    name: str
    func: str
    column: str | None = None
    buckets: int | None = None
    partition_by: tuple[str, ...] = ()
    order_by: tuple[tuple[str, bool], ...] = ()
    frame: tuple[str, int | str, int | str] | None = None
    keep_at_most: int | None = None


@dataclass(frozen=True)
class RatioSpec:
    name: str
    top: str
    bottom: str
    times: int = 1


@dataclass(frozen=True)
class Spec:
    tables: tuple[TableSpec, ...]
    outputs: tuple[str, ...]
    metrics: tuple[MetricSpec, ...] = ()
    dimensions: tuple[tuple[str, str], ...] = ()
    hours: tuple[tuple[str, str], ...] = ()
    joins: tuple[JoinSpec, ...] = ()
    time_range: TimeRange | None = None
    cases: tuple[CaseSpec, ...] = ()
    windows: tuple[WindowSpec, ...] = ()
    ratios: tuple[RatioSpec, ...] = ()
    steps: tuple[StepSpec, ...] = ()
    grain: tuple[str, ...] = ()
    sort: tuple[tuple[str, bool], ...] = ()
    limit: int | None = None
    computed: tuple[tuple[str, Expr], ...] = ()  # metrics made of metrics
    warnings: tuple[Finding, ...] = field(default=(), compare=False)


def load(text: str) -> dict:
    """The mapping in a Markdown text's first YAML block, or in a YAML text."""
    import yaml

    block = re.search(r"^---\s*\n(.*?)^---\s*$", text, re.DOTALL | re.MULTILINE) or re.search(r"^```ya?ml\s*\n(.*?)^```", text, re.DOTALL | re.MULTILINE)
    try:
        found = yaml.safe_load(block[1] if block else text)
    except yaml.YAMLError as e:
        raise SpecError("E001", f"the metadata cannot be read: {e}") from e
    if not isinstance(found, dict):
        raise SpecError("E001", "there is no metadata")
    return found.get("spec", found)


def _only(raw: dict, where: str, *keys: str) -> dict:
    if extra := sorted(set(raw) - set(keys)):
        raise SpecError("UNKNOWN_KEY", f"{where} has unknown keys {extra}")
    return raw


def _banned(raw: Any, inside: str = "") -> None:
    if isinstance(raw, dict):
        for k, v in raw.items():
            if k in BANNED and not (k == "expression" and inside == "expressions"):
                raise SpecError("E007", f"free SQL text is not allowed: {k}")
            _banned(v, k)
    elif isinstance(raw, list):
        for v in raw:
            _banned(v, inside)


def _need(raw: dict, key: str, where: str) -> Any:
    if raw.get(key) in (None, "", []):
        raise SpecError("E002", f"{where} needs {key}")
    return raw[key]


def _filter(raw: dict) -> FilterSpec:
    _only(raw, "a filter", "column_ref", "operator", "value")
    return FilterSpec(_need(raw, "column_ref", "a filter"), _need(raw, "operator", "a filter"), raw.get("value"))


def _table(raw: dict, warnings: list[Finding]) -> TableSpec:
    name, alias = _need(raw, "name", "a table"), raw.get("alias") or raw["name"].rpartition(".")[2]
    if not _NAME.fullmatch(alias):
        raise SpecError("E003", f"{alias!r} is no alias")
    columns, types, enums, nullable, unique = [], {}, {}, {}, []
    for c in [*raw.get("key_columns", []), *raw.get("business_columns", []), *raw.get("columns", [])]:
        c = {"name": c} if isinstance(c, str) else _only(c, f"a column of {alias}", "name", "type", "enum", "nullable", "unique", "description")
        column = _need(c, "name", f"a column of {alias}")
        if column in columns:
            continue
        columns.append(column)
        if c.get("type"):
            types[column] = c["type"]
        else:
            warnings.append(Finding("W001", "warn", f"{alias}.{column} has no type"))
        if c.get("enum"):
            enums[column] = tuple(c["enum"])
        if "nullable" in c:
            nullable[column] = c["nullable"]
        if c.get("unique"):
            unique.append((column,))
    for extra in (raw.get("time_field"), raw.get("partition_field")):
        if extra and extra not in columns:
            columns.append(extra)
    keys = [tuple([k] if isinstance(k, str) else k) for k in raw.get("unique_keys", [])]
    rows = row_count(raw.get("row_count"))
    if raw.get("row_count") and rows is None:
        warnings.append(Finding("W005", "warn", f"{alias}: cannot read the row count {raw['row_count']!r}"))
    meta = TableMeta(name, raw.get("role"), tuple(dict.fromkeys([*unique, *keys])), (), rows, raw.get("time_field"), enums, types, nullable)
    return TableSpec(name, alias, tuple(columns), meta, tuple(_filter(f) for f in raw.get("filters", [])))


def _metric(raw: dict) -> tuple[MetricSpec, ...]:
    """A metric and its filtered variants."""
    name, func = raw.get("metric_name") or raw.get("name") or _need(raw, "alias", "a metric"), _need(raw, "aggregation", "a metric").upper()
    base = MetricSpec(name, func, raw.get("input_column"), parse_value(raw["input_expression"]) if raw.get("input_expression") else None, _filter(raw["filter"]) if raw.get("filter") else None, bool(raw.get("distinct")))
    if base.column is None and base.expression is None and func != "COUNT":
        raise SpecError("E002", f"{name}: {func} needs an input")
    variants = [MetricSpec(_need(v, "alias", "a variant"), func, base.column, base.expression, _filter(v["filter"]), base.distinct) for v in raw.get("variants", [])]
    return (base, *variants)


def _join(raw: dict) -> JoinSpec:
    how = (raw.get("join_type") or "INNER").upper()
    if how not in JOIN_TYPES:
        raise SpecError("JOIN", f"no join {how}")
    left, right = raw.get("left_key"), raw.get("right_key") or raw.get("left_key")
    as_list = lambda k: [k] if isinstance(k, str) else list(k or [])
    return JoinSpec(_need(raw, "left_table", "a join"), _need(raw, "right_table", "a join"), tuple(zip(as_list(left), as_list(right), strict=True)), how)


def _range(raw: dict) -> TimeRange:
    _only(raw, "a time range", "column_ref", "start", "end", "inclusive", "calendar_type", "relative_range", "fiscal_year")
    text = lambda v: None if v is None else str(v)
    return TimeRange(_need(raw, "column_ref", "a time range"), text(raw.get("start")), text(raw.get("end")), raw.get("inclusive", True), raw.get("calendar_type"), raw.get("fiscal_year"), raw.get("relative_range"))


def _case(raw: dict) -> CaseSpec:
    branches = []
    for b in [*raw.get("branches", []), *raw.get("typed_branches", [])]:
        column = b.get("then_column")
        branches.append((parse_predicate(_need(b, "when", "a branch")), column or b.get("then", b.get("label")), column is not None))
    column = raw.get("else_column")
    return CaseSpec(_need(raw, "output_column", "a case"), tuple(branches), column or raw.get("else_value", raw.get("else_label")), column is not None, raw.get("evaluation_phase"))


def _step(raw: dict) -> StepSpec:
    name = _need(raw, "step_name", "a step")
    _only(raw, f"step {name}", "step_name", "source", "group_by", "metrics", "expressions", "output_alias", "case_when", "joins", "filters", "time_range", "description")
    source = raw.get("source", "input")
    cases = raw.get("case_when") or []
    return StepSpec(
        name,
        tuple([source] if isinstance(source, str) else source),
        tuple(raw.get("group_by", [])),
        tuple(m for r in raw.get("metrics", []) for m in _metric({**r, "metric_name": r.get("alias") or r.get("metric_name")})),
        tuple((e.get("alias") or e["name"], parse_value(e.get("formula") or e["expression"])) for e in raw.get("expressions", [])),
        tuple(_case(c) for c in ([cases] if isinstance(cases, dict) else cases)),
        tuple(_join(j) for j in raw.get("joins", [])),
        tuple(_filter(f) for f in raw.get("filters", [])),
        _range(raw["time_range"]) if raw.get("time_range") else None,
    )


def _order(raw: list) -> tuple[tuple[str, bool], ...]:
    out = []
    for s in raw:
        name, direction = (s, "ASC") if isinstance(s, str) else (s.get("column") or s["column_ref"], s.get("direction", "ASC").upper())
        if direction not in ("ASC", "DESC"):
            raise SpecError("SORT", f"no direction {direction}")
        out.append((name, direction == "ASC"))
    return tuple(out)


def _window(raw: dict) -> WindowSpec:
    frame = raw.get("frame")
    return WindowSpec(_need(raw, "name", "a window"), _need(raw, "function", "a window").upper(), raw.get("input_column"), raw.get("buckets"), tuple(raw.get("partition_by", [])), _order(raw.get("order_by", [])), (frame["kind"].lower(), frame["start"], frame["end"]) if frame else None, raw.get("keep_at_most"))


def parse(source: str | dict) -> Spec:
    """Read a specification; what cannot be meant raises, what may be meant is a warning."""
    raw = load(source) if isinstance(source, str) else source
    _banned(raw)
    warnings: list[Finding] = []
    tables = tuple(_table(t, warnings) for t in _need(raw, "source_tables" if "source_tables" in raw else "input_tables", "a specification"))
    aliases = [t.alias for t in tables]
    if twice := sorted({a for a in aliases if aliases.count(a) > 1}):
        raise SpecError("E005", f"aliases {twice} are used twice")
    outputs = raw.get("output_columns")
    if not outputs:
        raise SpecError("E006", "there are no output columns")
    if not raw.get("time_range"):
        warnings.append(Finding("W002", "warn", "there is no time range"))
    if not raw.get("sort"):
        warnings.append(Finding("W004", "warn", "there is no sort"))
    spec = Spec(
        tables,
        tuple(o if isinstance(o, str) else o["name"] for o in outputs),
        tuple(m for r in raw.get("metrics", []) for m in _metric(r)),
        tuple((d.get("dimension_name") or d["column_ref"].rpartition(".")[2], d["column_ref"]) for d in raw.get("dimensions", [])),
        tuple((h["name"], h["column_ref"]) for h in raw.get("hours", [])),
        tuple(_join(j) for j in raw.get("joins", [])),
        _range(raw["time_range"]) if raw.get("time_range") else None,
        tuple(_case(c) for c in raw.get("labels", [])),
        tuple(_window(w) for w in raw.get("windows", [])),
        tuple(RatioSpec(r["name"], r["numerator"], r["denominator"], r.get("multiplier", 1)) for r in raw.get("ratios", [])),
        tuple(_step(s) for s in raw.get("compute_steps", [])),
        tuple(raw.get("target_grain", [])),
        _order(raw.get("sort", [])),
        raw.get("limit"),
        tuple((_need(c, "name", "a computed metric"), parse_value(_need(c, "formula", "a computed metric"))) for c in raw.get("computed_metrics", [])),
        tuple(warnings),
    )
    _check_references(spec)
    return spec


def _check_references(spec: Spec) -> None:
    known = {t.alias: set(t.columns) for t in spec.tables}
    names = set(known) | {s.name for s in spec.steps}

    def column(ref: str, where: str) -> None:
        alias, dot, name = ref.rpartition(".")
        if dot and (alias not in known or name not in known[alias]):
            raise SpecError("E004", f"{where} names {ref}, which no table declares")
        if not dot and not spec.steps and sum(name in c for c in known.values()) != 1:
            raise SpecError("E004" if not any(name in c for c in known.values()) else "E003", f"{where} names {ref}, which {'no' if not any(name in c for c in known.values()) else 'more than one'} table declares")

    for name, ref in spec.dimensions:
        column(ref, f"dimension {name}")
    for j in spec.joins:
        for t in (j.left, j.right):
            if t not in names:
                raise SpecError("E004", f"a join names {t}, which is no table or step")
    if not spec.steps:
        for m in spec.metrics:
            if m.column:
                column(m.column, f"metric {m.name}")
    if spec.time_range:
        column(spec.time_range.column, "the time range")
    metrics = [m.name for m in spec.metrics]
    taken = set(metrics) | {w.name for w in spec.windows} | {n for n, _ in spec.dimensions}
    made = set(metrics) | {w.name for w in spec.windows}
    for r in spec.ratios:
        if r.name not in spec.outputs or r.name in taken:
            raise SpecError("RATIO", f"ratio {r.name} must be an output column and nothing else")
        if r.times not in (1, 100):
            raise SpecError("RATIO", f"ratio {r.name} may be times 1 or 100")
        if {r.top, r.bottom} - made:
            raise SpecError("RATIO", f"ratio {r.name} needs {sorted({r.top, r.bottom} - made)}")
        made.add(r.name)
