"""Programs: compute steps as a graph of DataFrames."""

from __future__ import annotations

import datetime
import enum
import heapq
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specdag.errors import Finding, SpecError, raise_if_rejected
from specdag.functions import expr as E
from specdag.functions.expr import MARK, Scope
from specdag.operators.lower import aggregate, lower
from specdag.plans import build as B
from specdag.plans import steps as S
from specdag.plans.perf import lint
from specdag.plans.spec import CaseSpec, JoinSpec, MetricSpec, Spec, StepSpec, TableSpec
from specdag.plans.validate import check_label, check_plan, check_spec, check_window, join_evidence, merge_facts
from specdag.sources.catalog import Catalog, TableMeta


def order(steps: tuple[StepSpec, ...]) -> list[StepSpec]:
    """Each step behind its sources; among those ready the first by name."""
    by_name = {s.name: s for s in steps}
    waiting = {s.name: {x for x in s.sources if x != "input"} for s in steps}
    ready = [n for n, needs in waiting.items() if not needs]
    heapq.heapify(ready)
    out = []
    while ready:
        name = heapq.heappop(ready)
        out.append(by_name[name])
        for other, needs in waiting.items():
            if name in needs:
                needs.discard(name)
                if not needs:
                    heapq.heappush(ready, other)
    if len(out) < len(steps):
        raise SpecError("CIRCULAR_DEPENDENCY", f"steps {sorted(set(by_name) - {s.name for s in out})} wait for each other")
    return out


def check(spec: Spec) -> list[Finding]:
    """Missing sources, doubled names, steps that nothing reads, and steps without work."""
    out, names = [], [s.name for s in spec.steps]
    for n in sorted({n for n in names if names.count(n) > 1}):
        out.append(Finding("DAG_DUPLICATE", "reject", f"two steps are called {n}"))
    for s in spec.steps:
        out += [Finding("DAG_MISSING", "reject", f"{s.name} reads {x}, which no step makes") for x in s.sources if x != "input" and x not in names]
        if not (s.metrics or s.expressions or s.cases or s.group_by or len(s.sources) > 1):
            out.append(Finding("DAG_IDLE", "warn", f"{s.name} does nothing"))
    if not any(f.level == "reject" for f in out):
        final = order(spec.steps)[-1].name
        read = {x for s in spec.steps for x in s.sources}
        out += [Finding("DAG_UNREAD", "reject", f"nothing reads {n}") for n in names if n not in read and n != final]
    return out


class Kind(enum.Enum):
    """What a step is to the others: it makes rows for them, reads theirs, is the last, or stands alone."""

    PRODUCER = "PRODUCER"
    CONSUMER = "CONSUMER"
    FINAL = "FINAL"
    STANDALONE = "STANDALONE"


def kinds(steps: tuple[StepSpec, ...]) -> dict[str, Kind]:
    """The kind of each step, in the order of running."""
    ordered = order(steps)
    if len(ordered) == 1:
        return {ordered[0].name: Kind.STANDALONE}
    out = {s.name: Kind.CONSUMER if any(x != "input" for x in s.sources) else Kind.PRODUCER for s in ordered}
    return out | {ordered[-1].name: Kind.FINAL}


def branches(spec: Spec) -> Spec:
    """A specification whose filtered metrics are steps of their own: one for each over the output's grain, and one that merges them by
    FULL joins, with a label that takes the first branch there is a value of. Without two filtered metrics it is returned as it is."""
    own = [m for m in spec.metrics if m.filter is not None]
    if spec.steps or len(own) < 2 or not spec.grain:
        return spec
    made = tuple(StepSpec(f"branch_{m.name}", ("input",), spec.grain, (replace(m, filter=None),), filters=(m.filter,), time_range=spec.time_range) for m in own)
    joins = tuple(JoinSpec(made[0].name, b.name, tuple((g, g) for g in spec.grain), "FULL") for b in made[1:])
    label = next((o for o in spec.outputs if o not in spec.grain and o not in {m.name for m in own}), None)
    cases = (CaseSpec(label, tuple((E.IsNull(E.Col(None, m.name), True), m.name, True) for m in own), phase="post_aggregate"),) if label else ()
    merge = StepSpec("merge_conditional", tuple(b.name for b in made), cases=cases, joins=joins)
    return replace(spec, metrics=(), dimensions=(), joins=(), time_range=None, steps=(*made, merge))


#: How the name of a metric over all rows begins.
OVERALL = ("total", "global", "overall", "all")


def cross_grain(spec: Spec) -> Spec:
    """A specification whose computed metrics read a metric that it does not declare: that is one over all rows, so there is a step by
    the output's grain, one without any, which has one row, and one that puts the second beside the first and computes.

    ``total_x`` (global, overall, all) is the declared metric x over all rows; any other name is the first metric's. A specification that
    reads declared metrics only is returned as it is; one over several tables has to declare its steps and raises."""
    known = {m.name for m in spec.metrics} | {w.name for w in spec.windows} | {r.name for r in spec.ratios} | {n for n, _ in (*spec.dimensions, *spec.computed)}
    missing = list(dict.fromkeys(n for _, value in spec.computed for _, n in sorted(value.refs(), key=str) if n not in known))
    if spec.steps or not missing:
        return spec
    if len(spec.tables) > 1 or not spec.metrics or any(name != ref.rpartition(".")[2] for name, ref in spec.dimensions):
        raise SpecError("CROSS_GRAIN", f"{missing} are declared nowhere: say by what steps they are made")
    of = lambda name: next((m for m in spec.metrics if name in {f"{p}_{m.name}" for p in OVERALL}), spec.metrics[0])
    grouped = StepSpec("grouped", ("input",), tuple(ref for _, ref in spec.dimensions), spec.metrics, time_range=spec.time_range)
    overall = StepSpec("overall", ("input",), (), tuple(replace(of(name), name=name) for name in missing), time_range=spec.time_range)
    merged = StepSpec("merged", ("grouped", "overall"), expressions=spec.computed, joins=(JoinSpec("grouped", "overall", (), "CROSS"),))
    return replace(spec, metrics=(), dimensions=(), time_range=None, computed=(), steps=(grouped, overall, merged))


@dataclass
class Result:
    """A step's rows and the column groups that are unique in them. A name that two sources have is there under each source's."""

    df: DataFrame
    unique: tuple[tuple[str, ...], ...] = ()


def bind_table(step: StepSpec, tables: tuple[TableSpec, ...]) -> TableSpec:
    """The table that declares most of the columns that a step on the input uses; a tie raises."""
    used = {c.rpartition(".")[2] for c in step.group_by} | {m.column.rpartition(".")[2] for m in step.metrics if m.column}
    used |= {n for m in step.metrics if m.expression is not None for _, n in m.expression.refs()} | {f.column.rpartition(".")[2] for f in step.filters}
    used |= {n for c in step.cases for when, _, _ in c.branches for _, n in when.refs()}
    named = {r.rpartition(".")[0] for r in step.group_by if "." in r}
    scores = sorted(((t.alias in named, len(used & set(t.columns)), t.alias) for t in tables), reverse=True)
    if not scores or (not scores[0][0] and scores[0][1] == 0 and used):
        raise SpecError("TABLE_MATCH", f"no table has the columns of {step.name}")
    if len(scores) > 1 and scores[0][:2] == scores[1][:2]:
        raise SpecError("TABLE_MATCH", f"{step.name} may read {scores[0][2]} or {scores[1][2]}")
    return next(t for t in tables if t.alias == scores[0][2])


def _bare(df: DataFrame) -> list[str]:
    return [c.rpartition(MARK)[2] for c in df.columns]


def auto_keys(left: list[str], right: TableSpec | list[str], name: str, joins: tuple[JoinSpec, ...]) -> tuple[tuple[str, str], ...]:
    """All common column names, else a declared join on that table."""
    columns = right.columns if isinstance(right, TableSpec) else right
    common = tuple((c, c) for c in left if c in columns)
    if common:
        return common
    for j in joins:
        if j.right == name and all(l in left for l, _ in j.keys):
            return j.keys
        if j.left == name and all(r in left for _, r in j.keys):
            return tuple((r, l) for l, r in j.keys)
    return ()


def bridge(left: list[str], tables: tuple[TableSpec, ...], target: TableSpec) -> tuple[TableSpec, tuple[tuple[str, str], ...], tuple[tuple[str, str], ...]] | None:
    """A table between: the rows have its unique key, and it has a column ``x_<key>`` or ``<key>`` for the target's."""
    for t in sorted(tables, key=lambda t: t.alias):
        if t.alias == target.alias:
            continue
        first = next((((k, k),) for (k, *more) in t.meta.unique_keys if not more and k in left), None)
        second = next((((c, k),) for (k, *more) in target.meta.unique_keys if not more for c in t.columns if c == k or c.endswith(f"_{k}")), None)
        if first and second:
            return t, first, second
    return None


def _named(c: E.Col, there: list[str]) -> E.Col:
    """The column under its source's name if two sources have it, else by its name alone."""
    return c if c.table and f"{c.table}{MARK}{c.name}" in there else E.Col(None, c.name)


class Runner:
    def __init__(self, spec: Spec, catalog: Catalog, as_of: datetime.date | None = None, on_fanout: str = "error"):
        self.spec, self.catalog, self.as_of, self.on_fanout = spec, catalog, as_of, on_fanout
        self.results: dict[str, Result] = {}
        self.persisted: list[DataFrame] = []

    def _join(self, left: Result, right: Result, name: str, alias: str, keys: tuple[tuple[str, str], ...], how: str, on_fanout: str) -> Result:
        """Join the right side under ``alias`` to the left one, ``name``. A key of one name appears once; any other column that both have
        appears under both names, so that reading it without one raises."""
        if how == "cross":
            on_fanout, on = "allow", None
        elif not keys:
            raise SpecError("JOIN", f"{alias} has no join keys")
        unique = any(set(u) <= {r for _, r in keys} for u in right.unique)
        if not unique and on_fanout == "error":
            raise SpecError("FANOUT", f"{[r for _, r in keys]} is no declared unique key of {alias}")
        marked = right.df.select(*(F.col(f"`{c}`").alias(f"{alias}{MARK}{c}") for c in right.df.columns))
        if how != "cross":
            on = [F.col(f"`{l}`") == F.col(f"`{alias}{MARK}{r}`") for l, r in keys]
        joined = left.df.crossJoin(marked) if on is None else left.df.join(marked, on, how)
        same = {l for l, r in keys if l == r}
        twice = {c for c in _bare(left.df) if c in right.df.columns and c not in same}
        columns = []
        for c in left.df.columns:
            own = F.col(f"`{c}`")
            columns.append((F.coalesce(own, F.col(f"`{alias}{MARK}{c}`")) if c in same and how in ("right", "full") else own).alias(f"{name}{MARK}{c}" if c in twice else c))
        columns += [F.col(f"`{alias}{MARK}{c}`").alias(f"{alias}{MARK}{c}" if c in twice else c) for c in right.df.columns if c not in same]
        return Result(joined.select(*columns), left.unique if unique and how in ("inner", "left") else ())

    def _table(self, t: TableSpec) -> Result:
        df = lower(S.Plan((B.scan(t),)), self.catalog)
        return Result(df.select(*(F.col(f"`{c}`").alias(c.rpartition(MARK)[2]) for c in df.columns)), t.meta.unique_keys)

    def _sources(self, step: StepSpec) -> Result:
        tables = {t.alias: t for t in self.spec.tables}
        if step.sources == ("input",):
            first = tables[step.joins[0].left] if step.joins and step.joins[0].left in tables else bind_table(step, self.spec.tables)
            name, found = first.alias, self._table(first)
        else:
            name = step.sources[0]
            found = self.results[name] if name != "input" else self._table(bind_table(step, self.spec.tables))
        seen = {name}
        wanted = [s for s in step.sources[1:]] + [n for j in step.joins for n in (j.left, j.right) if n not in step.sources and n not in seen]
        for other in dict.fromkeys(w for w in wanted if w != name):
            right = self.results.get(other) or self._table(tables[other])
            j = next((j for j in (*step.joins, *self.spec.joins) if {j.left, j.right} & {other} and {j.left, j.right} & (seen | {"input"})), None)
            if j is not None:
                turn = {"LEFT": "right", "RIGHT": "left"}
                keys = j.keys if j.right == other else tuple((r, l) for l, r in j.keys)
                how = j.how.lower() if j.right == other else turn.get(j.how, j.how.lower())
            else:
                how, keys = "inner", tuple((c, c) for c in found.df.columns if c in right.df.columns and c in step.group_by)
                if not keys:
                    raise SpecError("JOIN", f"{step.name}: say how {name} and {other} are joined")
            # a LEFT join may multiply rows in a step; any other needs a unique key on its right
            found = self._join(found, right, name, other, keys, how, "allow" if how == "left" else self.on_fanout)
            seen.add(other)
        return self._prefixed(step, found, seen, tables)

    def _prefixed(self, step: StepSpec, found: Result, seen: set[str], tables: dict[str, TableSpec]) -> Result:
        """A metric or group column that names a table not yet there brings it in: by common columns, by a declared join,
        or over one table between."""
        refs = [m.column for m in step.metrics if m.column] + list(step.group_by)
        for alias in dict.fromkeys(r.rpartition(".")[0] for r in refs if "." in r):
            if alias in seen or alias not in tables or all(r.rpartition(".")[2] in found.df.columns for r in refs if r.startswith(f"{alias}.")):
                continue
            target, name = tables[alias], next(iter(sorted(seen)))
            keys = auto_keys(found.df.columns, target, alias, (*step.joins, *self.spec.joins))
            if not keys:
                between = bridge(found.df.columns, self.spec.tables, target)
                if between is None:
                    raise SpecError("JOIN", f"{step.name}: no way to {alias}")
                middle, first, keys = between
                found = self._join(found, self._table(middle), name, middle.alias, first, "inner", "error")
                seen.add(middle.alias)
            self._evidence(found, target, keys)
            found = self._join(found, self._table(target), name, alias, keys, "inner", "error")
            seen.add(alias)
        return found

    def _evidence(self, found: Result, target: TableSpec, keys: tuple[tuple[str, str], ...]) -> None:
        """Raise if keys that no one declared speak too weakly for a join."""
        for l, r in keys:
            declared = any((l, r) in j.keys or (r, l) in j.keys for j in self.spec.joins)
            left = TableMeta("rows", unique_keys=tuple(u for u in found.unique if u == (l,)))
            if join_evidence(left, target.meta, l, r, declared=declared or (r,) in target.meta.unique_keys).action == "block":
                raise SpecError("JOIN_EVIDENCE", f"say that {l} and {target.alias}.{r} are joined")

    def _metric(self, m: MetricSpec, there: list[str]) -> S.Metric:
        plain = B.metric(m)
        value = _named(plain.input, there) if isinstance(plain.input, E.Col) else plain.input
        return S.Metric(plain.name, plain.func, value, plain.distinct, plain.where)

    def run_step(self, step: StepSpec) -> Result:
        """Filters, labels before grouping, grouping, expressions, labels after it."""
        found = self._sources(step)
        todo: list = [S.Filter(B.filter_expr(f)) for f in step.filters]
        if step.time_range:
            todo.append(S.Filter(B.time_filter(step.time_range, self.as_of)))
        early = [c for c in step.cases if c.phase == "pre_aggregate"]
        todo += [B.case(c) for c in early]
        there = found.df.columns
        values = {g.rpartition(".")[2]: _named(B.column(g), there) for g in step.group_by}
        values |= {c.output: E.Col(None, c.output) for c in early if step.metrics and c.output not in values}
        keys = list(values)
        if step.metrics:
            todo.append(S.Aggregate(tuple(S.Key(k, v) for k, v in values.items()), tuple(self._metric(m, there) for m in step.metrics)))
        todo += [S.Derive(name, value) for name, value in step.expressions]
        todo += [B.case(c) for c in step.cases if c.phase != "pre_aggregate"]
        if not step.metrics and keys:
            extra = [n for n, _ in step.expressions] + [c.output for c in step.cases]
            todo.append(S.Project(tuple(S.Key(k, values.get(k) or E.Col(None, k)) for k in dict.fromkeys((*keys, *extra)))))
        df = found.df
        for t in todo:
            match t:
                case S.Filter():
                    df = df.filter(t.predicate.column(Scope(df)))
                case S.Derive():
                    df = df.withColumn(t.name, t.value.column(Scope(df)))
                case S.Aggregate():
                    df = aggregate(df, t)
                case S.Project():
                    scope = Scope(df)
                    df = df.select(*(k.value.column(scope).alias(k.name) for k in t.columns))
        return Result(df, (tuple(keys),) if step.metrics and keys else found.unique)

    def run(self) -> DataFrame:
        """The last step's rows with the specification's windows, ratios, projection, sort and limit. A result that two or
        more steps read is persisted; ``persisted`` lists those, for the caller to free."""
        steps = order(self.spec.steps)
        for s in steps:
            result = self.run_step(s)
            if sum(s.name in x.sources for x in steps) > 1:
                result.df = result.df.persist(StorageLevel.MEMORY_AND_DISK)
                self.persisted.append(result.df)
            self.results[s.name] = result
        df = self.results[steps[-1].name].df
        twice = {c.rpartition(MARK)[2] for c in df.columns if MARK in c}
        if asked := sorted(twice & {*self.spec.outputs, *(n for n, _ in self.spec.sort)}):
            raise SpecError("AMBIGUOUS_COLUMN", f"{asked} may be any of {sorted(c for c in df.columns if MARK in c)}")
        df = df.select(*(F.col(f"`{c}`") for c in df.columns if MARK not in c))
        rest: list = []
        for w in self.spec.windows:
            rest += B.window(w, self.spec.grain)
        rest += [S.Derive(r.name, E.Ratio(E.Col(None, r.top), E.Col(None, r.bottom), r.times)) for r in self.spec.ratios]
        rest.append(S.Project(tuple(S.Key(o, E.Col(None, o)) for o in self.spec.outputs)))
        if self.spec.sort:
            rest.append(S.Sort(tuple(S.Order(E.Col(None, n), asc) for n, asc in self.spec.sort)))
        if self.spec.limit is not None:
            rest.append(S.Limit(self.spec.limit))
        last = steps[-1].name
        out = lower(S.Plan((S.Named(last, last), *rest)), self.catalog, {last: df})
        return out


def split_cross_grain(grouped: DataFrame, total: DataFrame) -> DataFrame:
    """Every group beside the figures of all rows. ``total`` must be a global aggregation: one row by construction."""
    plan = total._jdf.queryExecution().optimizedPlan()
    most = plan.maxRows()
    if not most.isDefined() or int(most.get()) > 1:
        raise SpecError("CROSS", "the global side may have more than one row")
    return grouped.crossJoin(F.broadcast(total))


def informed(spec: Spec, catalog: Catalog) -> tuple[Spec, dict[str, TableMeta], list[Finding]]:
    """The specification with what the catalog knows of its tables where it declares nothing, the same by name with the types of the
    schema too, and what the two disagree on."""
    tables, by_name, findings = [], {}, []
    for t in spec.tables:
        meta, found = merge_facts(t.meta, catalog.meta.get(t.name))
        findings += [f for f in found if f.level == "reject"]
        tables.append(replace(t, meta=meta))
        if t.name in catalog.meta:
            schema = {f.name: f.dataType.simpleString() for f in catalog.read(t.name).schema.fields}
            by_name[t.name] = replace(meta, types=schema | {c: k for c, k in meta.types.items() if c in schema})
    return replace(spec, tables=tuple(tables)), by_name, findings


def gate(spec: Spec, catalog: Catalog, as_of: datetime.date | None = None, on_fanout: str = "error") -> list[Finding]:
    """Every check of a specification before anything runs: raises at the first that rejects, else returns the warnings.

    Types, join safety, grain and labels of the specification; the graph of its steps, or structure, frames and performance of its
    plan; windows; and tables against the catalog."""
    spec, tables, findings = informed(cross_grain(spec), catalog)
    findings += [*spec.warnings, *check_spec(spec, on_fanout)]
    if spec.steps:
        findings += check(spec)
        for w in spec.windows:
            findings += [f for x in B.window(w, spec.grain) if isinstance(x, S.Window) for f in check_window(x)]
        for step in spec.steps:
            for c in step.cases:
                findings += check_label(c, spec)
    else:
        plan = B.build(spec, as_of)
        findings += check_plan(plan, tables)
        findings += lint(plan, tables)
    return raise_if_rejected(findings)


def run(spec: Spec, catalog: Catalog, as_of: datetime.date | None = None, on_fanout: str = "error") -> DataFrame:
    """The rows of a specification with or without steps, once ``gate`` lets it pass. ``on_fanout`` is error, warn or allow: what a join
    on a key that is not declared unique means."""
    gate(spec, catalog, as_of, on_fanout)
    spec, _, _ = informed(cross_grain(spec), catalog)
    if spec.steps:
        return Runner(spec, catalog, as_of, on_fanout).run()
    return lower(B.build(spec, as_of), catalog)
