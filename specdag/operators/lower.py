"""Plans to DataFrames: one function for each kind of step. Nothing here runs a job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from specdag.errors import SpecError
from specdag.functions.expr import MARK, Scope
from specdag.plans import steps as S
from specdag.sources.catalog import Catalog

#: Fixed value: the most bytes, by Catalyst's own estimate, of a side that is broadcast on a plan's word.
SMALL = 64 << 20
_HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full"}


def lower(plan: S.Plan, catalog: Catalog, named: dict[str, DataFrame] | None = None) -> DataFrame:
    """The plan's result, its columns named as the plan's last projection or aggregation says."""
    named = named or {}
    df = None
    for step in plan.steps:
        match step:
            case S.Scan() | S.Subquery() | S.Named():
                if df is not None:
                    raise SpecError("PLAN", "a second source needs a join")
                df = source(step, catalog, named)
            case _ if df is None:
                raise SpecError("PLAN", "a plan begins with a source")
            case S.Filter():
                df = df.filter(step.predicate.column(Scope(df)))
            case S.Join():
                df = join(df, step, catalog, named)
            case S.Aggregate():
                df = aggregate(df, step)
            case S.Window():
                df = df.withColumn(step.name, window(step, Scope(df)))
            case S.Derive():
                df = df.withColumn(step.name, step.value.column(Scope(df)))
            case S.Project():
                scope = Scope(df)
                df = df.select(*(k.value.column(scope).alias(k.name) for k in step.columns))
            case S.Sort():
                scope = Scope(df)
                df = df.orderBy(*(order(o, scope) for o in step.by))
            case S.Limit():
                df = (df.offset(step.offset) if step.offset else df).limit(step.count)
            case _:
                raise SpecError("UNSUPPORTED", f"no step {type(step).__name__}")
    if df is None:
        raise SpecError("EMPTY", "the plan has no steps")
    return df


def source(step: S.Scan | S.Subquery | S.Named, catalog: Catalog, named: dict[str, DataFrame]) -> DataFrame:
    """A source's columns, each marked with the alias: no name clashes after any join, also with itself."""
    match step:
        case S.Scan():
            if not step.columns:
                raise SpecError("PERF-001", f"scan of {step.table} names no columns")
            df = catalog.read(step.table)
            if missing := [c for c in step.columns if c not in df.columns]:
                raise SpecError("COL", f"{step.table} has no {missing}")
            df = df.select(*(F.col(f"`{c}`").alias(f"{step.alias}{MARK}{c}") for c in step.columns))
            return df.filter(step.where.column(Scope(df))) if step.where else df
        case S.Subquery():
            df = lower(step.plan, catalog, named)
        case S.Named():
            if step.name not in named:
                raise SpecError("DAG", f"no result {step.name}")
            df = named[step.name]
    return df.select(*(F.col(f"`{c}`").alias(f"{step.alias}{MARK}{c.rpartition(MARK)[2]}") for c in df.columns))


def join(left: DataFrame, step: S.Join, catalog: Catalog, named: dict[str, DataFrame]) -> DataFrame:
    right = source(step.right, catalog, named)
    if step.pre_filter is not None:
        right = right.filter(step.pre_filter.column(Scope(right)))
    if step.how == "cross":
        return left.crossJoin(right)
    if step.how not in _HOW:
        raise SpecError("JOIN", f"no join {step.how}")
    if not step.keys:
        raise SpecError("JOIN", f"a {step.how} join needs keys; a product must be asked for as cross")
    ls, rs = Scope(left), Scope(right)

    def side(c: Column, key: S.JoinKey) -> Column:
        return F.upper(c) if key.normalize == "upper" else c

    on = reduce(lambda a, b: a & b, (side(k.left.column(ls), k) == side(k.right.column(rs), k) for k in step.keys))
    if step.small and int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL:
        right = F.broadcast(right)
    return left.join(right, on, _HOW[step.how])


def metric(m: S.Metric, scope: Scope) -> Column:
    value = m.input.column(scope) if m.input is not None else None
    where = m.where.column(scope) if m.where is not None else None
    func = m.func.upper()
    if value is None:
        if func != "COUNT" or m.distinct:
            raise SpecError("AGG", f"{m.func} of {m.name} needs an input")
        return F.count(F.lit(1)) if where is None else F.count(F.when(where, F.lit(1)))
    kept = value if where is None else F.when(where, value)

    def number() -> Column:
        boolean = isinstance(m.input, S.E.Col) and isinstance(scope.type(m.input.table, m.input.name), T.BooleanType)
        return kept.cast("int") if boolean else kept

    distinct = m.distinct or func == "COUNT_DISTINCT"
    match func:
        case "COUNT" | "COUNT_DISTINCT":
            return F.count_distinct(kept) if distinct else F.count(kept)
        case "SUM":
            return F.sum_distinct(number()) if distinct else F.sum(number())
        case "AVG":
            return F.sum_distinct(number().cast("double")) / F.nullif(F.count_distinct(kept), F.lit(0)) if distinct else F.avg(number().cast("double"))
        case "MIN":
            return F.min(kept)
        case "MAX":
            return F.max(kept)
    raise SpecError("AGG", f"no aggregation {m.func}; there are COUNT, COUNT_DISTINCT, SUM, AVG, MIN and MAX")


def aggregate(df: DataFrame, step: S.Aggregate) -> DataFrame:
    """Group keys are columns before the grouping; HAVING is a filter behind it."""
    scope = Scope(df)
    keys = [k.value.column(scope).alias(k.name) for k in step.keys]
    sums = [metric(m, scope).alias(m.name) for m in step.metrics]
    if not sums:
        out = df.select(*keys).distinct()
    else:
        out = df.groupBy(*keys).agg(*sums) if keys else df.agg(*sums)
    return out.filter(step.having.column(Scope(out))) if step.having is not None else out


def order(o: S.Order, scope: Scope) -> Column:
    c = o.value.column(scope)
    if o.ascending:
        return c.asc_nulls_first() if o.nulls_first else c.asc_nulls_last()
    return c.desc_nulls_first() if o.nulls_first else c.desc_nulls_last()


def _bound(value: int | str, first: bool) -> int:
    if value == "unbounded":
        return W.unboundedPreceding if first else W.unboundedFollowing
    return W.currentRow if value == "current" else int(value)


def window(step: S.Window, scope: Scope) -> Column:
    spec = W.partitionBy(*(p.column(scope) for p in step.partition)) if step.partition else W.partitionBy()
    if step.order:
        spec = spec.orderBy(*(order(o, scope) for o in step.order))
    if step.frame:
        bounds = _bound(step.frame.start, True), _bound(step.frame.end, False)
        spec = spec.rowsBetween(*bounds) if step.frame.kind == "rows" else spec.rangeBetween(*bounds)
    value = step.input.column(scope) if step.input is not None else None
    match step.func.upper():
        case "ROW_NUMBER":
            return F.row_number().over(spec).cast("bigint")
        case "RANK":
            return F.rank().over(spec).cast("bigint")
        case "DENSE_RANK":
            return F.dense_rank().over(spec).cast("bigint")
        case "NTILE":
            if not step.buckets or step.buckets < 1:
                raise SpecError("WINDOW", f"NTILE of {step.name} needs a positive number")
            return F.ntile(step.buckets).over(spec).cast("bigint")
        case "LAG":
            return F.lag(value).over(spec)
        case "LEAD":
            return F.lead(value).over(spec)
        case "SUM_OVER" | "SUM":
            return F.sum(value).over(spec)
        case "AVG_OVER" | "AVG":
            return F.avg(value.cast("double")).over(spec)
        case "COUNT_OVER" | "COUNT":
            return F.count(F.lit(1) if value is None else value).over(spec)
    raise SpecError("WINDOW", f"no window function {step.func}")
