"""Driver queries of the engine, one or more for each of its operators, and the SQL that says the same."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specdag.errors import SpecError
from specdag.functions import calendar
from specdag.functions.expr import And, Arith, Between, Case, Cmp, Col, Hour, In, IsNull, Like, Lit, Not, NullIfZero, Or, Ratio, parse_predicate, parse_value
from specdag.functions.profile import STATUS_WORDS, profile
from specdag.operators.lower import lower
from specdag.plans import program
from specdag.plans.spec import parse
from specdag.plans.steps import Aggregate, Derive, Filter, Frame, Join, JoinKey, Key, Limit, Metric, Named, Order, Plan, Project, Scan, Sort, Subquery, Window
from specdag.plans.validate import join_evidence
from specdag.sources import snapshot, writeplan
from specdag.sources.catalog import Catalog, ForeignKey, TableMeta
from specdag.sources.scratch import scratch
from specdag.verify.compare import compare, diff
from specdag.verify.digest import digest
from specdag.verify.equivalence import equivalent
from specdag.verify.summary import anomalies, samples, summary

TABLES = {
    "region": TableMeta("region", "dim", (("r_regionkey",),)),
    "nation": TableMeta("nation", "dim", (("n_nationkey",),), (ForeignKey("n_regionkey", "region", "r_regionkey"),)),
    "customer": TableMeta("customer", "dim", (("c_custkey",),), (ForeignKey("c_nationkey", "nation", "n_nationkey"),)),
    "supplier": TableMeta("supplier", "dim", (("s_suppkey",),)),
    "part": TableMeta("part", "dim", (("p_partkey",),)),
    "orders": TableMeta("orders", "fact", (("o_orderkey",),), time_column="o_orderdate"),
    "lineitem": TableMeta("lineitem", "fact", time_column="l_shipdate"),
    "events": TableMeta("events", "fact", (("event_id",),), time_column="ts"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog.of_folder(spark, sf_dir, TABLES)


def query(name: str, plan: Plan | tuple, sql: str | None, rounded: dict[str, int] | None = None) -> None:
    """Register a plan; ``rounded`` fixes the places of doubles whose last digits depend on the order of addition."""
    steps = plan if isinstance(plan, Plan) else Plan(tuple(plan))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = lower(steps, catalog(spark, sf_dir))
        return df.withColumns({c: F.round(c, n) for c, n in (rounded or {}).items()})

    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def program_query(name: str, spec: dict, sql: str, rounded: dict[str, int] | None = None, as_of: datetime.date | None = None) -> None:
    parsed = parse(spec)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = program.run(parsed, catalog(spark, sf_dir), as_of)
        return df.withColumns({c: F.round(c, n) for c, n in (rounded or {}).items()})

    QUERIES[name] = run
    ORACLES[name] = sql


def frame_query(name: str, sql: str | None = None) -> Callable:
    def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def c(ref: str) -> Col:
    table, _, name = ref.rpartition(".")
    return Col(table or None, name)


def keys(*refs: str) -> tuple[Key, ...]:
    return tuple(Key(r.rpartition(".")[2], c(r)) for r in refs)


def on(*pairs: tuple[str, str]) -> tuple[JoinKey, ...]:
    return tuple(JoinKey(c(a), c(b)) for a, b in pairs)


def by(*refs: str) -> tuple[Order, ...]:
    return tuple(Order(c(r.lstrip("-")), not r.startswith("-")) for r in refs)


L = Scan("lineitem", "l", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
O = Scan("orders", "o", ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))
C = Scan("customer", "c", ("c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal"))
N = Scan("nation", "n", ("n_nationkey", "n_name", "n_regionkey"))
R = Scan("region", "r", ("r_regionkey", "r_name"))
P = Scan("part", "p", ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"))
S = Scan("supplier", "s", ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"))
E = Scan("events", "e", ("event_id", "user_id", "ts", "event_type", "value"))


def narrow(scan: Scan, *columns: str) -> Scan:
    return Scan(scan.table, scan.alias, columns, scan.where)


# --- the flagship ------------------------------------------------------------

FLAGSHIP = Plan(
    (
        narrow(C, "c_custkey", "c_mktsegment"),
        Join(narrow(O, "o_orderkey", "o_custkey", "o_orderdate"), "inner", on(("c.c_custkey", "o.o_custkey"))),
        Join(narrow(L, "l_orderkey", "l_extendedprice", "l_discount"), "inner", on(("o.o_orderkey", "l.l_orderkey"))),
        Filter(calendar.fixed(c("o.o_orderdate"), "1995-01-01", "1996-12-31")),
        Aggregate(keys("c.c_mktsegment"), (Metric("revenue", "SUM", parse_value("l.l_extendedprice * (1 - l.l_discount)")), Metric("lines", "COUNT"))),
        Sort(by("-revenue")),
    )
)
query(
    "flagship",
    FLAGSHIP,
    """SELECT c_mktsegment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM customer JOIN orders ON c_custkey = o_custkey
    JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY 1""",
    {"revenue": 2},
)

# --- scans, projections, filters ---------------------------------------------

_o = narrow(O, "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
_okeys = keys("o.o_orderkey", "o.o_totalprice")
query("scan_project", (_o, Project((Key("order_id", c("o.o_orderkey")), Key("price", c("o.o_totalprice"))))), "SELECT o_orderkey AS order_id, o_totalprice AS price FROM orders")
query("scan_where", (Scan("orders", "o", ("o_orderkey", "o_totalprice"), Cmp(">", c("o.o_totalprice"), Lit(300000.0))), Project(_okeys)), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
query("filter_cmp", (_o, Filter(And((Cmp(">=", c("o.o_totalprice"), Lit(1000.0)), Cmp("<", c("o.o_totalprice"), Lit(200000.0)), Cmp("!=", c("o.o_orderstatus"), Lit("F"))))), Project(_okeys)), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 200000 AND o_orderstatus <> 'F'")
query("filter_in", (_o, Filter(In(c("o.o_orderstatus"), ("O", "P"))), Project(_okeys)), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P')")
query("filter_not_in", (_o, Filter(In(c("o.o_orderstatus"), ("O", "P"), True)), Project(_okeys)), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus NOT IN ('O', 'P')")
query("filter_between", (_o, Filter(Between(c("o.o_totalprice"), Lit(100000.0), Lit(150000.0))), Project(_okeys)), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000")
query("filter_like", (narrow(P, "p_partkey", "p_name"), Filter(Like(c("p.p_name"), "%red%")), Project(keys("p.p_partkey", "p.p_name"))), "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%red%'")
query(
    "filter_nested",
    (_o, Filter(Or((And((Cmp("=", c("o.o_orderstatus"), Lit("F")), Cmp(">", c("o.o_totalprice"), Lit(250000.0)))), Not(Or((Cmp("<", c("o.o_custkey"), Lit(1000)), Cmp("=", c("o.o_orderstatus"), Lit("O")))))))), Project(_okeys)),
    "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 250000) OR NOT (o_custkey < 1000 OR o_orderstatus = 'O')",
)
_left = (narrow(C, "c_custkey"), Join(narrow(O, "o_orderkey", "o_custkey", "o_totalprice"), "left", on(("c.c_custkey", "o.o_custkey")), pre_filter=Cmp(">", c("o.o_totalprice"), Lit(400000.0))))
query("filter_null", (*_left, Filter(IsNull(c("o.o_orderkey"))), Project(keys("c.c_custkey"))), "SELECT c_custkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
query("filter_not_null", (*_left, Filter(IsNull(c("o.o_orderkey"), True)), Project(keys("c.c_custkey", "o.o_orderkey"))), "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 400000")
query("filter_col_col", (narrow(L, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), Filter(Cmp("<", c("l.l_partkey"), c("l.l_suppkey"))), Project(keys("l.l_orderkey", "l.l_linenumber"))), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey")
query("filter_typed_literal", (narrow(O, "o_orderkey", "o_orderdate"), Filter(Cmp(">=", c("o.o_orderdate"), Lit("1997-06-01"))), Project(keys("o.o_orderkey"))), "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01'")
query("filter_parsed", (_o, Filter(parse_predicate("o.o_totalprice >= 250000 OR (o.o_custkey < 100 AND NOT o.o_orderstatus = 'F')")), Project(_okeys)), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 250000 OR (o_custkey < 100 AND NOT o_orderstatus = 'F')")
query(
    "project_arithmetic",
    (narrow(L, "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax"), Project((*keys("l.l_orderkey", "l.l_linenumber"), Key("x", parse_value("(l_extendedprice + l_quantity * 2) / NULLIF(l_quantity - 1, 0) - l_tax"))))),
    "SELECT l_orderkey, l_linenumber, (l_extendedprice + l_quantity * 2) / NULLIF(l_quantity - 1, 0) - l_tax AS x FROM lineitem",
)
query("project_division_by_zero", (narrow(L, "l_orderkey", "l_linenumber", "l_quantity", "l_discount"), Project((*keys("l.l_orderkey", "l.l_linenumber"), Key("x", Arith("/", c("l.l_quantity"), c("l.l_discount")))))), "SELECT l_orderkey, l_linenumber, l_quantity / NULLIF(l_discount, 0) AS x FROM lineitem")
query("project_nullif", (narrow(L, "l_orderkey", "l_linenumber", "l_discount"), Project((*keys("l.l_orderkey", "l.l_linenumber"), Key("d", NullIfZero(c("l.l_discount")))))), "SELECT l_orderkey, l_linenumber, NULLIF(l_discount, 0) AS d FROM lineitem")
query("project_hour", (narrow(E, "event_id", "ts"), Project((Key("event_id", c("e.event_id")), Key("h", Hour(c("e.ts")))))), "SELECT event_id, hour(ts) AS h FROM events")

# --- joins -------------------------------------------------------------------

_ck = on(("c.c_custkey", "o.o_custkey"))
_c, _oo = narrow(C, "c_custkey", "c_name"), narrow(O, "o_orderkey", "o_custkey", "o_totalprice")
_odd = Scan("orders", "o", ("o_orderkey", "o_custkey", "o_totalprice"), Cmp(">", c("o.o_totalprice"), Lit(200000.0)))
_rich = Scan("customer", "c", ("c_custkey", "c_name", "c_acctbal"), Cmp(">", c("c.c_acctbal"), Lit(5000.0)))
_out = Project(keys("c.c_custkey", "c.c_name", "o.o_orderkey"))
query("join_inner", (_c, Join(_oo, "inner", _ck), _out), "SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
for _how in ("left", "right", "full"):
    query(f"join_{_how}", (_rich, Join(_odd, _how, _ck), _out), f"SELECT c_custkey, c_name, o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) {_how.upper()} JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey")
query("join_cross", (R, Join(N, "cross"), Project(keys("r.r_name", "n.n_name"))), "SELECT r_name, n_name FROM region CROSS JOIN nation")
query(
    "join_self",
    (narrow(N, "n_nationkey", "n_name", "n_regionkey"), Join(Scan("nation", "m", ("n_nationkey", "n_name", "n_regionkey")), "inner", on(("n.n_regionkey", "m.n_regionkey"))), Filter(Cmp("<", c("n.n_nationkey"), c("m.n_nationkey"))), Project((Key("a", c("n.n_name")), Key("b", c("m.n_name"))))),
    "SELECT n.n_name AS a, m.n_name AS b FROM nation n JOIN nation m ON n.n_regionkey = m.n_regionkey WHERE n.n_nationkey < m.n_nationkey",
)
query(
    "join_multikey",
    (narrow(L, "l_orderkey", "l_linenumber", "l_quantity"), Join(Scan("lineitem", "k", ("l_orderkey", "l_linenumber", "l_tax")), "inner", on(("l.l_orderkey", "k.l_orderkey"), ("l.l_linenumber", "k.l_linenumber"))), Aggregate((), (Metric("pairs", "COUNT"), Metric("quantity", "SUM", c("l.l_quantity"))))),
    "SELECT count(*) AS pairs, sum(l.l_quantity) AS quantity FROM lineitem l JOIN lineitem k ON l.l_orderkey = k.l_orderkey AND l.l_linenumber = k.l_linenumber",
)
query("join_ci", (narrow(C, "c_custkey", "c_mktsegment"), Join(Subquery(Plan((narrow(C, "c_mktsegment"), Aggregate(keys("c.c_mktsegment"), (Metric("n", "COUNT"),)))), "q"), "inner", (JoinKey(c("c.c_mktsegment"), c("q.c_mktsegment"), "upper"),)), Project(keys("c.c_custkey", "q.n"))), "SELECT c_custkey, n FROM customer c JOIN (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) q ON upper(c.c_mktsegment) = upper(q.c_mktsegment)")
query("join_left_where", (_c, Join(_oo, "left", _ck), Filter(Cmp(">", c("o.o_totalprice"), Lit(300000.0))), _out), "SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000")
query("join_left_prejoin", (_c, Join(_oo, "left", _ck, pre_filter=Cmp(">", c("o.o_totalprice"), Lit(300000.0))), _out), "SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")
query(
    "chain_3hop",
    (_oo, Join(narrow(C, "c_custkey", "c_nationkey"), "inner", on(("o.o_custkey", "c.c_custkey"))), Join(N, "inner", on(("c.c_nationkey", "n.n_nationkey")), small=True), Join(R, "inner", on(("n.n_regionkey", "r.r_regionkey")), small=True), Aggregate(keys("r.r_name"), (Metric("orders", "COUNT"), Metric("total", "SUM", c("o.o_totalprice"))))),
    "SELECT r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    {"total": 2},
)

# --- aggregation -------------------------------------------------------------

_ls = narrow(L, "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_partkey")
_flags = keys("l.l_returnflag", "l.l_linestatus")
query(
    "agg_basic",
    (_ls, Aggregate(_flags, (Metric("n", "COUNT"), Metric("n_q", "COUNT", c("l.l_quantity")), Metric("sum_q", "SUM", c("l.l_quantity")), Metric("avg_q", "AVG", c("l.l_quantity")), Metric("min_p", "MIN", c("l.l_extendedprice")), Metric("max_p", "MAX", c("l.l_extendedprice"))))),
    "SELECT l_returnflag, l_linestatus, count(*) AS n, count(l_quantity) AS n_q, sum(l_quantity) AS sum_q, round(avg(l_quantity), 6) AS avg_q, min(l_extendedprice) AS min_p, max(l_extendedprice) AS max_p FROM lineitem GROUP BY 1, 2",
    {"avg_q": 6},
)
query("agg_distinct", (_ls, Aggregate(_flags, (Metric("orders", "COUNT_DISTINCT", c("l.l_orderkey")), Metric("parts", "COUNT", c("l.l_partkey"), True)))), "SELECT l_returnflag, l_linestatus, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1, 2")
query("agg_sum_distinct", (_ls, Aggregate(_flags, (Metric("s", "SUM", c("l.l_quantity"), True), Metric("a", "AVG", c("l.l_quantity"), True)))), "SELECT l_returnflag, l_linestatus, sum(DISTINCT l_quantity) AS s, round(avg(DISTINCT l_quantity), 6) AS a FROM lineitem GROUP BY 1, 2", {"a": 6})
_returned = Cmp("=", c("l.l_returnflag"), Lit("R"))
query(
    "agg_filter",
    (_ls, Aggregate(keys("l.l_linestatus"), (Metric("n", "COUNT", where=_returned), Metric("q", "SUM", c("l.l_quantity"), where=_returned), Metric("big", "COUNT", c("l.l_orderkey"), where=Cmp(">", c("l.l_quantity"), Lit(40.0)))))),
    "SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'R') AS n, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS q, count(l_orderkey) FILTER (WHERE l_quantity > 40) AS big FROM lineitem GROUP BY 1",
)
query("agg_expression", (_ls, Aggregate(_flags, (Metric("revenue", "SUM", parse_value("l_extendedprice * (1 - l_discount)")), Metric("m", "MAX", parse_value("l_quantity % 7"))))), "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, max(l_quantity % 7) AS m FROM lineitem GROUP BY 1, 2", {"revenue": 2})
query("agg_global", (_ls, Aggregate((), (Metric("n", "COUNT"), Metric("q", "SUM", c("l.l_quantity")), Metric("o", "COUNT_DISTINCT", c("l.l_orderkey"))))), "SELECT count(*) AS n, sum(l_quantity) AS q, count(DISTINCT l_orderkey) AS o FROM lineitem")
_large = Case(((Cmp(">", c("l.l_quantity"), Lit(25.0)), Lit(1)),), Lit(0))
query("agg_case_inside", (_ls, Derive("large", _large), Aggregate(keys("l.l_returnflag"), (Metric("large_lines", "SUM", c("large")),))), "SELECT l_returnflag, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS large_lines FROM lineitem GROUP BY 1")
query("agg_bool_sum", (_ls, Derive("big", Cmp(">", c("l.l_quantity"), Lit(25.0))), Aggregate(keys("l.l_returnflag"), (Metric("n", "SUM", c("big")),))), "SELECT l_returnflag, CAST(sum(CAST(l_quantity > 25 AS INT)) AS BIGINT) AS n FROM lineitem GROUP BY 1")
query("having", (narrow(O, "o_custkey"), Aggregate(keys("o.o_custkey"), (Metric("n", "COUNT"),), Cmp(">=", c("n"), Lit(15)))), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
query("agg_keys_only", (narrow(O, "o_orderstatus", "o_orderpriority"), Aggregate(keys("o.o_orderstatus", "o.o_orderpriority"), ())), "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
query("agg_null_group", (*_left, Aggregate(keys("o.o_orderkey"), (Metric("n", "COUNT"), Metric("k", "COUNT", c("o.o_orderkey"))))), "SELECT o_orderkey, count(*) AS n, count(o_orderkey) AS k FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o_custkey GROUP BY 1")

# --- time --------------------------------------------------------------------

query("hour_group", (narrow(E, "ts", "value"), Derive("h", Hour(c("e.ts"))), Aggregate(keys("h"), (Metric("n", "COUNT"), Metric("v", "SUM", c("e.value"))))), "SELECT hour(ts) AS h, count(*) AS n, round(sum(value), 2) AS v FROM events GROUP BY 1", {"v": 2})
_od = narrow(O, "o_orderkey", "o_orderdate")
AS_OF = datetime.date(1998, 7, 20)
for _name, _range, _where in (
    ("time_fixed", calendar.fixed(c("o.o_orderdate"), "1996-02-01", "1996-02-29"), "o_orderdate >= '1996-02-01' AND o_orderdate < '1996-03-01'"),
    ("time_fixed_exclusive", calendar.fixed(c("o.o_orderdate"), "1996-02-01", "1996-02-29", False), "o_orderdate >= '1996-02-01' AND o_orderdate < '1996-02-29'"),
    ("time_fiscal_jul", calendar.fiscal(c("o.o_orderdate"), "fiscal_jul", 1996), "o_orderdate >= '1996-07-01' AND o_orderdate < '1997-07-01'"),
    ("time_fiscal_apr", calendar.fiscal(c("o.o_orderdate"), "fiscal_apr", 1996), "o_orderdate >= '1996-04-01' AND o_orderdate < '1997-04-01'"),
    ("time_last_n", calendar.relative(c("o.o_orderdate"), "last_90d", AS_OF), "o_orderdate >= DATE '1998-07-20' - 90"),
    ("time_mtd", calendar.relative(c("o.o_orderdate"), "mtd", AS_OF), "o_orderdate >= '1998-07-01'"),
    ("time_ytd", calendar.relative(c("o.o_orderdate"), "ytd", AS_OF), "o_orderdate >= '1998-01-01'"),
):
    query(_name, (_od, Filter(_range), Project(keys("o.o_orderkey"))), f"SELECT o_orderkey FROM orders WHERE {_where}")

# --- windows -----------------------------------------------------------------

_w = narrow(O, "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
_part = (c("o.o_custkey"),)
_wout = lambda name: Project((*keys("o.o_orderkey"), Key(name, c(name))))
_price = by("-o.o_totalprice", "o.o_orderkey")
for _name, _win, _sql in (
    ("win_row_number", Window("w", "ROW_NUMBER", partition=_part, order=_price), "row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)"),
    ("win_rank", Window("w", "RANK", partition=_part, order=by("o.o_orderpriority")), "rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)"),
    ("win_dense_rank", Window("w", "DENSE_RANK", partition=_part, order=by("o.o_orderpriority")), "dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)"),
    ("win_ntile", Window("w", "NTILE", buckets=4, partition=_part, order=_price), "ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)"),
    ("win_lag", Window("w", "LAG", c("o.o_totalprice"), partition=_part, order=_price), "lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)"),
    ("win_lead", Window("w", "LEAD", c("o.o_totalprice"), partition=_part, order=_price), "lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)"),
    ("win_count", Window("w", "COUNT_OVER", partition=_part), "count(*) OVER (PARTITION BY o_custkey)"),
    ("win_count_col", Window("w", "COUNT_OVER", c("o.o_totalprice"), partition=_part, order=by("o.o_orderpriority")), "count(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)"),
):
    query(_name, (_w, _win, _wout("w")), f"SELECT o_orderkey, {_sql} AS w FROM orders")
for _name, _win, _sql in (
    ("win_sum_all", Window("w", "SUM_OVER", c("o.o_totalprice"), partition=_part), "sum(o_totalprice) OVER (PARTITION BY o_custkey)"),
    ("win_sum_range", Window("w", "SUM_OVER", c("o.o_totalprice"), partition=_part, order=by("o.o_orderpriority")), "sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)"),
    ("win_sum_rows", Window("w", "SUM_OVER", c("o.o_totalprice"), partition=_part, order=_price, frame=Frame("rows", "unbounded", "current")), "sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING)"),
    ("win_avg", Window("w", "AVG_OVER", c("o.o_totalprice"), partition=_part, order=_price, frame=Frame("rows", -2, 1)), "avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)"),
    ("win_range_frame", Window("w", "SUM", c("o.o_totalprice"), partition=_part, order=by("o.o_orderpriority"), frame=Frame("range", "current", "unbounded")), "sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"),
):
    query(_name, (_w, _win, _wout("w")), f"SELECT o_orderkey, round({_sql}, 4) AS w FROM orders", {"w": 4})
query("win_topn", (_w, Window("w", "ROW_NUMBER", partition=_part, order=_price), Filter(Cmp("<=", c("w"), Lit(3))), _wout("w")), "SELECT o_orderkey, w FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS w FROM orders) WHERE w <= 3")
query(
    "win_nulls_last",
    (narrow(C, "c_custkey", "c_nationkey"), Join(_odd, "left", _ck), Window("w", "ROW_NUMBER", partition=(c("c.c_nationkey"),), order=by("o.o_totalprice", "c.c_custkey", "o.o_orderkey")), Project((*keys("c.c_custkey", "o.o_orderkey"), Key("w", c("w"))))),
    "SELECT c_custkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_totalprice NULLS LAST, c_custkey, o_orderkey NULLS LAST) AS w FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey",
)
query(
    "win_over_aggregate",
    (narrow(C, "c_custkey", "c_nationkey", "c_acctbal"), Aggregate(keys("c.c_nationkey"), (Metric("n", "COUNT"),)), Window("r", "RANK", order=by("-n")), Window("total", "SUM_OVER", c("n")), Project(keys("c_nationkey", "n", "r", "total"))),
    "SELECT c_nationkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM customer GROUP BY 1",
)

# --- CASE and ratios ---------------------------------------------------------

_qty = narrow(L, "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_extendedprice")
_size = Case(((Cmp("<", c("l.l_quantity"), Lit(10.0)), Lit("small")), (Cmp("<", c("l.l_quantity"), Lit(30.0)), Lit("medium"))), Lit("large"))
_size_sql = "CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END"
_line = keys("l.l_orderkey", "l.l_linenumber")
query("case_simple", (_qty, Derive("size", _size), Project((*_line, Key("size", c("size"))))), f"SELECT l_orderkey, l_linenumber, {_size_sql} AS size FROM lineitem")
query(
    "case_nested",
    (_qty, Derive("k", Case(((Or((And((Cmp(">", c("l.l_quantity"), Lit(20.0)), In(c("l.l_returnflag"), ("A", "R")))), Like(c("l.l_returnflag"), "N%"))), Lit("x")), (Not(Between(c("l.l_discount"), Lit(0.02), Lit(0.05))), Lit("y"))))), Project((*_line, Key("k", c("k"))))),
    "SELECT l_orderkey, l_linenumber, CASE WHEN (l_quantity > 20 AND l_returnflag IN ('A', 'R')) OR l_returnflag LIKE 'N%' THEN 'x' WHEN NOT l_discount BETWEEN 0.02 AND 0.05 THEN 'y' END AS k FROM lineitem",
)
query("case_pre_agg", (_qty, Derive("size", _size), Aggregate(keys("size"), (Metric("n", "COUNT"), Metric("q", "SUM", c("l.l_quantity"))))), f"SELECT {_size_sql} AS size, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1")
query(
    "case_post_agg",
    (narrow(O, "o_custkey", "o_totalprice"), Aggregate(keys("o.o_custkey"), (Metric("n", "COUNT"),)), Derive("level", Case(((Cmp(">=", c("n"), Lit(15)), Lit("gold")), (Cmp(">=", c("n"), Lit(8)), Lit("silver"))), Lit("plain")))),
    "SELECT o_custkey, count(*) AS n, CASE WHEN count(*) >= 15 THEN 'gold' WHEN count(*) >= 8 THEN 'silver' ELSE 'plain' END AS level FROM orders GROUP BY 1",
)
query("case_column_result", (_qty, Derive("x", Case(((Cmp(">", c("l.l_quantity"), Lit(25.0)), c("l.l_quantity")),), c("l.l_discount"))), Project((*_line, Key("x", c("x"))))), "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN l_quantity ELSE l_discount END AS x FROM lineitem")
query("case_hour", (narrow(E, "event_id", "ts"), Derive("shift", Case(((And((Cmp(">=", Hour(c("e.ts")), Lit(8)), Cmp("<", Hour(c("e.ts")), Lit(20)))), Lit("day")),), Lit("night"))), Project((Key("event_id", c("e.event_id")), Key("shift", c("shift"))))), "SELECT event_id, CASE WHEN hour(ts) >= 8 AND hour(ts) < 20 THEN 'day' ELSE 'night' END AS shift FROM events")
_sums = Aggregate(keys("l.l_returnflag"), (Metric("p", "SUM", c("l.l_extendedprice")), Metric("q", "SUM", c("l.l_quantity")), Metric("z", "COUNT", where=Cmp("<", c("l.l_quantity"), Lit(0.0)))))
query("ratio", (_qty, _sums, Derive("x", Ratio(c("p"), c("q"))), Project(keys("l_returnflag", "x"))), "SELECT l_returnflag, round(sum(l_extendedprice) / sum(l_quantity), 6) AS x FROM lineitem GROUP BY 1", {"x": 6})
query("ratio_pct", (_qty, _sums, Derive("x", Ratio(c("q"), c("p"), 100)), Project(keys("l_returnflag", "x"))), "SELECT l_returnflag, round(sum(l_quantity) / sum(l_extendedprice) * 100, 6) AS x FROM lineitem GROUP BY 1", {"x": 6})
query("ratio_zero", (_qty, _sums, Derive("x", Ratio(c("p"), c("z"))), Project(keys("l_returnflag", "x"))), "SELECT l_returnflag, CAST(NULL AS DOUBLE) AS x FROM lineitem GROUP BY 1")
query(
    "ratio_window",
    (_qty, _sums, Window("whole", "SUM_OVER", c("q")), Derive("share", Ratio(c("q"), c("whole"), 100)), Project(keys("l_returnflag", "share"))),
    "SELECT l_returnflag, round(q / sum(q) OVER () * 100, 6) AS share FROM (SELECT l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY 1)",
    {"share": 6},
)

# --- sort, limit, subqueries -------------------------------------------------

query(
    "sort_nulls_last",
    (narrow(C, "c_custkey"), Join(_odd, "left", _ck), Project(keys("c.c_custkey", "o.o_orderkey", "o.o_totalprice")), Sort(by("o_totalprice", "c_custkey", "o_orderkey")), Limit(50)),
    "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey ORDER BY o_totalprice NULLS LAST, c_custkey, o_orderkey NULLS LAST LIMIT 50",
)
query(
    "sort_nulls_first",
    (narrow(C, "c_custkey"), Join(_odd, "left", _ck), Project(keys("c.c_custkey", "o.o_orderkey")), Sort((Order(c("o_orderkey"), True, True), Order(c("c_custkey")))), Limit(40)),
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey ORDER BY o_orderkey NULLS FIRST, c_custkey LIMIT 40",
)
query("sort_limit", (_o, Project(_okeys), Sort(by("-o_totalprice", "o_orderkey")), Limit(25)), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
query("sort_offset", (_o, Project(_okeys), Sort(by("-o_totalprice", "o_orderkey")), Limit(10, 15)), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 15")
query("sort_multi", (narrow(C, "c_mktsegment", "c_acctbal", "c_custkey"), Project(keys("c.c_mktsegment", "c.c_acctbal", "c.c_custkey")), Sort(by("c_mktsegment", "-c_acctbal", "c_custkey"))), "SELECT c_mktsegment, c_acctbal, c_custkey FROM customer ORDER BY 1, 2 DESC, 3")
query(
    "subquery_agg",
    (Subquery(Plan((narrow(O, "o_custkey", "o_totalprice"), Aggregate(keys("o.o_custkey"), (Metric("n", "COUNT"),)))), "q"), Filter(Cmp(">", c("q.n"), Lit(5))), Aggregate(keys("q.n"), (Metric("customers", "COUNT"),))),
    "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) WHERE n > 5 GROUP BY 1",
)

# --- specifications and programs ---------------------------------------------

_t = {
    "orders": {"name": "orders", "alias": "o", "role": "fact", "columns": ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate", "o_orderpriority"], "unique_keys": ["o_orderkey"]},
    "lineitem": {"name": "lineitem", "alias": "l", "role": "fact", "columns": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]},
    "customer": {"name": "customer", "alias": "c", "role": "dim", "columns": ["c_custkey", "c_name", "c_mktsegment", "c_nationkey", "c_acctbal"], "unique_keys": ["c_custkey"]},
    "nation": {"name": "nation", "alias": "n", "role": "dim", "columns": ["n_nationkey", "n_name", "n_regionkey"], "unique_keys": ["n_nationkey"]},
    "region": {"name": "region", "alias": "r", "role": "dim", "columns": ["r_regionkey", "r_name"], "unique_keys": ["r_regionkey"]},
}
program_query(
    "spec_single",
    {"source_tables": [_t["orders"]], "metrics": [{"metric_name": "n", "aggregation": "COUNT"}, {"metric_name": "total", "aggregation": "SUM", "input_column": "o.o_totalprice"}], "dimensions": [{"dimension_name": "status", "column_ref": "o.o_orderstatus"}], "time_range": {"column_ref": "o.o_orderdate", "start": "1996-01-01", "end": "1996-12-31"}, "output_columns": ["status", "n", "total"], "sort": [{"column": "total", "direction": "DESC"}]},
    "SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01' GROUP BY 1",
    {"total": 2},
)
program_query(
    "agg_variants",
    {"source_tables": [_t["orders"]], "metrics": [{"metric_name": "n", "aggregation": "COUNT", "variants": [{"alias": "n_open", "filter": {"column_ref": "o.o_orderstatus", "operator": "eq", "value": "O"}}, {"alias": "n_large", "filter": {"column_ref": "o.o_totalprice", "operator": "gte", "value": 250000}}]}], "dimensions": [{"column_ref": "o.o_orderpriority"}], "output_columns": ["o_orderpriority", "n", "n_open", "n_large"]},
    "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(*) FILTER (WHERE o_totalprice >= 250000) AS n_large FROM orders GROUP BY 1",
)
program_query(
    "spec_two_tables",
    {"source_tables": [_t["orders"], _t["customer"]], "joins": [{"left_table": "o", "right_table": "c", "left_key": "o_custkey", "right_key": "c_custkey", "join_type": "LEFT"}], "metrics": [{"metric_name": "n", "aggregation": "COUNT"}], "dimensions": [{"column_ref": "c.c_mktsegment"}, {"column_ref": "o.o_orderstatus"}], "windows": [{"name": "place", "function": "ROW_NUMBER", "partition_by": ["c_mktsegment"], "order_by": [{"column": "n", "direction": "DESC"}], "keep_at_most": 2}], "target_grain": ["c_mktsegment", "o_orderstatus"], "output_columns": ["c_mktsegment", "o_orderstatus", "n", "place"]},
    "SELECT * FROM (SELECT c_mktsegment, o_orderstatus, n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, o_orderstatus) AS place FROM (SELECT c_mktsegment, o_orderstatus, count(*) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)) WHERE place <= 2",
)
program_query(
    "spec_label_hour",
    {"source_tables": [{"name": "events", "alias": "e", "columns": ["event_id", "ts", "event_type", "value"]}], "hours": [{"name": "h", "column_ref": "e.ts"}], "labels": [{"output_column": "shift", "branches": [{"when": "HOUR(ts) < 12", "then": "am"}], "else_value": "pm"}], "metrics": [{"metric_name": "n", "aggregation": "COUNT"}], "output_columns": ["h", "shift", "n"]},
    "SELECT hour(ts) AS h, CASE WHEN hour(ts) < 12 THEN 'am' ELSE 'pm' END AS shift, count(*) AS n FROM events GROUP BY 1, 2",
)
program_query(
    "spec_detail_filter",
    {"source_tables": [_t["orders"] | {"filters": [{"column_ref": "o_orderstatus", "operator": "in", "value": ["F", "P"]}, {"column_ref": "o_totalprice", "operator": "gt", "value": 200000}]}], "output_columns": ["o_orderkey", "o_totalprice"], "sort": [{"column": "o_totalprice", "direction": "DESC"}, "o_orderkey"], "limit": 100},
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice > 200000 ORDER BY 2 DESC, 1 LIMIT 100",
)
program_query(
    "auto_join",
    {"source_tables": [_t["lineitem"], _t["orders"]], "joins": [{"left_table": "l", "right_table": "o", "left_key": "l_orderkey", "right_key": "o_orderkey"}], "output_columns": ["l_returnflag", "most"], "compute_steps": [{"step_name": "one", "source": "input", "group_by": ["l.l_returnflag"], "metrics": [{"metric_name": "most", "aggregation": "MAX", "input_column": "o.o_totalprice"}]}]},
    "SELECT l_returnflag, max(o_totalprice) AS most FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
)
program_query(
    "bridge_join",
    {
        "source_tables": [{"name": "customer", "alias": "c", "columns": ["c_custkey", "c_nationkey", "c_acctbal"]}, {"name": "nation", "alias": "n", "columns": ["n_nationkey", "n_regionkey"], "unique_keys": ["n_nationkey"]}, {"name": "region", "alias": "r", "columns": ["r_regionkey", "r_name"], "unique_keys": ["r_regionkey"]}],
        "joins": [{"left_table": "c", "right_table": "n", "left_key": "c_nationkey", "right_key": "n_nationkey"}, {"left_table": "n", "right_table": "r", "left_key": "n_regionkey", "right_key": "r_regionkey"}],
        "output_columns": ["r_name", "n"],
        "compute_steps": [{"step_name": "one", "source": "input", "group_by": ["r_name"], "metrics": [{"metric_name": "n", "aggregation": "COUNT", "input_column": "c_custkey"}], "joins": [{"left_table": "c", "right_table": "n", "left_key": "c_nationkey", "right_key": "n_nationkey"}, {"left_table": "n", "right_table": "r", "left_key": "n_regionkey", "right_key": "r_regionkey"}]}],
    },
    "SELECT r_name, count(c_custkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
)
_by_customer = {"step_name": "per_customer", "source": "input", "group_by": ["o.o_custkey"], "metrics": [{"metric_name": "orders", "aggregation": "COUNT", "input_column": "o_orderkey"}, {"metric_name": "total", "aggregation": "SUM", "input_column": "o_totalprice"}]}
program_query(
    "mixed_source",
    {"source_tables": [_t["orders"], _t["customer"]], "output_columns": ["c_mktsegment", "orders"], "compute_steps": [_by_customer, {"step_name": "named", "source": ["per_customer"], "group_by": ["c_mktsegment"], "metrics": [{"metric_name": "orders", "aggregation": "SUM", "input_column": "orders"}], "joins": [{"left_table": "per_customer", "right_table": "c", "left_key": "o_custkey", "right_key": "c_custkey"}]}]},
    "SELECT c_mktsegment, CAST(sum(orders) AS BIGINT) AS orders FROM (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)
_large_orders = {"step_name": "large", "source": "input", "group_by": ["o.o_custkey"], "filters": [{"column_ref": "o_totalprice", "operator": "gt", "value": 300000}], "metrics": [{"metric_name": "large", "aggregation": "COUNT", "input_column": "o_orderkey"}]}
program_query(
    "confluence_left",
    {"source_tables": [_t["orders"]], "output_columns": ["o_custkey", "orders", "large"], "compute_steps": [_by_customer, _large_orders, {"step_name": "merged", "source": ["per_customer", "large"], "group_by": ["o_custkey", "orders", "large"], "joins": [{"left_table": "per_customer", "right_table": "large", "left_key": "o_custkey", "join_type": "LEFT"}]}]},
    "SELECT a.o_custkey, orders, large FROM (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) a LEFT JOIN (SELECT o_custkey, count(*) AS large FROM orders WHERE o_totalprice > 300000 GROUP BY 1) b ON a.o_custkey = b.o_custkey",
)
program_query(
    "dag_two_branch",
    {"source_tables": [_t["orders"]], "joins": [{"left_table": "per_customer", "right_table": "large", "left_key": "o_custkey"}], "output_columns": ["large", "avg_total"], "compute_steps": [_by_customer, _large_orders, {"step_name": "merged", "source": ["per_customer", "large"], "group_by": ["large"], "metrics": [{"metric_name": "avg_total", "aggregation": "AVG", "input_column": "total"}]}]},
    "SELECT large, round(avg(total), 7) AS avg_total FROM (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) a JOIN (SELECT o_custkey, count(*) AS large FROM orders WHERE o_totalprice > 300000 GROUP BY 1) b ON a.o_custkey = b.o_custkey GROUP BY 1",
    {"avg_total": 7},
)
program_query(
    "dag_ratio_label",
    {
        "source_tables": [_t["orders"]],
        "output_columns": ["o_custkey", "average", "level"],
        "compute_steps": [
            _by_customer,
            {"step_name": "judged", "source": ["per_customer"], "expressions": [{"name": "average", "expression": "total / NULLIF(orders, 0)"}], "case_when": [{"output_column": "level", "branches": [{"when": "average >= 200000", "then": "high"}, {"when": "average >= 150000 AND orders > 5", "then": "middle"}], "else_value": "low"}]},
        ],
        "sort": ["o_custkey"],
    },
    "SELECT o_custkey, round(a, 7) AS average, CASE WHEN a >= 200000 THEN 'high' WHEN a >= 150000 AND orders > 5 THEN 'middle' ELSE 'low' END AS level FROM (SELECT o_custkey, count(*) AS orders, sum(o_totalprice) / count(*) AS a FROM orders GROUP BY 1)",
    {"average": 7},
)
program_query(
    "dag_pre_aggregate_case",
    {"source_tables": [_t["lineitem"]], "output_columns": ["size", "n"], "compute_steps": [{"step_name": "one", "source": "input", "metrics": [{"metric_name": "n", "aggregation": "COUNT", "input_column": "l_orderkey"}], "case_when": {"output_column": "size", "branches": [{"when": "l_quantity < 10", "then": "small"}], "else_value": "other", "evaluation_phase": "pre_aggregate"}}]},
    "SELECT CASE WHEN l_quantity < 10 THEN 'small' ELSE 'other' END AS size, count(l_orderkey) AS n FROM lineitem GROUP BY 1",
)
program_query(
    "dag_multi_stage",
    {"source_tables": [_t["lineitem"]], "output_columns": ["l_returnflag", "parts", "avg_lines"], "compute_steps": [{"step_name": "a", "source": "input", "group_by": ["l_returnflag", "l_partkey"], "metrics": [{"metric_name": "lines", "aggregation": "COUNT", "input_column": "l_orderkey"}]}, {"step_name": "b", "source": ["a"], "group_by": ["l_returnflag"], "metrics": [{"metric_name": "parts", "aggregation": "COUNT", "input_column": "l_partkey"}, {"metric_name": "avg_lines", "aggregation": "AVG", "input_column": "lines"}]}]},
    "SELECT l_returnflag, count(*) AS parts, round(avg(n), 6) AS avg_lines FROM (SELECT l_returnflag, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    {"avg_lines": 6},
)


@frame_query(
    "cross_grain",
    "SELECT o_orderstatus, count(*) AS n, (SELECT count(*) FROM orders) AS all_orders FROM orders GROUP BY 1",
)
def cross_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = catalog(spark, sf_dir)
    scan = narrow(O, "o_orderkey", "o_orderstatus")
    grouped = lower(Plan((scan, Aggregate(keys("o.o_orderstatus"), (Metric("n", "COUNT"),)))), tables)
    whole = lower(Plan((scan, Aggregate((), (Metric("all_orders", "COUNT"),)))), tables)
    return program.split_cross_grain(grouped, whole)


@frame_query(
    "named_result",
    "SELECT c_custkey, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey",
)
def named_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = catalog(spark, sf_dir)
    per = lower(Plan((narrow(O, "o_custkey"), Aggregate(keys("o.o_custkey"), (Metric("n", "COUNT"),)))), tables)
    return lower(Plan((narrow(C, "c_custkey"), Join(Named("per", "per"), "inner", on(("c.c_custkey", "per.o_custkey"))), Project(keys("c.c_custkey", "per.n")))), tables, {"per": per})


# --- verification, profiles, snapshots ---------------------------------------


#: The digest's text and hashes by DuckDB's own functions.
DIGEST_SELF = r"""
WITH p AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') AS day,
         regexp_replace(regexp_replace(CAST(CAST(round(CAST(o_totalprice AS DECIMAL(38, 12)), 6) AS DECIMAL(32, 6)) AS VARCHAR), '(\.[0-9]*?)0+$', '\1'), '\.$', '.0') AS price
  FROM orders
),
f AS (
  SELECT list_transform([['05', CAST(o_orderkey AS VARCHAR)], ['05', CAST(o_custkey AS VARCHAR)], ['09', o_orderstatus], ['07', price], ['0B', day], ['09', o_orderpriority]],
         lambda x: CASE WHEN x[2] IS NULL THEN x[1] || 'FFFFFFFF' ELSE x[1] || lpad(hex(strlen(x[2])), 8, '0') || hex(x[2]) END) AS parts
  FROM p
),
h AS (SELECT upper(sha256(unhex(array_to_string(parts, '')))) AS h, count(*) AS n FROM f GROUP BY 1),
b AS (
  SELECT substr(h, 1, 2) AS b, upper(sha256(unhex(substr(h, 1, 2) || lpad(hex(count(*)), 16, '0') || string_agg(h || lpad(hex(n), 16, '0'), '' ORDER BY h)))) AS d, sum(n) AS rows
  FROM h GROUP BY 1
),
e AS (SELECT lpad(hex(i), 2, '0') AS b FROM range(256) r(i)),
w AS (
  SELECT string_agg(e.b || coalesce(d, upper(sha256(unhex(e.b || '0000000000000000')))), '' ORDER BY e.b) AS every, CAST(coalesce(sum(rows), 0) AS BIGINT) AS row_count FROM e LEFT JOIN b ON e.b = b.b
),
s AS (SELECT sha256('{"version":"cdp-v1","fields":[["o_orderkey","INT64",null],["o_custkey","INT64",null],["o_orderstatus","VARCHAR",null],["o_totalprice","FLOAT64",6],["o_orderdate","TIMESTAMP",null],["o_orderpriority","VARCHAR",null]]}') AS spec_hash)
SELECT spec_hash, row_count, sha256(unhex(hex('cdp-v1') || upper(spec_hash) || lpad(hex(row_count), 16, '0') || '0100' || every)) AS digest FROM w, s
"""


@frame_query("digest_self", DIGEST_SELF)
def digest_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/orders.parquet"))


@frame_query("diff_empty", "SELECT o_orderkey, 'both' AS side FROM orders WHERE false")
def diff_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return diff(orders, orders.repartition("o_custkey"), ["o_orderkey"]).select("o_orderkey", "side")


@frame_query("diff_changed", "SELECT o_orderkey, CASE WHEN o_custkey % 97 = 0 THEN 'left' ELSE 'both' END AS side FROM orders WHERE o_custkey % 97 = 0 OR (o_orderstatus = 'P' AND o_totalprice <> 0)")
def diff_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    other = orders.filter("o_custkey % 97 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") * 1.01).otherwise(F.col("o_totalprice") * (1 + 1e-13)))
    return diff(orders, other, ["o_orderkey"]).select("o_orderkey", "side")


@frame_query(
    "summary_stats",
    """SELECT 'c_custkey' AS "column", count(*) AS row_count, count(*) - count(c_custkey) AS null_count, round(CAST(sum(c_custkey) AS DOUBLE), 4) AS total FROM customer
    UNION ALL SELECT 'c_name', count(*), count(*) - count(c_name), NULL FROM customer UNION ALL SELECT 'c_acctbal', count(*), count(*) - count(c_acctbal), round(sum(c_acctbal), 4) FROM customer""",
)
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal"))


#: The rules of a profile over the unpivoted columns.
ENUM_PROFILE = rf"""
WITH u AS (
  SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS c,
         unnest([CAST(p_partkey AS VARCHAR), p_name, p_brand, p_type, CAST(p_size AS VARCHAR), CAST(p_retailprice AS VARCHAR)]) AS v FROM part
),
g AS (SELECT c, count(*) AS n, count(DISTINCT v) AS d, list_sort(list_distinct(list(v))) AS vs FROM u GROUP BY c),
w AS (
  SELECT *, n < 10 OR d / n <= 0.1 AS rare, n < 10 OR d / n <= 0.05 AS rarer, d = 0 OR regexp_matches(c, 'year|_yr$|month|amount|price|qty|quantity|count|_cnt$|age|_days$|day_') AS never,
         regexp_matches(c, '(_status|_state|_phase|_stage)$|^status_') AS stated, regexp_matches(c, '(_type|_code|_category|_class|_kind|_level)$|^type_|^code_') AS coded,
         regexp_matches(c, '^(is|has|flag)_|_(flag|yn)$') AS flagged, list_transform(vs, lambda v: lower(v)) AS ls, list_avg(list_transform(vs, lambda v: length(v))) AS wide,
         list_avg(list_transform(vs, lambda v: CAST(regexp_matches(v, '^[A-Z]{{2,4}}$') AS INT))) AS short, list_avg(list_transform(vs, lambda v: CAST(regexp_matches(v, '^[A-Z][a-zA-Z]*([ -][A-Z][a-zA-Z]*)*$') AS INT))) AS as_status,
         list_avg(list_transform(vs, lambda v: CAST(regexp_matches(v, '^([0-9]{{1,6}}|[A-Z]{{2,6}})$') AS INT))) AS as_code
  FROM g
),
k AS (
  SELECT *, CASE WHEN never THEN NULL
    WHEN d <= 2 AND (list_has_all(['0', '1', 'true', 'false'], ls) OR list_has_all(['y', 'n'], ls) OR list_has_all(['yes', 'no'], ls) OR list_has_all(['是', '否'], ls)) THEN 'flag'
    WHEN flagged THEN NULL
    WHEN d <= 30 AND rare AND wide BETWEEN 3 AND 25 AND short < 0.8 AND as_status >= 0.6 THEN 'status'
    WHEN d BETWEEN 3 AND 50 AND rarer AND as_code >= 0.6 THEN 'code' END AS kind,
    list_has_any(list_transform(ls, lambda v: replace(v, '-', '_')), {list(STATUS_WORDS)}) AS worded
  FROM w
)
SELECT c AS "column", kind, CASE WHEN kind IS NULL THEN '' WHEN kind = 'flag' THEN array_to_string(ls, '|') ELSE array_to_string(vs, '|') END AS "values", n AS rows,
       CASE WHEN kind IS NULL THEN 'NOT_ENUM' WHEN kind = 'flag' THEN CASE WHEN flagged THEN 'CERTAIN' ELSE 'LOW' END
            WHEN (kind = 'status' AND as_status >= 0.9 AND stated) OR (kind = 'code' AND as_code >= 0.9 AND coded) THEN 'HIGH'
            WHEN (kind = 'status' AND as_status >= 0.8 AND (stated OR worded)) OR (kind = 'code' AND as_code >= 0.8 AND coded) THEN 'MEDIUM' ELSE 'LOW' END AS tier
FROM k
"""


@frame_query("enum_profile", ENUM_PROFILE)
def enum_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = [(p.column, p.tier, p.kind, "|".join(p.values), p.rows) for p in profile(part, part.columns)]
    return spark.createDataFrame(rows, "column string, tier string, kind string, values string, rows long")


@frame_query(
    "snapshot_relation",
    """WITH a AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 200),
    g AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM a) GROUP BY 1),
    k AS (SELECT o_custkey FROM (SELECT o_custkey, sum(n) OVER (ORDER BY n, o_custkey) AS s FROM g) WHERE s <= 500)
    SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders JOIN a ON o_custkey = c_custkey WHERE o_custkey IN (SELECT o_custkey FROM k)""",
)
def snapshot_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 200 customers and of their orders whole groups within a budget of 500 rows."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders")}
    found = snapshot.related(tables, "customer", [snapshot.Relation("customer", "orders", (("c_custkey", "o_custkey"),))], rows=200, budget=500)
    return found["orders"].join(found["customer"], F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@frame_query("summary_samples", "SELECT * FROM customer ORDER BY c_custkey LIMIT 20")
def summary_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark.read.parquet(f"{sf_dir}/customer.parquet"))


@frame_query(
    "conditional_branches",
    """SELECT coalesce(u.o_custkey, o.o_custkey) AS o_custkey, urgent, other, coalesce(urgent, other) AS leading
    FROM (SELECT o_custkey, count(*) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) u
    FULL JOIN (SELECT o_custkey, count(*) AS other FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1) o ON u.o_custkey = o.o_custkey""",
)
def conditional_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step for each filtered metric, merged over the grain, the label being the first that has a value."""
    only = lambda v: {"column_ref": "o_orderpriority", "operator": "=", "value": v}
    spec = {
        "source_tables": [{"name": "orders", "alias": "o", "columns": [{"name": n, "type": t} for n, t in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderpriority", "string"))]}],
        "metrics": [{"metric_name": "urgent", "aggregation": "COUNT", "filter": only("1-URGENT")}, {"metric_name": "other", "aggregation": "COUNT", "filter": only("5-LOW")}],
        "dimensions": [{"column_ref": "o.o_custkey"}],
        "target_grain": ["o_custkey"],
        "output_columns": ["o_custkey", "urgent", "other", "leading"],
    }
    return program.run(program.branches(parse(spec)), catalog(spark, sf_dir))


@frame_query("snapshot_groups", "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS groups FROM (SELECT n, sum(n) OVER (ORDER BY n, o_custkey) AS s FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)) WHERE s <= 5000")
def snapshot_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return snapshot.complete_groups(orders, ["o_custkey"], 5000).agg(F.count("*").alias("rows"), F.count_distinct("o_custkey").alias("groups"))


# --- sources, snapshots, writes ----------------------------------------------

_NATION = "n_nationkey int, n_name string, n_regionkey int"


def _written(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """The nations as text files."""
    path = scratch(spark, kind)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("CAST(n_nationkey AS int) AS n_nationkey", "n_name", "CAST(n_regionkey AS int) AS n_regionkey")
    (rows.write.option("header", True).csv if kind == "csv" else rows.write.json)(path)
    return path


@frame_query("csv_source", "SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name, CAST(n_regionkey AS INT) AS n_regionkey FROM nation")
def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Catalog(spark).add_file("n", _written(spark, sf_dir, "csv"), "csv", schema=_NATION).read("n")


@frame_query("json_source", "SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name, CAST(n_regionkey AS INT) AS n_regionkey FROM nation")
def json_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Catalog(spark).add_file("n", _written(spark, sf_dir, "json"), "json", schema=_NATION).read("n")


@frame_query("session_table", "SELECT r_regionkey, r_name FROM region")
def session_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/region.parquet").createOrReplaceTempView("specdag_region")
    return Catalog(spark).add_catalog_table("r", "specdag_region").read("r").select("r_regionkey", "r_name")


@frame_query("snapshot_aliases", "SELECT a.n_name AS name, b.n_name AS neighbour, 0 AS damaged FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def snapshot_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot written, checked, and read under two names of one table."""
    folder = scratch(spark, "snapshot")
    snapshot.write(spark, {"nation": spark.read.parquet(f"{sf_dir}/nation.parquet")}, folder, {"a": "nation", "b": "nation"})
    again = snapshot.catalog_of(spark, folder)
    a, b = (again.read(n).select(*(F.col(c).alias(f"{n}_{c}") for c in ("n_nationkey", "n_name", "n_regionkey"))) for n in ("a", "b"))
    pairs = a.join(b, (F.col("a_n_regionkey") == F.col("b_n_regionkey")) & (F.col("a_n_nationkey") < F.col("b_n_nationkey")))
    return pairs.select(F.col("a_n_name").alias("name"), F.col("b_n_name").alias("neighbour"), F.lit(len(snapshot.verify(spark, folder))).alias("damaged"))


@frame_query("sample_strata", "SELECT o_orderstatus, CAST(ceil(count(*) * 0.05) AS BIGINT) AS n FROM orders GROUP BY 1")
def sample_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.sample(spark.read.parquet(f"{sf_dir}/orders.parquet"), "stratified", fraction=0.05, by="o_orderstatus", seed=7).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@frame_query("partition_overwrite", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, 20240101 AS dt FROM region WHERE r_regionkey < 2 UNION ALL SELECT CAST(r_regionkey AS BIGINT), 20240102 FROM region")
def partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two partitions, of which the first is overwritten."""
    rows, path = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("r_regionkey")), scratch(spark, "partitions")
    plan = lambda day: writeplan.WritePlan("ads.region", "_temp_region", ("dt",), {"dt": day}, "yyyyMMdd")
    for day, part in (("20240101", rows), ("20240102", rows), ("20240101", rows.filter("r_regionkey < 2"))):
        writeplan.execute(part, plan(day), path)
    return spark.read.parquet(path)


# --- checks and verdicts -----------------------------------------------------


def _values(cases: dict[str, str]) -> str:
    """SQL for what a check must say in each case."""
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in cases.items()) + ") AS t(case_name, said)"


def _said(spark: SparkSession, found: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(found.items()), "case_name string, said string")


_ORDERS = {"name": "orders", "alias": "o", "role": "fact", "columns": [{"name": n, "type": t} for n, t in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_totalprice", "double"), ("o_orderstatus", "string"))]}
_CUSTOMERS = {"name": "customer", "alias": "c", "columns": [{"name": n, "type": t} for n, t in (("c_custkey", "bigint"), ("c_mktsegment", "string"))]}
_SUMS = {"source_tables": [_ORDERS], "metrics": [{"metric_name": "total", "aggregation": "SUM", "input_column": "o.o_totalprice"}], "dimensions": [{"column_ref": "o.o_orderstatus"}], "output_columns": ["o_orderstatus", "total"]}
_BY = {"left_table": "o", "right_table": "c", "left_key": "o_custkey", "right_key": "c_custkey", "join_type": "LEFT"}
_WIDENS = {"left_table": "c", "right_table": "o", "left_key": "c_custkey", "right_key": "o_custkey", "join_type": "LEFT"}
_STEP = {"step_name": "one", "source": "input", "group_by": ["o_orderstatus"], "metrics": _SUMS["metrics"]}
#: Specifications and what the checks before running must say of each.
_REFUSED = {
    "sound": ({}, "passes"),
    "fan-out": ({"source_tables": [_CUSTOMERS, _ORDERS], "joins": [_WIDENS]}, "FANOUT"),
    "unique key of the catalog": ({"source_tables": [_ORDERS, _CUSTOMERS], "joins": [_BY]}, "passes"),
    "unique keys that disagree": ({"source_tables": [_ORDERS, {**_CUSTOMERS, "unique_keys": ["c_mktsegment"]}], "joins": [_BY]}, "UNIQUENESS_CONFLICT"),
    "types of a join": ({"source_tables": [_ORDERS, {**_CUSTOMERS, "columns": [{"name": "c_custkey", "type": "string"}]}], "joins": [_BY]}, "JOINTYPE"),
    "grain": ({"target_grain": ["o_custkey"]}, "GRAIN"),
    "no such column": ({"source_tables": [{**_ORDERS, "columns": [*_ORDERS["columns"], {"name": "o_gone", "type": "int"}]}]}, "COL"),
    "large without a time": ({"source_tables": [{**_ORDERS, "row_count": 5_000_000}]}, "TIME"),
    "rank without an order": ({"windows": [{"name": "w", "function": "RANK", "partition_by": ["o_orderstatus"]}]}, "WINDOW_ORDER"),
    "frame of a rank": ({"windows": [{"name": "w", "function": "ROW_NUMBER", "order_by": ["total"], "frame": {"kind": "rows", "start": -1, "end": 0}}]}, "WINDOW_FRAME"),
    "label of nothing": ({"labels": [{"output_column": "l", "branches": [{"when": "o_gone > 1", "then": "big"}], "else_value": "x", "evaluation_phase": "post_aggregate"}]}, "FIELD_EXISTS"),
    "distinct over all": ({"metrics": [{"metric_name": "total", "aggregation": "COUNT", "input_column": "o.o_custkey", "distinct": True}], "dimensions": [], "output_columns": ["total"]}, "PERF-009"),
    "free text": ({"metrics": [{"metric_name": "total", "aggregation": "COUNT", "raw_sql": "1"}]}, "E007"),
    "step of a missing source": ({"compute_steps": [{**_STEP, "source": "gone"}]}, "DAG_MISSING"),
    "step that nothing reads": ({"compute_steps": [_STEP, {**_STEP, "step_name": "two"}]}, "DAG_UNREAD"),
    "steps in a circle": ({"compute_steps": [{**_STEP, "source": "two"}, {**_STEP, "step_name": "two", "source": "one"}]}, "CIRCULAR_DEPENDENCY"),
    "step that multiplies rows": ({"source_tables": [_ORDERS, _CUSTOMERS], "compute_steps": [{**_STEP, "joins": [{**_WIDENS, "join_type": "INNER"}]}]}, "FANOUT"),
    "name of two steps": ({"metrics": [], "dimensions": [], "compute_steps": [_STEP, {**_STEP, "step_name": "two"}, {"step_name": "z", "source": ["one", "two"], "joins": [{"left_table": "one", "right_table": "two", "left_key": "o_orderstatus"}]}]}, "AMBIGUOUS_COLUMN"),
}


@frame_query("refused_specs", _values({k: said for k, (_, said) in _REFUSED.items()}))
def refused_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = {}
    for name, (change, _) in _REFUSED.items():
        try:
            program.run(parse({**_SUMS, **change}), catalog(spark, sf_dir))
            found[name] = "passes"
        except SpecError as e:
            found[name] = e.code
    return _said(spark, found)


@frame_query("compared_results", _values({"same": "CONSISTENT", "a rounding apart": "CONSISTENT_WITH_WARN", "a row less": "MISMATCH", "other values": "MISMATCH", "doubled keys": "HUMAN_REVIEW", "no rows": "HUMAN_REVIEW", "more than fit": "SAMPLED_CONSISTENT"}))
def compared_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice").filter("o_totalprice > 1")
    price, keys = F.col("o_totalprice"), ["o_orderkey"]
    said = {
        "same": compare(orders, orders.repartition("o_totalprice"), keys, sampled=False),
        "a rounding apart": compare(orders, orders.withColumn("o_totalprice", price * (1 + 1e-13)), keys, sampled=False),
        "a row less": compare(orders, orders.orderBy("o_orderkey").offset(1), keys, sampled=False),
        "other values": compare(orders, orders.withColumn("o_totalprice", price + 1), keys, sampled=False),
        "doubled keys": compare(orders.unionByName(orders), orders.unionByName(orders), keys, sampled=False),
        "no rows": compare(orders.filter("false"), orders.filter("false"), keys),
        "more than fit": compare(orders, orders.repartition("o_totalprice"), keys, overflow=10),
    }
    return _said(spark, {k: r.status.value for k, r in said.items()})


@frame_query("plan_verdicts", _values({"turned": "LOGIC_EQUIVALENT", "other bound": "LOGIC_MISMATCH", "other order": "LOGIC_MISMATCH", "named result": "NOT_COVERED", "nothing": "NOT_EXECUTED"}))
def plan_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = lambda *steps: Plan((Scan("orders", "o", ("o_orderkey", "o_custkey")), *steps))
    over = Plan((Named("x", "x"), Limit(3)))
    low, high = Cmp(">", c("o.o_custkey"), Lit(5)), Cmp("<", c("o.o_custkey"), Lit(9))
    by = (Order(c("o.o_custkey")), Order(c("o.o_orderkey")))
    said = {
        "turned": equivalent(plan(Filter(And((low, high)))), plan(Filter(high), Filter(Cmp("<", Lit(5), c("o.o_custkey"))))),
        "other bound": equivalent(plan(Filter(low)), plan(Filter(Cmp(">=", c("o.o_custkey"), Lit(5))))),
        "other order": equivalent(plan(Sort(by)), plan(Sort(by[::-1]))),
        "named result": equivalent(over, over),
        "nothing": equivalent(None, plan()),
    }
    return _said(spark, {k: v.value for k, (v, _) in said.items()})


@frame_query("source_anomalies", _values({"MISSING_COLUMN": "1", "TYPE_MISMATCH": "1", "PARTITION_GAP": "1", "ROW_COUNT_DRIFT": "1"}))
def source_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = TableMeta("region", est_rows=1000, types={"r_name": "int", "r_gone": "int"}, nullable={"r_regionkey": False})
    found = anomalies(spark.read.parquet(f"{sf_dir}/region.parquet"), meta, partition="r_regionkey", partitions=(0, 99))
    return _said(spark, {f.code: str(sum(g.code == f.code for g in found)) for f in found})


@frame_query("join_evidence", _values({"declared": "STRONG adopt", "foreign key": "STRONG adopt", "one name and unique": "MEDIUM confirm", "close names": "WEAK block", "other types": "NONE ignore", "other names": "NONE ignore"}))
def join_evidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = TABLES["nation"], TABLES["region"]
    typed = lambda kind: TableMeta("t", types={"k": kind})
    said = {
        "declared": join_evidence(typed("int"), typed("bigint"), "k", "k", declared=True),
        "foreign key": join_evidence(a, b, "n_regionkey", "r_regionkey"),
        "one name and unique": join_evidence(TableMeta("x"), TableMeta("y", unique_keys=(("cust_id",),)), "cust_id", "cust_id"),
        "close names": join_evidence(TableMeta("x"), TableMeta("y"), "cust_id", "cust_ids"),
        "other types": join_evidence(typed("int"), typed("date"), "k", "k"),
        "other names": join_evidence(TableMeta("x"), TableMeta("y"), "segment", "price"),
    }
    return _said(spark, {k: f"{e.level} {e.action}" for k, e in said.items()})


@frame_query("step_kinds", _values({"a": "PRODUCER", "b": "CONSUMER", "c": "FINAL"}))
def step_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = lambda name, source: {"step_name": name, "source": source, "group_by": ["o_orderstatus"]}
    return _said(spark, {k: v.value for k, v in program.kinds(parse({**_SUMS, "compute_steps": [step("c", "b"), step("a", "input"), step("b", "a")]}).steps).items()})


program_query(
    "cross_grain_inferred",
    {**_SUMS, "computed_metrics": [{"name": "share", "formula": "total / total_total"}], "output_columns": ["o_orderstatus", "total", "share"], "target_grain": []},
    "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 9) AS share FROM orders GROUP BY 1",
    {"total": 2, "share": 9},
)
program_query(
    "computed_metric",
    {**_SUMS, "metrics": [*_SUMS["metrics"], {"metric_name": "n", "aggregation": "COUNT"}], "computed_metrics": [{"name": "each", "formula": "total / n"}], "output_columns": ["o_orderstatus", "each"]},
    "SELECT o_orderstatus, round(sum(o_totalprice) / count(*), 6) AS each FROM orders GROUP BY 1",
    {"each": 6},
)
