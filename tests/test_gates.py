"""What is refused before anything runs, through ``program.run``, and what goes through."""

import pytest
from pyspark.sql import functions as F

from specdag.errors import SpecError
from specdag.functions.expr import Cmp, Col, Lit
from specdag.plans import program
from specdag.plans.program import Kind
from specdag.plans.spec import parse
from specdag.plans.steps import Filter, Named, Plan, Project, Scan
from specdag.sources import snapshot
from specdag.sources.catalog import Catalog, TableMeta
from specdag.verify.compare import Status, compare
from specdag.verify.digest import bound, compared
from specdag.verify.equivalence import Verdict, equivalent
from specdag.verify.summary import samples


@pytest.fixture(scope="module")
def tables(spark):
    orders = spark.createDataFrame([(1, 1, 7.0, "a"), (2, 2, 15.0, "b"), (3, 9, 0.0, "a")], "id int, c int, v double, s string")
    twice = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "c int, name string")
    return Catalog(spark).add("orders", orders).add("customers", twice)


def columns(*names, **types):
    return [{"name": n, "type": types.get(n, "int")} for n in names]


O_ = {"name": "orders", "alias": "o", "columns": columns("id", "c", "v", "s", v="double", s="string")}
C_ = {"name": "customers", "alias": "cu", "columns": columns("c", "name", name="string")}
JOIN = {"left_table": "o", "right_table": "cu", "left_key": "c", "join_type": "LEFT"}
TOTAL = {"metric_name": "total", "aggregation": "SUM", "input_column": "o.v"}
BASE = {"source_tables": [O_], "metrics": [TOTAL], "dimensions": [{"column_ref": "o.s"}], "output_columns": ["s", "total"]}
LABEL = {"output_column": "l", "branches": [{"when": "total > 1", "then": "big"}], "else_value": "small"}


def refused(spec, tables, code, **more):
    with pytest.raises(SpecError) as e:
        program.run(parse(spec), tables, **more)
    assert e.value.code == code


def test_a_join_that_multiplies_rows(tables):
    spec = {**BASE, "source_tables": [O_, C_], "joins": [JOIN], "dimensions": [], "output_columns": ["total"]}
    refused(spec, tables, "FANOUT")
    assert program.run(parse(spec), tables, on_fanout="allow").first()["total"] == 37.0
    declared = {**spec, "source_tables": [O_, {**C_, "unique_keys": ["c"]}]}
    assert program.gate(parse(declared), tables) is not None


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({"source_tables": [O_, {**C_, "columns": columns("c", "name", c="string"), "unique_keys": ["c"]}], "joins": [JOIN]}, "JOINTYPE"),
        ({"target_grain": ["id"]}, "GRAIN"),
        ({"source_tables": [{**O_, "row_count": 5_000_000}]}, "TIME"),
        ({"source_tables": [{**O_, "row_count": 5_000_000, "role": "fact", "time_field": "id"}], "time_range": {"column_ref": "o.c", "start": "1", "end": "2"}}, "PERF-002"),
        ({"source_tables": [{**O_, "columns": [*O_["columns"], {"name": "gone", "type": "int"}]}]}, "COL"),
        ({"source_tables": [{**O_, "name": "nowhere"}]}, "TABLE"),
        ({"labels": [{**LABEL, "branches": [{"when": "missing > 1", "then": "big"}], "evaluation_phase": "post_aggregate"}]}, "FIELD_EXISTS"),
        ({"windows": [{"name": "w", "function": "RANK", "partition_by": ["s"]}]}, "WINDOW_ORDER"),
        ({"windows": [{"name": "w", "function": "ROW_NUMBER", "order_by": ["total"], "frame": {"kind": "rows", "start": -1, "end": 0}}]}, "WINDOW_FRAME"),
        ({"windows": [{"name": "w", "function": "SUM", "input_column": "total", "order_by": ["total"], "frame": {"kind": "rows", "start": 2, "end": 1}}]}, "WINDOW_FRAME"),
        ({"windows": [{"name": "w", "function": "MEDIAN", "order_by": ["total"]}]}, "WINDOW_FUNCTION"),
        ({"source_tables": [O_, {**C_, "unique_keys": ["c"]}], "joins": [{**JOIN, "left_key": [], "join_type": "CROSS"}]}, "PERF-010"),
        ({"metrics": [{**TOTAL, "aggregation": "COUNT", "distinct": True}], "dimensions": [], "output_columns": ["total"]}, "PERF-009"),
        ({"compute_steps": [{"step_name": "a", "source": "gone", "group_by": ["s"]}]}, "DAG_MISSING"),
        ({"compute_steps": [{"step_name": "a", "source": "input", "group_by": ["s"], "metrics": [TOTAL], "case_when": {**LABEL, "branches": [{"when": "odd > 1", "then": "x"}]}}]}, "FIELD_EXISTS"),
    ],
)
def test_refused_before_running(tables, change, code):
    refused({**BASE, **change}, tables, code)


def test_a_registry_that_disagrees(spark, tables):
    rows = tables.read("orders")
    refused(BASE, Catalog(spark).add("orders", rows, TableMeta("orders", types={"v": "string"})), "TYPE_CONFLICT")
    assert program.run(parse(BASE), Catalog(spark).add("orders", rows, TableMeta("orders", types={"v": "double"}))).count() == 2


def test_joins_of_steps(tables):
    """A LEFT join may multiply rows; any other needs a unique key on its right."""
    step = lambda how: {"step_name": "a", "source": "input", "joins": [{**JOIN, "join_type": how}], "group_by": ["s"], "metrics": [TOTAL]}
    spec = lambda how: {**BASE, "source_tables": [O_, C_], "compute_steps": [step(how)]}
    refused(spec("INNER"), tables, "FANOUT")
    assert {r["s"]: r["total"] for r in program.run(parse(spec("LEFT")), tables).collect()} == {"a": 7.0, "b": 30.0}


def test_a_name_of_two_steps(tables):
    one = {"step_name": "one", "source": "input", "group_by": ["s"], "metrics": [TOTAL]}
    two = {"step_name": "two", "source": "input", "group_by": ["s"], "metrics": [{**TOTAL, "aggregation": "COUNT"}]}
    merged = {"step_name": "z", "source": ["one", "two"], "joins": [{"left_table": "one", "right_table": "two", "left_key": "s"}]}
    spec = {**BASE, "metrics": [], "dimensions": [], "compute_steps": [one, two, merged]}
    refused(spec, tables, "AMBIGUOUS_COLUMN")
    named = {**merged, "group_by": ["s"], "metrics": [{"metric_name": "sums", "aggregation": "SUM", "input_column": "one.total"}, {"metric_name": "counts", "aggregation": "SUM", "input_column": "two.total"}]}
    found = program.run(parse({**spec, "output_columns": ["s", "sums", "counts"], "compute_steps": [one, two, named]}), tables).collect()
    assert sorted(tuple(r) for r in found) == [("a", 7.0, 2), ("b", 15.0, 1)]


def test_kinds_of_steps():
    step = lambda name, *source: {"step_name": name, "source": list(source) or "input", "group_by": ["s"]}
    of = lambda *steps: program.kinds(parse({**BASE, "compute_steps": list(steps)}).steps)
    assert of(step("a")) == {"a": Kind.STANDALONE}
    assert of(step("a"), step("b", "a"), step("c", "b")) == {"a": Kind.PRODUCER, "b": Kind.CONSUMER, "c": Kind.FINAL}


def test_branches(tables):
    only = lambda v: {"column_ref": "s", "operator": "=", "value": v}
    metrics = [{"metric_name": n, "aggregation": "SUM", "input_column": "v", "filter": only(n)} for n in ("a", "b")]
    spec = parse({**BASE, "metrics": metrics, "dimensions": [{"column_ref": "o.c"}], "target_grain": ["c"], "output_columns": ["c", "a", "b", "l"]})
    split = program.branches(spec)
    assert [s.name for s in split.steps] == ["branch_a", "branch_b", "merge_conditional"]
    assert sorted(tuple(r) for r in program.run(split, tables).collect()) == [(1, 7.0, None, 7.0), (2, None, 15.0, 15.0), (9, 0.0, None, 0.0)]
    assert program.branches(parse(BASE)) == parse(BASE)


def test_verdicts():
    plan = Plan((Scan("t", "t", ("a",)), Filter(Cmp(">", Col("t", "a"), Lit(1)))))
    over = Plan((Named("x", "x"), Project(())))
    assert equivalent(None, plan)[0] is Verdict.NOT_EXECUTED and equivalent(Plan(()), plan)[0] is Verdict.NOT_EXECUTED
    assert equivalent(over, over)[0] is Verdict.NOT_COVERED
    assert equivalent(over, over, {"x": (plan, plan)})[0] is Verdict.EQUIVALENT
    assert equivalent(over, over, {"x": (plan, Plan(plan.steps[:1]))})[0] is Verdict.MISMATCH
    assert equivalent(Plan((*plan.steps, "odd")), plan)[0] is Verdict.UNSUPPORTED


def test_overflow_is_compared_in_part(spark):
    large = spark.range(300).selectExpr("id", "id % 20 AS g", "id * 2 AS v")
    assert compare(large, large, ["g", "id"], overflow=100).status is Status.SAMPLED_CONSISTENT
    assert compare(large, large, ["g", "id"]).status is Status.CONSISTENT
    assert compare(large, large, ["g", "id"], sampled=False, overflow=100).status is Status.CONSISTENT
    assert compare(large, large.filter("id < 299"), ["g", "id"], overflow=100).reason == "the row counts differ"


def test_digests_hold_for_one_snapshot(spark):
    a = spark.range(5)
    assert compared(bound(a, "s1"), bound(a.orderBy(F.desc("id")), "s1")) == (True, "")
    assert compared(bound(a, "s1"), bound(spark.range(6), "s1"))[0] is False and compared(bound(a, "s1"), bound(spark.range(1, 6), "s1")) == (False, "the rows differ")
    for other in (bound(a, "s2"), bound(a.selectExpr("CAST(id AS int) AS id"), "s1")):
        with pytest.raises(SpecError):
            compared(bound(a, "s1"), other)
    assert [r["id"] for r in samples(spark.range(50).orderBy(F.desc("id"))).collect()] == list(range(20))


def test_aliases_of_a_snapshot(spark, tmp_path):
    folder = f"file://{tmp_path}/snap"
    manifest = snapshot.write(spark, {"t": spark.range(4)}, folder, {"left": "t", "right": "t"})
    again = snapshot.catalog_of(spark, folder)
    assert manifest["id"] and again.read("left").join(again.read("right"), "id").count() == 4 and snapshot.verify(spark, folder) == []
    for aliases in ({"x": "gone"}, {"t": "t"}):
        with pytest.raises(SpecError):
            snapshot.write(spark, {"t": spark.range(4)}, f"file://{tmp_path}/other", aliases)


def test_strata(spark):
    """Of copies too, which a hash of rows would take or leave together."""
    df = spark.range(1200).selectExpr("CASE WHEN id < 1000 THEN 'big' WHEN id < 1100 THEN 'small' WHEN id < 1103 THEN 'few' END AS g", "1 AS v")
    found = {r["g"]: r["count"] for r in snapshot.sample(df, "stratified", fraction=0.1, by="g", seed=3).groupBy("g").count().collect()}
    assert found == {"big": 100, "small": 10, "few": 1, None: 10}
    with pytest.raises(SpecError):
        snapshot.sample(df, "stratified", fraction=0.1)


def test_metrics_over_all_rows_are_inferred(tables):
    spec = {**BASE, "computed_metrics": [{"name": "share", "formula": "total / total_total"}], "output_columns": ["s", "total", "share"]}
    assert [s.name for s in program.cross_grain(parse(spec)).steps] == ["grouped", "overall", "merged"]
    assert sorted(tuple(r) for r in program.run(parse(spec), tables).collect()) == [("a", 7.0, 7 / 22), ("b", 15.0, 15 / 22)]
    own = {**spec, "computed_metrics": [{"name": "share", "formula": "total * 2"}]}
    assert program.cross_grain(parse(own)) == parse(own)
    assert sorted(r["share"] for r in program.run(parse(own), tables).collect()) == [14.0, 30.0]
    refused({**spec, "source_tables": [O_, {**C_, "unique_keys": ["c"]}], "joins": [JOIN]}, tables, "CROSS_GRAIN")
