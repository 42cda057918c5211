"""The engine's expressions, plans and lowering; every stated trap has a test."""

import datetime

import pytest
from pyspark.sql import functions as F

from specdag.errors import SpecError
from specdag.functions import calendar
from specdag.functions.expr import And, Between, Cmp, Col, In, Lit, Not, Or, filter_of, parse_predicate, parse_value
from specdag.functions.names import edit_distance, normalise, row_count
from specdag.functions.profile import judge
from specdag.operators.lower import lower
from specdag.plans import perf, program
from specdag.plans.build import build
from specdag.plans.spec import parse
from specdag.plans.steps import Aggregate, Derive, Filter, Frame, Join, JoinKey, Key, Limit, Metric, Order, Plan, Project, Scan, Sort, Subquery, Window, dumps, loads
from specdag.plans.validate import check_label, check_plan, check_spec, check_window, compatible, join_evidence, merge_facts
from specdag.queries import FLAGSHIP
from specdag.sources.catalog import Catalog, ForeignKey, TableMeta
from specdag.streaming.apply import apply


@pytest.fixture()
def tables(spark):
    facts = spark.createDataFrame([(1, 10, 5.0, "a", None), (2, 10, 7.0, "b", True), (3, 20, None, "a", False), (4, None, 1.0, None, True)], "id int, k int, v double, s string, flag boolean")
    dims = spark.createDataFrame([(10, "x"), (30, "z"), (None, "n")], "k int, name string")
    days = spark.createDataFrame([(1, "2024-02-29 23:59:59.5"), (2, "2024-03-01 00:00:00"), (3, "2024-02-28 12:00:00")], "id int, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    return Catalog(spark).add("f", facts).add("d", dims).add("days", days)


F_ = Scan("f", "f", ("id", "k", "v", "s", "flag"))
D_ = Scan("d", "d", ("k", "name"))
ON = (JoinKey(Col("f", "k"), Col("d", "k")),)


def rows(plan, tables):
    return sorted(map(tuple, lower(Plan(tuple(plan)), tables).collect()), key=repr)


def ids(plan, tables):
    return [r[0] for r in rows((*plan, Project((Key("id", Col("f", "id")),))), tables)]


def test_predicates_follow_three_valued_logic(tables):
    assert ids((F_, Filter(In(Col("f", "s"), ("a",), True))), tables) == [2]
    assert ids((F_, Filter(Not(Cmp("=", Col("f", "s"), Lit("a"))))), tables) == [2]
    assert ids((F_, Filter(Between(Col("f", "v"), Lit(1), Lit(5)))), tables) == [1, 4]
    assert ids((F_, Filter(Or((Cmp(">", Col("f", "v"), Lit(6)), And((Cmp("=", Col("f", "s"), Lit("a")), Cmp("<", Col("f", "id"), Lit(2)))))))), tables) == [1, 2]


def test_joins_keep_keys_apart(tables):
    out = Project((Key("id", Col("f", "id")), Key("fk", Col("f", "k")), Key("dk", Col("d", "k"))))
    assert rows((F_, Join(D_, "full", ON), out), tables) == [(1, 10, 10), (2, 10, 10), (3, 20, None), (4, None, None), (None, None, 30), (None, None, None)]
    assert len(rows((F_, Join(D_, "right", ON), out), tables)) == 4
    with pytest.raises(SpecError):
        lower(Plan((F_, Join(D_, "inner"))), tables)
    with pytest.raises(SpecError):
        lower(Plan((F_, Join(D_, "semi", ON))), tables)


def test_right_side_filter_is_after_the_join_unless_said(tables):
    after = (F_, Join(D_, "left", ON), Filter(Cmp("=", Col("d", "name"), Lit("q"))))
    before = (F_, Join(D_, "left", ON, pre_filter=Cmp("=", Col("d", "name"), Lit("q"))))
    assert ids(after, tables) == []
    assert ids(before, tables) == [1, 2, 3, 4]


def test_aggregates(tables):
    found = lower(Plan((F_, Aggregate((), (Metric("n", "COUNT"), Metric("v", "COUNT", Col("f", "v")), Metric("flags", "SUM", Col("f", "flag")), Metric("a", "AVG", Col("f", "k"), True))))), tables).first()
    assert tuple(found) == (4, 3, 2, 15.0)
    for func in ("MEDIAN", "STDDEV", "PERCENTILE"):
        with pytest.raises(SpecError):
            lower(Plan((F_, Aggregate((), (Metric("x", func, Col("f", "v")),)))), tables)
    assert rows((F_, Aggregate((Key("s", Col("f", "s")),), (Metric("n", "COUNT"),), Cmp(">", Col(None, "n"), Lit(1)))), tables) == [("a", 2)]


def test_nulls_are_last_unless_asked(tables):
    order = lambda **k: [r[0] for r in lower(Plan((F_, Project((Key("id", Col("f", "id")), Key("v", Col("f", "v")))), Sort((Order(Col(None, "v"), **k),)))), tables).collect()]
    assert order()[-1] == 3 and order(ascending=False)[-1] == 3 and order(nulls_first=True)[0] == 3


def test_window_frames(tables):
    w = lambda **k: [r[0] for r in lower(Plan((F_, Window("w", "SUM", Col("f", "id"), order=(Order(Col("f", "s")),), **k), Project((Key("w", Col(None, "w")), Key("id", Col("f", "id")))), Sort((Order(Col(None, "id")),)))), tables).collect()]
    assert w() == [4, 6, 4, 10]  # peers count together
    assert w(frame=Frame("rows", "unbounded", "unbounded")) == [10] * 4
    with pytest.raises(SpecError):
        lower(Plan((F_, Window("w", "NTILE", buckets=0, order=(Order(Col("f", "id")),)))), tables)
    with pytest.raises(SpecError):
        lower(Plan((F_, Window("w", "CUME_DIST", order=(Order(Col("f", "id")),)))), tables)


def test_division_by_zero_is_null(tables):
    assert rows((F_, Filter(Cmp("=", Col("f", "id"), Lit(1))), Derive("x", parse_value("v / (id - 1)")), Derive("y", parse_value("id % (id - 1)")), Project((Key("x", Col(None, "x")), Key("y", Col(None, "y"))))), tables) == [(None, None)]


def test_half_open_days(tables):
    t = Scan("days", "days", ("id", "t"))
    got = lambda e: sorted(r[0] for r in lower(Plan((t, Filter(e), Project((Key("id", Col("days", "id")),)))), tables).collect())
    assert got(calendar.fixed(Col("days", "t"), "2024-02-29", "2024-02-29")) == [1]
    assert got(calendar.fixed(Col("days", "t"), "2024-02-28", "2024-02-29", False)) == [3]
    assert got(calendar.relative(Col("days", "t"), "mtd", datetime.date(2024, 3, 15))) == [2]
    assert got(calendar.fiscal(Col("days", "t"), "fiscal_jul", 2023)) == [1, 2, 3]
    assert calendar.fiscal(Col("days", "t"), "fiscal_apr", 2023).parts[1].right.value == "2024-04-01"
    for bad in (lambda: calendar.relative(Col("days", "t"), "last_week"), lambda: calendar.fiscal(Col("days", "t"), "fiscal_oct", 2023)):
        with pytest.raises(SpecError):
            bad()


def test_parsers_are_closed():
    assert parse_predicate("a >= 800 OR b <> 15").parts[1].op == "!="
    for text in ("__import__('os')", "a.b.c", "a if b else c", "f(x)", "[1]", "a; b", "NULLIF(a, 1)"):
        with pytest.raises(SpecError):
            parse_value(text)
    with pytest.raises(SpecError):
        filter_of(Col(None, "a"), "matches", 1)


def test_malformed_literal_raises(tables):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        lower(Plan((F_, Filter(Cmp("=", Col("f", "k"), Lit("ten"))))), tables).collect()


def test_scope_refuses_ambiguity(tables):
    with pytest.raises(SpecError, match="AMBIGUOUS"):
        lower(Plan((F_, Join(D_, "inner", ON), Filter(Cmp("=", Col(None, "k"), Lit(1))))), tables)
    with pytest.raises(SpecError, match="UNKNOWN"):
        lower(Plan((F_, Filter(Cmp("=", Col("f", "zz"), Lit(1))))), tables)


def test_plan_round_trip_and_fingerprint():
    assert loads(dumps(FLAGSHIP)) == FLAGSHIP
    assert loads(dumps(FLAGSHIP)).fingerprint() == FLAGSHIP.fingerprint() != Plan(FLAGSHIP.steps[:-1]).fingerprint()


def test_names():
    assert normalise("custId", {"cust_id": "customer_id"}) == "customer_id"
    assert normalise("ordAmt") == "order_amount"
    assert normalise("dim__Region-Code", prefixes=("dim_",)) == "regioncode"
    assert [row_count(x) for x in ("~5000万", "8千", 7, "many", None)] == [50_000_000, 8_000, 7, None, None]
    assert edit_distance("kitten", "sitting") == 3


SPEC = {
    "source_tables": [{"name": "f", "alias": "f", "columns": [{"name": "id", "type": "int"}, {"name": "k", "type": "int"}, {"name": "v", "type": "double"}, {"name": "s", "type": "string"}]}],
    "metrics": [{"metric_name": "n", "aggregation": "COUNT"}],
    "dimensions": [{"column_ref": "f.s"}],
    "output_columns": ["s", "n"],
}


def test_spec_runs(tables):
    assert sorted(map(tuple, program.run(parse(SPEC), tables).collect()), key=repr) == [("a", 2), ("b", 1), (None, 1)]


def test_markdown_spec():
    text = "# Title\n\n---\nspec:\n  source_tables:\n    - {name: f, alias: f, row_count: ~500万, columns: [id]}\n  output_columns: [id]\n---\nmore"
    spec = parse(text)
    assert spec.tables[0].meta.est_rows == 5_000_000 and {w.code for w in spec.warnings} == {"W001", "W002", "W004"}


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({"source_tables": []}, "E002"),
        ({"output_columns": []}, "E006"),
        ({"metrics": [{"metric_name": "n", "aggregation": "COUNT", "where_sql": "1=1"}]}, "E007"),
        ({"source_tables": SPEC["source_tables"] * 2}, "E005"),
        ({"dimensions": [{"column_ref": "f.zz"}]}, "E004"),
        ({"metrics": [{"metric_name": "n", "aggregation": "SUM", "input_expression": "exec('x')"}]}, "E008"),
        ({"metrics": [{"metric_name": "n", "aggregation": "SUM"}]}, "E002"),
        ({"sort": [{"column": "n", "direction": "DOWN"}]}, "SORT"),
        ({"compute_steps": [{"step_name": "a", "source": "input", "surprise": 1}]}, "UNKNOWN_KEY"),
        ({"ratios": [{"name": "n", "numerator": "n", "denominator": "n"}]}, "RATIO"),
    ],
)
def test_rejections(change, code):
    with pytest.raises(SpecError) as e:
        parse({**SPEC, **change})
    assert e.value.code == code


def test_yaml_errors_have_a_code():
    with pytest.raises(SpecError) as e:
        parse("---\nspec: [\n---\n")
    assert e.value.code == "E001"


def test_program_graph():
    step = lambda name, *source: {"step_name": name, "source": list(source) or "input", "group_by": ["s"], "metrics": [{"metric_name": "n", "aggregation": "COUNT"}]}
    spec = parse({**SPEC, "compute_steps": [step("c", "b"), step("b", "a"), step("a")]})
    assert [s.name for s in program.order(spec.steps)] == ["a", "b", "c"]
    with pytest.raises(SpecError, match="CIRCULAR"):
        program.order(parse({**SPEC, "compute_steps": [step("a", "b"), step("b", "a")]}).steps)
    assert {f.code for f in program.check(parse({**SPEC, "compute_steps": [step("a"), step("b", "gone")]}))} >= {"DAG_MISSING"}
    assert {f.code for f in program.check(parse({**SPEC, "compute_steps": [step("a"), step("b"), step("c", "b")]}))} == {"DAG_UNREAD"}


def test_confluence_needs_a_join(tables):
    two = [{"step_name": n, "source": "input", "group_by": [g], "metrics": [{"metric_name": n + "_n", "aggregation": "COUNT"}]} for n, g in (("a", "s"), ("b", "k"))]
    spec = parse({**SPEC, "output_columns": ["a_n"], "compute_steps": [*two, {"step_name": "z", "source": ["a", "b"], "group_by": ["a_n"]}]})
    with pytest.raises(SpecError, match="JOIN"):
        program.run(spec, tables)


def test_table_match_refuses_ties(tables):
    both = [{"name": "f", "alias": "x", "columns": ["k", "v"]}, {"name": "f", "alias": "y", "columns": ["k", "v"]}]
    spec = parse({"source_tables": both, "output_columns": ["n"], "compute_steps": [{"step_name": "a", "source": "input", "group_by": ["k"], "metrics": [{"metric_name": "n", "aggregation": "COUNT"}]}]})
    with pytest.raises(SpecError, match="TABLE_MATCH"):
        program.run(spec, tables)


def test_bridge_finds_the_table_between(spark):
    cat = Catalog(spark).add("a", spark.createDataFrame([(1, 5)], "id int, d_id int")).add("b", spark.createDataFrame([(5, 9)], "d_id int, home_r int")).add("r", spark.createDataFrame([(9, "far")], "r int, place string"))
    tables = [{"name": "a", "alias": "a", "columns": ["id", "d_id"]}, {"name": "b", "alias": "b", "columns": ["d_id", "home_r"], "unique_keys": ["d_id"]}, {"name": "r", "alias": "r", "columns": ["r", "place"], "unique_keys": ["r"]}]
    spec = parse({"source_tables": tables, "output_columns": ["place", "n"], "compute_steps": [{"step_name": "s", "source": "input", "group_by": ["r.place"], "metrics": [{"metric_name": "n", "aggregation": "COUNT", "input_column": "a.id"}]}]})
    # the step names r, which the rows of a reach over b only
    runner = program.Runner(spec, cat)
    start = program.bridge(["id", "d_id"], spec.tables, spec.tables[2])
    assert start is not None and start[0].alias == "b" and start[2] == (("home_r", "r"),)
    assert runner.spec is spec


def test_label_phases():
    label = {"output_column": "l", "branches": [{"when": "v > 1", "then": "big"}], "else_value": "small"}
    early = build(parse({**SPEC, "labels": [label], "output_columns": ["s", "l", "n"]}))
    assert [type(s).__name__ for s in early.steps] == ["Scan", "Derive", "Aggregate", "Project"]
    late = build(parse({**SPEC, "labels": [{**label, "branches": [{"when": "n > 1", "then": "big"}]}], "output_columns": ["s", "l", "n"]}))
    assert [type(s).__name__ for s in late.steps] == ["Scan", "Aggregate", "Derive", "Project"]
    with pytest.raises(SpecError, match="PHASE"):
        build(parse({**SPEC, "labels": [{**label, "branches": [{"when": "other > 1", "then": "big"}]}]}))


def test_types_and_evidence():
    assert compatible("int", "bigint") and compatible("INT", "double") and not compatible("int", "varchar")
    assert compatible("point", "int") and not compatible("point", "int", unknown=False)
    a = TableMeta("a", foreign_keys=(ForeignKey("cust_id", "b", "id"),), types={"cust_id": "int", "custid": "int", "name": "string"})
    b = TableMeta("b", unique_keys=(("customer_id",),), types={"id": "int", "customer_id": "int", "name": "int"})
    assert join_evidence(a, b, "cust_id", "id").level == "STRONG"
    assert join_evidence(a, b, "cust_id", "customer_id").level == "MEDIUM"
    assert join_evidence(a, TableMeta("c", types={"cust_ids": "int"}), "cust_id", "cust_ids") == join_evidence(a, TableMeta("c"), "custid", "custids")
    assert join_evidence(a, b, "name", "name", declared=True).level == "NONE"


def test_facts_conflict_or_fill():
    merged, found = merge_facts(TableMeta("t", types={"a": "int"}, enums={"e": ("x",)}), TableMeta("t", "dim", types={"a": "varchar", "b": "int"}, enums={"e": ("y",)}))
    assert {f.code for f in found} == {"TYPE_CONFLICT", "ENUM_CONFLICT"} and merged.types == {"a": "int", "b": "int"} and merged.role == "dim"
    assert merge_facts(TableMeta("t"), None)[1][0].level == "warn"


def test_spec_checks():
    big = {**SPEC, "source_tables": [{**SPEC["source_tables"][0], "row_count": "200万"}]}
    assert {f.code for f in check_spec(parse(big))} == {"TIME"}
    two = {**SPEC, "source_tables": [*SPEC["source_tables"], {"name": "d", "alias": "d", "columns": [{"name": "k", "type": "string"}]}], "joins": [{"left_table": "f", "right_table": "d", "left_key": "k", "join_type": "LEFT"}]}
    assert {f.code for f in check_spec(parse(two))} == {"FANOUT", "JOINTYPE"}
    assert {f.level for f in check_spec(parse(two), "warn") if f.code == "FANOUT"} == {"warn"}
    assert {f.code for f in check_spec(parse({**SPEC, "target_grain": ["k"]}))} == {"GRAIN"}


def test_label_checks():
    spec = parse({**SPEC, "source_tables": [{**SPEC["source_tables"][0], "columns": [*SPEC["source_tables"][0]["columns"], {"name": "lab", "type": "string", "enum": ["x", "y"]}]}], "labels": [{"output_column": "lab", "branches": [{"when": "NOT v > 1", "then": "q"}, {"when": "gone > 2", "then": "x"}]}]})
    assert {f.code for f in check_label(spec.cases[0], spec, strict=True)} == {"NO_LABEL_NOT", "FIELD_EXISTS", "LABEL_DOMAIN", "COVERAGE"}
    assert {f.level for f in check_label(spec.cases[0], spec, tiers={"lab": "HIGH"}) if f.code == "LABEL_DOMAIN"} == {"warn"}


def test_plan_checks():
    assert [f.code for f in check_plan(Plan())] == ["EMPTY"]
    inner = Plan((F_, Window("w", "RANK", order=(Order(Col("f", "id")),))))
    deep = Plan((Subquery(Plan((Subquery(Plan((Subquery(Plan((F_,)), "c"),)), "b"),)), "a"),))
    assert "V-010d" in {f.code for f in check_plan(Plan((Subquery(inner, "q"),)))}
    assert "V-010a" in {f.code for f in check_plan(deep)}
    assert "V-009b" in {f.code for f in check_plan(Plan((F_, Join(D_, "inner", ON), Join(D_, "inner", ON))))}
    assert {f.code for f in check_plan(Plan((F_,)), {"f": TableMeta("f", types={"id": "int"})})} == {"COL"}
    bad = [Window("w", "RANK", order=(Order(Col("f", "id")),), frame=Frame("rows", -1, 0)), Window("w", "SUM", Col("f", "id"), order=(Order(Col("f", "id")),), frame=Frame("range", -1, "current")), Window("w", "SUM_OVER", Col("f", "id"), order=(Order(Col("f", "id")),), frame=Frame("rows", 1, -1)), Window("w", "RANK")]
    assert all(any(f.level == "reject" for f in check_window(w)) for w in bad)


def test_performance_rules(spark, tables):
    meta = {"f": TableMeta("f", "fact", est_rows=5_000_000, time_column="t", types={"k": "int"}), "d": TableMeta("d", "dim", types={"k": "string"}), "dws_f": TableMeta("dws_f")}
    plan = Plan((F_, Join(D_, "inner", ON), Window("w", "RANK", order=(Order(Col("f", "id")),)), Sort((Order(Col("f", "id")),)), Derive("x", Lit(1)), Derive("y", Lit(1)), Derive("z", Lit(1)), Derive("q", Lit(1)), Derive("u", Lit(1))))
    assert {f.code for f in perf.lint(plan, meta)} == {"PERF-002", "PERF-006", "PERF-007", "PERF-008", "PERF-011", "PERF-012", "PERF-014"}
    count = Plan((F_, Aggregate((), (Metric("n", "COUNT_DISTINCT", Col("f", "id")),))))
    assert {f.code: f.level for f in perf.lint(count, meta, [count], "warn")}["PERF-009"] == "warn"
    assert "PERF-013" in {f.code for f in perf.lint(count, meta, [count])} and "PERF-004" in {f.code for f in perf.lint(count, meta)}
    assert "PERF-010" in {f.code for f in perf.lint(Plan((F_, Join(D_, "cross"))), meta)}
    found = perf.explain(spark.range(3).crossJoin(spark.range(4)), 6000)
    assert {f.code for f in found} == {"EXPLAIN", "PERF-015"}


def test_enum_judgement():
    assert judge("is_open", ["0", "1"], 2, 100).tier == "CERTAIN"
    assert judge("order_status", ["Open", "Closed", "In Transit"], 3, 100).tier == "HIGH"
    assert judge("zip_code", ["10001", "10002", "10003"], 3, 1000).tier == "HIGH"
    assert judge("user_id", ["1", "2"], 2, 100).tier == "NOT_ENUM"
    assert judge("state", ["0", "1"], 2, 100).tier == "LOW" and judge("is_open", ["a", "b", "c"], 3, 100).tier == "NOT_ENUM"
    assert judge("c_level", ["PDR", "ADR", "OTH"], 3, 100).kind == "code" and judge("birth_year", ["1990", "1991", "1992"], 3, 100).tier == "NOT_ENUM"
    assert judge("x", ["Open", "Closed", "Shut"], 3, 100).tier == "MEDIUM" and judge("x", ["Blue", "Red", "red"], 3, 100).tier == "LOW"
    assert judge("note", [], 0, 5).tier == "NOT_ENUM"


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 AS k", "id * 2 AS unused").write.parquet(f"{tmp_path}/t.parquet")
    cat = Catalog(spark).add_file("t", f"{tmp_path}/t.parquet")
    plan = lower(Plan((Scan("t", "t", ("id", "k", "unused")), Filter(Cmp(">", Col("t", "id"), Lit(50))), Aggregate((Key("k", Col("t", "k")),), (Metric("n", "COUNT"),)))), cat)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,50)" in text and "unused" not in text.split("ReadSchema")[1]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,b\n")
    (tmp_path / "a.json").write_text('{"x": 2, "y": "c"}\n')
    cat = Catalog(spark).add_file("csv", f"file://{tmp_path}/a.csv").add_file("json", f"file://{tmp_path}/a.json")
    assert [tuple(cat.read(n).first()) for n in ("csv", "json")] == [(1, "b"), (2, "c")]
    spark.range(2).createOrReplaceTempView("attached")
    assert cat.add_catalog_table("v", "attached").read("v").count() == 2
    for bad in (lambda: cat.add_file("z", "z.xls"), lambda: cat.read("gone")):
        with pytest.raises(SpecError):
            bad()


def test_stream_takes_row_wise_plans(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    plan = Plan((Scan("s", "s", ("id",)), Filter(Cmp(">=", Col("s", "id"), Lit(3))), Project((Key("x", parse_value("id * 2")),))))
    query = apply(plan, stream).writeStream.format("memory").queryName("out").option("checkpointLocation", f"{tmp_path}/cp").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r[0] for r in spark.table("out").collect()) == [6, 8]
    with pytest.raises(SpecError):
        apply(Plan((Scan("s", "s", ("id",)), Sort((Order(Col("s", "id")),)))), stream)


def test_limit_and_offset(tables):
    assert [r[0] for r in lower(Plan((F_, Project((Key("id", Col("f", "id")),)), Sort((Order(Col(None, "id")),)), Limit(2, 1))), tables).collect()] == [2, 3]
