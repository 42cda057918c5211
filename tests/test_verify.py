"""Digests, comparisons, equivalence, summaries, snapshots and write plans."""

import hashlib
import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from specdag.errors import SpecError
from specdag.functions.expr import And, Between, Cmp, Col, Lit, Not, Or
from specdag.plans.steps import Filter, Order, Plan, Scan, Sort
from specdag.sources import snapshot, writeplan
from specdag.sources.catalog import TableMeta
from specdag.verify import digest as D
from specdag.verify.compare import Status, Tolerance, compare, diff
from specdag.verify.equivalence import Verdict, equivalent, same_plan
from specdag.verify.summary import anomalies, summary

#: The published digests of no row, one row 42, and two rows 42 of one INT64 column.
SPEC_HASH = "42e7e49eea351eb3ea56422c630cc83a09304d340a44ba7a2b834addc9ef837c"
GOLDEN = {
    (): "fe87ca8986780b07ea939019305bd529a20c4fa0b9142944781bf0d793fb312f",
    (42,): "7eb7be296ccebf677c6236a70fc70a1f4f6e14e47a6a3e0418f10bd2a56fc41b",
    (42, 42): "80ba148da68cc8350caf4e2d54549a9061da975cf134720fecd3482fa7e7de66",
}
#: Row hashes of 42 and of null.
ROW_42 = "deaf1410854302ec82ae34f4d06a554af614eb3a53cf3496727a21bf10216a30"
ROW_NULL = "63cb7db7d8c0ef217b5e4bd8918f9a312551762a5129f21a747ebcf54297f0d4"


@pytest.mark.parametrize("values", list(GOLDEN))
def test_golden_digests(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x long")
    assert D.digest(df, spec_hash=SPEC_HASH).first()["digest"] == GOLDEN[values]


def test_golden_rows(spark):
    df = spark.createDataFrame([(42,), (None,)], "x long")
    assert [r[0].lower() for r in df.select(D.row_hash(df, D.DigestSpec.of(df))).collect()] == [ROW_42, ROW_NULL]


@pytest.mark.parametrize(("value", "text"), [(math.nan, "nan"), (math.inf, "inf"), (-math.inf, "-inf"), (-0.0, "-0.0"), (0.0, "0.0"), (1.5, "1.5"), (-2.0, "-2.0"), (100.0, "100.0"), (0.125, "0.13")])
def test_float_texts(spark, value, text):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(D._text(F.col("x"), D.Field("x", "FLOAT64", 2))).first()[0] == text


def oracle(rows, fields):
    """The digest, in plain Python."""
    counts = {}
    for row in rows:
        raw = b""
        for v, (family, places) in zip(row, fields, strict=True):
            raw += bytes([D.TAGS[family]])
            if v is None:
                raw += b"\xff" * 4
                continue
            if family == "FLOAT64":
                if math.isnan(v) or math.isinf(v):
                    text = "nan" if math.isnan(v) else "inf" if v > 0 else "-inf"
                else:
                    text = str(float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))) if v else ("-0.0" if math.copysign(1, v) < 0 else "0.0")
            else:
                text = str(v).lower() if family == "BOOLEAN" else str(v)
            raw += len(text.encode()).to_bytes(4, "big") + text.encode()
        h = hashlib.sha256(raw).digest()
        counts[h] = counts.get(h, 0) + 1
    out = b""
    for b in range(256):
        own = sorted((h, n) for h, n in counts.items() if h[0] == b)
        out += bytes([b]) + hashlib.sha256(bytes([b]) + len(own).to_bytes(8, "big") + b"".join(h + n.to_bytes(8, "big") for h, n in own)).digest()
    return hashlib.sha256(b"cdp-v1" + bytes.fromhex(SPEC_HASH) + len(rows).to_bytes(8, "big") + (256).to_bytes(2, "big") + out).hexdigest()


def test_random_digests_equal_plain_python(spark):
    kinds = {"INT64": "long", "VARCHAR": "string", "FLOAT64": "double", "BOOLEAN": "boolean"}
    for seed in range(12):
        r = random.Random(seed)
        families = [r.choice(list(kinds)) for _ in range(r.randint(1, 4))]
        make = {"INT64": lambda: r.randint(-5, 5), "VARCHAR": lambda: r.choice(["", "a", "é", "日本"]), "FLOAT64": lambda: r.choice([math.nan, math.inf, -0.0, 0.0, r.randint(-999, 999) / 8]), "BOOLEAN": lambda: r.random() < 0.5}
        rows = [tuple(None if r.random() < 0.2 else make[f]() for f in families) for _ in range(r.randint(0, 20))]
        df = spark.createDataFrame(rows, ", ".join(f"c{k} {kinds[f]}" for k, f in enumerate(families)))
        assert D.digest(df, D.DigestSpec.of(df, 4), SPEC_HASH).first()["digest"] == oracle(rows, [(f, 4) for f in families]), seed


def test_digest_ignores_order_and_refuses_nested(spark):
    a = spark.range(50).withColumn("y", F.col("id") % 3)
    assert D.same(a, a.orderBy(F.desc("id")).repartition(3))
    assert not D.same(a, a.filter("id > 0"))
    with pytest.raises(SpecError):
        D.same(a, a.select("y", "id"))
    with pytest.raises(SpecError):
        D.DigestSpec.of(a.select(F.array("id")))


def test_comparison(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, math.nan, None), (3, 0.0, "")], "k int, v double, s string")
    assert compare(a, a, ["k"]).status is Status.CONSISTENT
    assert compare(a, a.withColumn("v", F.col("v") * (1 + 1e-12)), ["k"]).status is Status.CONSISTENT_WITH_WARN
    assert compare(a, a.filter("k > 1"), ["k"]).reason == "the row counts differ"
    assert compare(a, a, None).status is Status.HUMAN_REVIEW
    assert compare(a.filter("false"), a.filter("false"), ["k"]).status is Status.HUMAN_REVIEW
    assert compare(a.union(a), a.union(a), ["k"]).status is Status.HUMAN_REVIEW
    assert compare(a, a, ["k"], sampled=True).status is Status.SAMPLED_CONSISTENT
    large = spark.range(50).withColumnRenamed("id", "k")
    assert compare(large, large.filter("k < 10"), ["k"], sampled=True).reason == "the row counts differ"
    assert compare(large, large.filter("k > 0").unionByName(spark.range(50, 51).withColumnRenamed("id", "k")), ["k"], sampled=True).status is Status.MISMATCH
    blank = a.withColumn("s", F.coalesce("s", F.lit("")))  # null, NaN and empty text are three values
    assert [(r["k"], list(r["columns"])) for r in diff(a, blank, ["k"]).collect()] == [(2, ["s"])]
    assert compare(a, a.fillna(0.0, ["v"]), ["k"]).status is Status.MISMATCH
    assert diff(a, a.withColumn("v", F.col("v") + 1e-3), ["k"], Tolerance(0, 1e-2)).count() == 0


def test_equivalence(spark):
    s = Scan("t", "t", ("a", "b"))
    a, b = Cmp(">", Col("t", "a"), Lit(1)), Cmp("=", Col("t", "b"), Lit(2))
    same = lambda *steps: Plan((s, *steps))
    assert equivalent(same(Filter(And((a, b)))), Plan((Scan("t", "t", ("b", "a")), Filter(b), Filter(Cmp("<", Lit(1), Col("t", "a"))))))[0] is Verdict.EQUIVALENT
    assert equivalent(same(Filter(Between(Col("t", "a"), Lit(1), Lit(2)))), same(Filter(And((Cmp("<=", Col("t", "a"), Lit(2)), Cmp(">=", Col("t", "a"), Lit(1)))))))[0] is Verdict.EQUIVALENT
    assert equivalent(same(Filter(Not(Not(a)))), same(Filter(a)))[0] is Verdict.EQUIVALENT
    assert equivalent(same(Filter(Or((a, b)))), same(Filter(And((a, b)))))[0] is Verdict.MISMATCH
    one, two = Order(Col("t", "a")), Order(Col("t", "b"))
    assert equivalent(same(Sort((one, two))), same(Sort((two, one))))[1] == ["step 1: Sort differs"]
    df = spark.range(3)
    assert same_plan(df.filter("id > 1"), df.filter("id > 1")) and not same_plan(df, df.filter("id > 1"))


def test_summary_and_anomalies(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 1.25, None)], "k int, v double, s string")
    assert [tuple(r) for r in summary(df).orderBy("column").collect()] == [("k", 2, 0, 3.0), ("s", 2, 1, None), ("v", 2, 1, 1.25)]
    meta = TableMeta("t", est_rows=100, types={"k": "string", "gone": "int"}, nullable={"v": False})
    assert {f.code for f in anomalies(df, meta, partition="k", partitions=(1, 9))} == {"MISSING_COLUMN", "TYPE_MISMATCH", "UNEXPECTED_NULL", "PARTITION_GAP", "ROW_COUNT_DRIFT"}


def test_snapshot(spark, tmp_path):
    orders = spark.range(100).selectExpr("id", "id % 10 AS c", "id % 3 AS s")
    customers = spark.range(10).selectExpr("id AS c")
    found = snapshot.related({"o": orders, "c": customers, "alone": spark.range(9)}, "c", [snapshot.Relation("o", "c", (("c", "c"),))], rows=4, budget=25)
    assert found["c"].count() == 4 and found["o"].count() == 20 and found["alone"].count() == 4
    assert found["o"].groupBy("c").count().filter("count <> 10").count() == 0
    manifest = snapshot.write(spark, found, f"file://{tmp_path}/snap")
    assert manifest["tables"]["o"]["rows"] == 20 and snapshot.verify(spark, f"file://{tmp_path}/snap") == []
    part = next((tmp_path / "snap/o").glob("part*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert snapshot.verify(spark, f"file://{tmp_path}/snap") == ["o"]
    for mode, more in (("head", {"rows": 7}), ("random", {"fraction": 0.5, "seed": 1}), ("stratified", {"fraction": 0.5, "by": "s"}), ("full", {})):
        n = snapshot.sample(orders, mode, **more).count()
        assert n == {"head": 7, "full": 100}.get(mode, n) and 20 < n <= 100 or mode == "head"


def test_write_plan(spark, tmp_path):
    good = writeplan.WritePlan("ads.t", "_temp_x", ("dt",), {"dt": "20240131"}, "yyyyMMdd")
    assert writeplan.check(good) == [] and "PARTITION (dt='20240131')" in good.statement()
    bad = writeplan.WritePlan("ads.t; drop", "x", ("dt",), {"d": "2024-01"}, "yyyyMM", "full", ("MERGE", "COPY"))
    assert {f.code for f in writeplan.check(bad)} >= {"WV-001", "WV-003", "WV-005", "WV-006", "WV-009", "WV-010"}
    for day in ("20240131", "20240201"):
        writeplan.execute(spark.range(3), writeplan.WritePlan("ads.t", "x", ("dt",), {"dt": day}), f"{tmp_path}/t")
    writeplan.execute(spark.range(1), good, f"{tmp_path}/t")
    assert {r["dt"]: r["count"] for r in spark.read.parquet(f"{tmp_path}/t").groupBy("dt").count().collect()} == {20240131: 1, 20240201: 3}
    with pytest.raises(SpecError):
        writeplan.execute(spark.range(1), bad, f"{tmp_path}/t")
