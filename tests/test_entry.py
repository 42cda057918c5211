"""The driver contract: every query against its SQL, and what is left without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from specdag import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(columns, found):
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    df = core.QUERIES[name](spark, DATA)
    found = df.collect()
    if name not in core.ORACLES:
        assert found
        return
    want = duck.sql(core.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, found) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_works_alone(tmp_path):
    root = Path(core.__file__).resolve().parents[1]
    for name in ("specdag", "__spark_entry__.py", "tests", "bench.py"):
        source = root / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    for name in ("specdag/llm", "tests/llm"):
        shutil.rmtree(tmp_path / name, ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    # the other tests, but for this file, which would run itself
    found = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "--ignore=tests/test_entry.py", "tests"], cwd=tmp_path, check=False, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert found.returncode == 0, found.stdout[-2000:]
