"""Every registered line query against its SQL twin on the smallest tables; the entry without the optional parts."""

import os
import subprocess
import sys

import duckdb
import pytest

from linespark.plans import catalog

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "lineitem"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def test_each_query_has_a_twin():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    ours = catalog.queries()[name](spark, SF)
    names = sorted(ours.columns)
    theirs = duck.execute(f"select {', '.join(chr(34) + n + chr(34) for n in names)} from ({catalog.oracle_sql()[name]})").fetchall()
    key = lambda rows: sorted(tuple(str(round(v, 3) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert key(ours.select(names).collect()) == key(theirs)


@pytest.mark.parametrize("left", ["nothing", "an empty folder", "compiled files", "no pipeline"])
def test_entry_works_without_the_llm_parts(tmp_path, left):
    copy = tmp_path / "repo"
    copy.mkdir()
    subprocess.run(["cp", "-r", f"{ROOT}/linespark", f"{ROOT}/__spark_entry__.py", str(copy)], check=True)
    if left != "no pipeline" and (copy / "linespark/llm").exists():
        (copy / "linespark/llm").rename(tmp_path / "llm")
    if left in ("an empty folder", "compiled files"):
        (copy / "linespark/llm" / ("__pycache__" if left == "compiled files" else "")).mkdir(parents=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
    assert out.stdout.split() == [str(len(catalog.queries())), str(len(catalog.oracle_sql())), "False"], out.stderr
