"""Every registered query with SQL against DuckDB on the smallest tables, where those are at hand."""

import glob
import os
import subprocess
import sys
from collections import Counter

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("GEOLOOM_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def shown(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    rows = duck.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in rows.description)
    at = [[d[0] for d in rows.description].index(c) for c in columns]
    want = Counter(tuple(str(shown(r[i])) for i in at) for r in rows.fetchall())
    assert sorted(got.columns) == columns
    assert Counter(tuple(str(shown(v)) for v in r) for r in got.select(*columns).collect()) == want


def test_entry_and_names(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_are_listed_without_a_session():
    code = "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 100)"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(entry.__file__), capture_output=True, text=True, timeout=120).stdout.strip() == "True"


def test_core_stands_alone():
    """Nothing outside the llm subpackage imports it."""
    for path in glob.glob(os.path.join(os.path.dirname(entry.__file__), "geoloom", "**", "*.py"), recursive=True):
        if f"{os.sep}llm{os.sep}" not in path:
            with open(path) as f:
                assert "geoloom.llm" not in f.read()
